"""Report import: table rows to proposals, and confirmed proposals into the tables.

``assemble_report`` is the silver step: one pass of windows over the rows of each file, in
file order. ``confirm_import`` is the gold step: it returns every table and audit that the
next snapshot holds, so that a writer can put them in place together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackledger.functions import text as T
from trackledger.functions.names import pooled_agreement
from trackledger.lineage import cut
from trackledger.operators import upsert, views

TITLE_FIELDS = ("kapitel", "titel_nr", "label", "is_nachrichtlich", *T.BUDGET_COLUMNS)


def assemble_report(rows: DataFrame, page_texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, titles, unmatched) of budget tables ``rows(path, row_no, cells)``.

    Rows before a file's first header, headers, empty rows and rows of column numbers are
    skipped. A main row opens an entry; explanations, memo lines, title rows and
    continuations belong to the entry above them; a row with a running number but without
    an agreement number closes it and is unmatched. A title row with "davon:" that lost its
    number is an entry of its own when ``page_texts(path, text)`` names it, else it is
    dropped. Bulleted items are kept for pooled agreements only.
    """
    cells = F.col("cells")
    marked = rows.select("path", "row_no", "cells", T.row_kind(cells).alias("kind"), T.project_name(T.cell(cells, T.NAME_COLUMN)).alias("name"))
    start = marked.where("kind = 'header'").groupBy("path").agg(F.min("row_no").alias("first_header"))
    body = marked.join(start, "path").where("row_no > first_header and kind not in ('header', 'empty', 'numbers')").drop("first_header")
    lost = (F.col("kind") == "title") & F.lower(F.coalesce(T.cell(cells, T.NAME_COLUMN), F.lit(""))).contains("davon:")
    body = body.withColumn("lost", lost)
    if page_texts is None:
        body = body.withColumn("recovered", F.lit(None).cast("int"))
    else:
        named = page_texts.select("path", F.posexplode(T.orphan_names(F.col("text"))).alias("pos", "o"))
        known = named.groupBy("path", F.col("o.name").alias("low")).agg(F.max_by("o.finve_nr", "pos").alias("recovered"))
        body = body.withColumn("low", F.when(F.col("lost"), F.lower("name"))).join(known, ["path", "low"], "left").drop("low")
    opens = F.col("kind").isin("main", "unnumbered") | (F.col("lost") & F.col("recovered").isNotNull())
    # Four outputs read the assembled rows; they are written once rather than assembled four times.
    parts = cut(views.assemble(body.withColumn("opens", opens), ["path"], "row_no", F.col("opens")).where("part > 0"))
    ids = T.combined_id(T.cell(cells, 0))
    second = F.translate(T.cell(cells, 1), ".", "").try_cast("int")
    heads = parts.where("opens").select(
        "path", "part", "row_no", "cells", "name", "kind",
        F.when(F.col("lost"), "YYY").otherwise(F.coalesce(ids["lfd_nr"], T.some(T.cell(cells, 0)))).alias("lfd_nr"),
        F.coalesce("recovered", ids["finve_nr"], second).alias("finve_nr"),
        F.when(~F.col("lost"), F.coalesce(ids["plan_nr"], T.some(T.cell(cells, 2)))).alias("plan_nr"),
        (pooled_agreement(F.col("name")) | F.col("lost")).alias("pooled"),
    )
    unmatched = heads.where("kind = 'unnumbered'").select("path", "row_no", "lfd_nr", "plan_nr", "name")
    heads = heads.where("kind <> 'unnumbered'")
    first = lambda i: T.nth_line(T.cell(F.col("cells"), i), 0)
    below = parts.where("not opens and not lost").join(heads.select("path", "part", "pooled"), ["path", "part"])
    items = below.where("pooled and kind in ('explanation', 'continuation')").select(
        "path", "part", "row_no", T.bullet_items(T.cell(F.col("cells"), T.NAME_COLUMN)).alias("items")
    )
    items = items.groupBy("path", "part").agg(F.array_sort(F.collect_list(F.struct("row_no", "items"))).alias("x"))
    items = items.select("path", "part", F.flatten(F.transform("x", lambda v: v["items"])).alias("items"))
    entries = heads.join(items, ["path", "part"], "left").select(
        "path", "part", "row_no", "finve_nr", "lfd_nr", "plan_nr", "name", "pooled", T.parse_int(T.cell(F.col("cells"), 4)).alias("starting_year"),
        T.parse_int(first(5)).alias("cost_estimate_original"), T.parse_int(first(6)).alias("cost_estimate_last_year"),
        T.parse_int(first(7)).alias("cost_estimate_actual"), T.parse_int(first(8)).alias("delta_previous_year"),
        T.parse_float(first(9)).alias("delta_previous_year_relativ"), first(10).alias("delta_previous_year_reasons"),
        T.parse_int(first(11)).alias("spent_two_years_previous"), T.parse_int(first(12)).alias("allowed_previous_year"),
        T.parse_int(first(13)).alias("spending_residues"), T.parse_int(first(14)).alias("year_planned"), T.parse_int(first(15)).alias("next_years"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    own = heads.select("path", "part", "row_no", F.posexplode(T.inline_titles(F.col("cells"))).alias("pos", "t"))
    memo = below.where("kind = 'memo'").select("path", "part", "row_no", F.posexplode(T.memo_titles(F.col("cells"))).alias("pos", "t"))
    old = below.where("kind = 'title'").select("path", "part", "row_no", F.lit(0).alias("pos"), T.title_row(F.col("cells")).alias("t"))
    titles = own.union(memo).union(old).join(heads.select("path", "part", "finve_nr"), ["path", "part"]).select("path", "part", "finve_nr", "row_no", "pos", "t.*")
    return entries, titles, unmatched


@dataclass
class Confirmed:
    """Snapshots and audits of one confirmed import."""

    finves: DataFrame
    finve_audit: DataFrame
    budgets: DataFrame
    budget_audit: DataFrame
    titles: DataFrame
    facts: DataFrame
    links: DataFrame
    quarantine: DataFrame
    receipt: DataFrame


def confirm_import(
    year: int,
    receipt: DataFrame,
    entries: DataFrame,
    entry_titles: DataFrame,
    project_ids: DataFrame,
    unmatched: DataFrame,
    finves: DataFrame,
    budgets: DataFrame,
    titles: DataFrame,
    facts: DataFrame,
    links: DataFrame,
    now,
) -> Confirmed:
    """Everything the confirmation of a parse result changes.

    ``receipt(parse_id, confirmed_at)`` must hold one row (else ``ValueError``); it guards against a second import: a result
    already confirmed makes every output fail. Order: agreements, budgets (last entry of an
    agreement wins), title dimension (first label kept), title facts, links within the scope
    of the agreement (the year for pooled ones, else permanent), unmatched rows, receipt.
    ``project_ids(finve_id, project_id)`` are the editor's decisions.
    """
    if len(receipt.limit(2).select("parse_id").collect()) != 1:
        raise ValueError("the receipt must hold exactly one row")
    guard = receipt.select(F.assert_true(F.col("confirmed_at").isNull(), F.lit("this parse result is already imported")).alias("g"))
    open_ = entries.join(F.broadcast(guard)).where("g is null").drop("g")  # one row
    last = upsert.first_per_key(open_, ["finve_nr"], F.desc("path"), F.desc("row_no"))
    staged_finves = last.select(F.col("finve_nr").alias("id"), "name", "starting_year", "cost_estimate_original", F.col("pooled").alias("is_sammel_finve"))
    new_finves, finve_audit = upsert.upsert(finves, staged_finves, ["id"], upsert.FINVE_FIELDS)
    staged_budgets = last.select(
        F.lit(year).alias("budget_year"), F.col("finve_nr").alias("fin_ve"), F.col("plan_nr").alias("bedarfsplan_number"), F.col("pooled").alias("sammel_finve"),
        *[c for c in upsert.BUDGET_FIELDS if c not in ("bedarfsplan_number", "sammel_finve")],
    )
    new_budgets, budget_audit = upsert.upsert(budgets, staged_budgets, ["budget_year", "fin_ve"], upsert.BUDGET_FIELDS)
    of_year = entry_titles.join(last.select("path", "part"), ["path", "part"]).withColumn("budget_year", F.lit(year))
    staged_titles = of_year.withColumn("seq", F.struct("path", "row_no", "pos"))
    new_titles = upsert.get_or_create(titles, staged_titles, "titel_key", "seq")
    staged_facts = staged_titles.withColumnRenamed("finve_nr", "fin_ve")
    new_facts = upsert.overwrite_facts(facts, staged_facts, ["budget_year", "fin_ve", "titel_key"], "seq")
    scope_year = F.when(F.col("pooled"), F.lit(year)).cast("int")
    scoped = last.select(F.col("finve_nr").alias("finve_id"), scope_year.alias("haushalt_year"))
    desired = project_ids.join(scoped, "finve_id").select("finve_id", "project_id", "haushalt_year")
    scope = scoped.select(F.col("finve_id").alias("s_finve"), F.col("haushalt_year").alias("s_year"))
    replaced = (links["finve_id"] == scope["s_finve"]) & links["haushalt_year"].eqNullSafe(scope["s_year"])
    new_links = links.join(scope, replaced, "left_anti").unionByName(desired.distinct())
    stamped = receipt.select("parse_id", F.coalesce("confirmed_at", now).alias("confirmed_at"))
    return Confirmed(new_finves, finve_audit, new_budgets, budget_audit, new_titles, new_facts, new_links, unmatched.withColumn("resolved", F.lit(False)), stamped)


def resolve_unmatched(quarantine: DataFrame, ids: DataFrame) -> DataFrame:
    """Quarantined rows with the given ones marked as resolved; nothing else changes."""
    hit = ids.select(F.col("row_id").alias("hit_id")).distinct()
    joined = quarantine.join(hit, F.col("row_id") == F.col("hit_id"), "left")
    return joined.withColumn("resolved", F.col("resolved") | F.col("hit_id").isNotNull()).drop("hit_id")
