"""Staged rows against current snapshots: new snapshot plus audit, without MERGE.

Every operator reads the current table and the staged rows and returns what the next
snapshot holds; keys compare null-safely, and running an operator twice on the same staged
rows changes nothing and writes no audit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FINVE_FIELDS = ("name", "starting_year", "cost_estimate_original", "is_sammel_finve")
BUDGET_FIELDS = (
    "lfd_nr", "bedarfsplan_number", "cost_estimate_original", "cost_estimate_last_year", "cost_estimate_actual", "delta_previous_year",
    "delta_previous_year_relativ", "delta_previous_year_reasons", "spent_two_years_previous", "allowed_previous_year",
    "spending_residues", "year_planned", "next_years", "sammel_finve",
)


def same_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])


def first_per_key(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank_in_key", rank).where("rank_in_key = 1").drop("rank_in_key")


def as_json(value: Column) -> Column:
    """The value as JSON text with non-ASCII characters escaped, in pairs beyond U+FFFF; null for null."""
    text = F.regexp_replace(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", "$1")
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    high = lambda c: F.ascii(c) - 0x10000
    pair = lambda c: F.concat(unit(F.shiftright(high(c), 10) + 0xD800), unit(high(c).bitwiseAND(0x3FF) + 0xDC00))
    escape = lambda c: F.when(F.ascii(c) > 0xFFFF, pair(c)).when(F.ascii(c) > 127, unit(F.ascii(c))).otherwise(c)
    escaped = F.array_join(F.transform(F.split(text, ""), escape), "")
    return F.when(value.isNotNull(), F.when(text.rlike(r"[^\x00-\x7f]"), escaped).otherwise(text))


def unpivot(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``keys, field_name, value``: the fields as JSON texts in long form."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), as_json(F.col(f)).alias("value")) for f in fields])
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.field_name", "p.value")


def upsert(current: DataFrame, staged: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(snapshot, audit) of staged rows with unique keys over the current table.

    Audit rows ``keys, action, field_name, old_value, new_value``: CREATE logs the fields
    that are set, UPDATE the fields that differ; equal rows log nothing.
    """
    old = current.select(*[F.col(k).alias(f"old_{k}") for k in keys], *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("had"))
    new = staged.select(*keys, *fields, F.lit(True).alias("has"))
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in keys])
    both = new.join(old, match, "full_outer")
    pick = lambda c: F.when(F.col("has"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    snapshot = both.select(*[pick(k) for k in keys], *[pick(f) for f in fields])
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field_name"), as_json(F.col(f"old_{f}")).alias("old_value"), as_json(F.col(f)).alias("new_value")) for f in fields]
    )
    changed = F.filter(pairs, lambda p: ~p["old_value"].eqNullSafe(p["new_value"]))
    action = F.when(F.col("had"), "UPDATE").otherwise("CREATE").alias("action")
    audit = both.where("has").select(*keys, action, F.explode(changed).alias("p")).select(*keys, "action", "p.*")
    return snapshot, audit


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], fields: Sequence[str], skip: Sequence[str] = ()) -> DataFrame:
    """Audit rows for two whole snapshots: CREATE, PATCH and DELETE."""
    kept = [f for f in fields if f not in skip]
    a = unpivot(old, keys, kept).withColumnRenamed("value", "old_value").withColumn("had", F.lit(True))
    b = unpivot(new, keys, kept).withColumnRenamed("value", "new_value").withColumn("has", F.lit(True))
    on = [*keys, "field_name"]
    both = a.join(b, on, "full_outer")
    action = F.when(F.col("had").isNull(), "CREATE").when(F.col("has").isNull(), "DELETE").otherwise("PATCH")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*on, action.alias("action"), "old_value", "new_value")


def revert(current: DataFrame, audit: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(values, audit) after putting audited fields back.

    ``current(key, field_name, value)`` long form, ``audit(entry_id, key, field_name,
    old_value)``, ``chosen(entry_id)``; of several entries for one field the smallest id
    counts. The change is audited as REVERT unless the value already stands.
    """
    back = first_per_key(audit.join(chosen, "entry_id", "left_semi"), [key, "field_name"], F.col("entry_id"))
    joined = current.join(back.select(key, "field_name", F.col("old_value").alias("back"), F.lit(True).alias("hit")), [key, "field_name"], "left")
    value = F.when(F.col("hit"), F.col("back")).otherwise(F.col("value"))
    log = joined.where(F.col("hit") & ~F.col("back").eqNullSafe(F.col("value")))
    return (
        joined.select(key, "field_name", value.alias("value")),
        log.select(key, "field_name", F.lit("REVERT").alias("action"), F.col("value").alias("old_value"), F.col("back").alias("new_value")),
    )


def get_or_create(dimension: DataFrame, staged: DataFrame, key: str, order: str) -> DataFrame:
    """Dimension with the keys it lacked; the first writer's attributes are kept."""
    new = first_per_key(staged, [key], F.col(order)).join(dimension, key, "left_anti")
    return dimension.unionByName(new.select(*dimension.columns))


def overwrite_facts(facts: DataFrame, staged: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write wins per key; all measures are overwritten, nulls too. Keys with nulls match."""
    last = first_per_key(staged, keys, F.desc(order))
    same = reduce(Column.__and__, [F.col(f"f.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    kept = facts.alias("f").join(last.select(*keys).alias("n"), same, "left_anti")
    return kept.unionByName(last.select(*facts.columns))


def link_changes(current: DataFrame, desired: DataFrame, keys: Sequence[str], scope: Column | None = None) -> DataFrame:
    """``keys, action``: links to INSERT and to DELETE; only current links in ``scope`` may go."""
    have, want = current.select(*keys).distinct(), desired.select(*keys).distinct()
    scoped = have.where(scope) if scope is not None else have
    add = want.alias("w").join(have.alias("h"), reduce(Column.__and__, [F.col(f"w.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]), "left_anti")
    gone = scoped.alias("h").join(want.alias("w"), reduce(Column.__and__, [F.col(f"h.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]), "left_anti")
    return add.withColumn("action", F.lit("INSERT")).unionByName(gone.withColumn("action", F.lit("DELETE")))


def feed_upsert(current: DataFrame, feed: DataFrame, raw: Sequence[str], key: str = "external_id") -> DataFrame:
    """Feed records over stored ones: raw columns are refreshed, a confirmed match and the
    first fetch date stay, the suggestion is renewed while unconfirmed. ``action`` tells
    created, updated, unchanged and kept (not in the feed)."""
    old = current.select(F.col(key).alias("old_key"), *[F.col(c).alias(f"old_{c}") for c in (*raw, "suggested_id", "project_id", "confirmed", "fetched")])
    both = feed.withColumn("has", F.lit(True)).join(old, F.col(key) == F.col("old_key"), "full_outer")
    has = F.coalesce("has", F.lit(False))
    confirmed = F.coalesce("old_confirmed", F.lit(False))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in raw])
    return both.select(
        F.coalesce(key, "old_key").alias(key),
        *[F.when(has, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in raw],
        F.when(confirmed | ~has, F.col("old_suggested_id")).otherwise(F.col("suggested_id")).alias("suggested_id"),
        F.col("old_project_id").alias("project_id"),
        confirmed.alias("confirmed"),
        F.coalesce("old_fetched", "fetched").alias("fetched"),
        F.when(F.col("old_key").isNull(), "created").when(~has, "kept").when(same, "unchanged").otherwise("updated").alias("action"),
    )


def replace_drafts(current: DataFrame, staged: DataFrame, year: int) -> DataFrame:
    """Drafts of the year make room for the staged rows; confirmed rows stay."""
    keep = (F.col("year") != year) | F.col("confirmed")
    return current.where(F.coalesce(keep, F.lit(True))).unionByName(staged.select(*current.columns))


def confirm_all(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, affected project ids): unconfirmed rows with a project become confirmed."""
    ready = F.col("project_id").isNotNull() & ~F.col("confirmed")
    return rows.withColumn("confirmed", F.col("confirmed") | F.col("project_id").isNotNull()), rows.where(ready).select("project_id").distinct()


def delete_import(budgets: DataFrame, links: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Budgets and year-scoped links without those of the year; permanent links stay."""
    return budgets.where(F.col("budget_year") != year), links.where(F.col("haushalt_year").isNull() | (F.col("haushalt_year") != year))


def patch(current: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``changes(key, patch map<string,string>)``: a field in the map is set, to null too; a
    field outside it stays. Values are cast to the field's type."""
    joined = current.join(changes.select(F.col(key).alias("patch_key"), "patch"), F.col(key) == F.col("patch_key"), "left")
    held = lambda f: F.coalesce(F.map_contains_key("patch", F.lit(f)), F.lit(False))
    kind = dict(current.dtypes)
    new = {f: F.when(held(f), F.try_element_at("patch", F.lit(f)).try_cast(kind[f])).otherwise(F.col(f)) for f in fields}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in current.columns])


def replace_children(parents: DataFrame, changes: DataFrame, children: DataFrame, new_children: DataFrame, key: str, fields: Sequence[str]):
    """(parents, children): scalars change only where the new one is not null; the children
    of every changed parent are replaced."""
    renamed = changes.select(F.col(key).alias("c_key"), *[F.col(f).alias(f"c_{f}") for f in fields])
    joined = parents.join(renamed, F.col(key) == F.col("c_key"), "left")
    out = joined.select(*[F.coalesce(f"c_{c}", c).alias(c) if c in fields else F.col(c) for c in parents.columns])
    kept = children.join(changes.select(key), key, "left_anti")
    return out, kept.unionByName(new_children.select(*children.columns))


def completion_time(old_status: Column, new_status: Column, completed_at: Column, now: Column, done: str = "DONE") -> Column:
    """Completion time after a status change: set on entering ``done``, cleared on leaving."""
    entered = (new_status == done) & (F.coalesce(old_status, F.lit("")) != done)
    return F.when(entered, now).when(new_status == done, completed_at)


def insert_idempotent(current: DataFrame, staged: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by content key: the stored one wins, else the first staged one."""
    new = first_per_key(staged, [key], F.col(order)).join(current, key, "left_anti")
    return current.unionByName(new.select(*current.columns))
