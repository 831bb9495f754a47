"""Text extraction over documents, pages and cells built from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackledger.functions import text as T
from trackledger.functions.names import normalize_name, pooled_agreement, vde_number
from trackledger.functions.tables import berlin_time, remaining_text, section_table, thousand_euro
from trackledger.lineage import cut
from trackledger.operators import imports, reports, views
from trackledger.plans.domain import read
from trackledger.plans.registry import query

C = F.col
NB = r"(^|[^\p{L}\p{N}_])"
NE = r"($|[^\p{L}\p{N}_])"


# -- pages and lines ---------------------------------------------------------------------------

HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"""
for _e, _p in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
    HTML = f"replace({HTML}, '{_e}', '{_p}')"
HTML = rf"regexp_replace(regexp_replace({HTML}, '[ \t]+', ' ', 'g'), '\n\s*\n\s*\n+', E'\n\n', 'g')"
HTML = rf"substr(regexp_replace({HTML}, '^\s+|\s+$', '', 'g'), 1, 12000)"


@query("f12_html_to_text", f"SELECT page_id, md5({HTML}) AS text_md5, length({HTML})::INTEGER AS n_chars FROM pages")
def f12(spark, d):
    t = T.html_to_text(C("html"))
    return read(spark, d, "pages").select("page_id", F.md5(t.cast("binary")).alias("text_md5"), F.length(t).alias("n_chars"))


def doc_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = """doc_lines AS (SELECT doc_id, (unnest(generate_series(0, len(l) - 1)))::INTEGER AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents) x)"""


@query("s04_line_range", f"WITH {LINES} SELECT doc_id, line_no, md5(line) AS line_md5 FROM doc_lines WHERE line_no BETWEEN 2 AND 4")
def s04(spark, d):
    return doc_lines(spark, d).where(C("line_no").between(2, 4)).select("doc_id", "line_no", F.md5(C("line").cast("binary")).alias("line_md5"))


def _flag(sql_pattern: str) -> str:
    return f"regexp_matches(text, '{sql_pattern}')"


PLANNING_SQL = _flag(f"(?i){NB}(Planung|planfestgestellt|Planfeststellungsverfahren|Entwurfsplanung|offen){NE}")
BUILDING_SQL = _flag(rf"(?i){NB}(Bau|Baubeginn|im\s+Bau|Bauarbeiten|Baumaßnahmen){NE}")
COMPLETED_SQL = _flag(rf"(?i){NB}(abgeschlossen|in\s+Betrieb|fertiggestellt|Inbetriebnahme\s+erfolgte|wurde\s+in\s+Betrieb|Vorhaben\s+ist\s+abgeschlossen|Inbetriebnahme:\s*\d|Inbetriebnahme\s+\d\d/\d\d\d\d){NE}")
STATUS_WORDS = ("in Planung", "offenbar", "Neubau ist offen", "im Bau.", "Baubeginn 2024", "abgeschlossen", "in  Betrieb genommen", "Inbetriebnahme: 2", "planfestgestellt und fertiggestellt", "")
STATUS_TEXT_SQL = "text || ' ' || [" + ", ".join(f"'{w}'" for w in STATUS_WORDS) + "][(doc_id % 10 + 1)::BIGINT]"


def status_text():
    return F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, STATUS_WORDS)), (C("doc_id") % 10 + 1).cast("int")))


@query("f29_status_flags", f"SELECT doc_id, {PLANNING_SQL} AS status_planung, {BUILDING_SQL} AS status_bau, {COMPLETED_SQL} AS status_abgeschlossen FROM (SELECT doc_id, {STATUS_TEXT_SQL} AS text FROM documents) x")
def f29(spark, d):
    return read(spark, d, "documents").select("doc_id", *T.status_flags(status_text()))


@query(
    "w06_assembly",
    f"""WITH {LINES}, parts AS (SELECT *, sum(CASE WHEN line_no % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM doc_lines)
      SELECT doc_id, part::BIGINT AS part, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, min(line_no) AS first_line FROM parts GROUP BY 1, 2""",
)
def w06(spark, d):
    rows = views.assemble(doc_lines(spark, d), ["doc_id"], "line_no", C("line_no") % 5 == 0)
    return rows.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.min("line_no").alias("first_line"))


@query(
    "w07_blocks",
    f"""WITH {LINES}, heads AS (SELECT doc_id, line_no, line, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM doc_lines WHERE line_no % 5 = 0)
      SELECT h.doc_id, h.line_no, md5(h.line) AS heading_md5, count(b.line_no) AS n_body, md5(coalesce(string_agg(b.line, E'\\n' ORDER BY b.line_no), '')) AS body_md5
      FROM heads h LEFT JOIN doc_lines b ON b.doc_id = h.doc_id AND b.line_no > h.line_no AND (h.next IS NULL OR b.line_no < h.next) GROUP BY 1, 2, 3""",
)
def w07(spark, d):
    rows = views.assemble(doc_lines(spark, d), ["doc_id"], "line_no", C("line_no") % 5 == 0)
    heading = F.min_by("line", "line_no")
    body = F.array_sort(F.collect_list(F.when(C("line_no") % 5 != 0, F.struct("line_no", "line"))))
    g = rows.groupBy("doc_id", "part").agg(F.min("line_no").alias("line_no"), heading.alias("h"), body.alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["line"]), "\n")
    return g.select("doc_id", "line_no", F.md5(C("h").cast("binary")).alias("heading_md5"), F.size("b").cast("long").alias("n_body"), F.md5(text.cast("binary")).alias("body_md5"))


@query(
    "w08_label_slices",
    """WITH hits AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next, text FROM (
         SELECT doc_id, text, unnest(list_filter(generate_series(1, length(text) - 3), lambda i: substr(text, i, 4) = 'the ')) AS p FROM documents a) b)
       SELECT doc_id, p::INTEGER AS pos, coalesce(next - p, length(text) - p + 1)::INTEGER AS n_chars, md5(substr(text, p, coalesce(next - p, length(text) - p + 1))) AS slice_md5 FROM hits""",
)
def w08(spark, d):
    """A text is cut once; what is shuffled is its slices, not the text for each of them."""
    docs = read(spark, d, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # a number per text, before it is cut
    rows = docs.select("doc_id", "row", F.posexplode(F.split("text", "the ")).alias("i", "part")).repartition("doc_id")  # no occurrence overlaps another
    above = W.partitionBy("doc_id", "row").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    pos = (F.sum(F.length("part") + 4).over(above) - F.length("part") - 7).cast("int")
    hits = rows.withColumn("pos", pos).where("i > 0").select("doc_id", "pos", F.concat(F.lit("the "), "part").alias("slice"))
    nxt = F.lead("pos").over(W.partitionBy("doc_id").orderBy("pos"))
    hits = hits.withColumn("n_chars", F.coalesce(nxt - C("pos"), F.length("slice")))
    return hits.select("doc_id", "pos", "n_chars", F.md5(F.substr("slice", F.lit(1), C("n_chars")).cast("binary")).alias("slice_md5"))


# -- scanned pages ---------------------------------------------------------------------------------


def scanned(spark, d):
    o = C("o_orderkey")
    name = F.concat(F.lit("tbl-"), (o % 3).cast("string"), F.lit(".md"))
    return read(spark, d, "orders").select(
        o.alias("page"),
        F.concat(C("o_orderpriority"), F.lit(" ["), name, F.lit("]("), name, F.lit(") ![img-0.jpeg](img-0.jpeg) end ")).alias("markdown"),
        F.array(F.struct(name.alias("id"), F.concat(F.lit("|"), C("o_orderstatus"), F.lit("|")).alias("content"))).alias("tables"),
        F.when(o % 2 == 0, F.lit("Kopf")).otherwise(" ").alias("header"),
        F.when(o % 5 == 0, F.lit("Fuß")).alias("footer"),
        F.array(
            F.struct(F.concat(F.lit("img-"), C("o_custkey").cast("string")).alias("id"), F.when(o % 3 == 0, F.base64(F.encode("o_orderpriority", "UTF-8"))).alias("image_base64")),
            F.struct(F.lit("b").alias("id"), F.when(C("o_orderstatus") == "F", F.base64(F.encode("o_orderstatus", "UTF-8"))).otherwise("").alias("image_base64")),
        ).alias("images"),
    )


@query(
    "s05_page_text",
    """SELECT o_orderkey AS page, CASE WHEN o_orderkey % 2 = 0 THEN E'Kopf\n\n' ELSE '' END || o_orderpriority || ' |' || o_orderstatus || '|  end'
      || CASE WHEN o_orderkey % 5 = 0 THEN E'\n\nFuß' ELSE '' END AS text FROM orders""",
)
def s05(spark, d):
    return scanned(spark, d).select("page", T.page_to_text(C("markdown"), C("tables"), C("header"), C("footer")).alias("text"))


@query(
    "s06_page_images",
    """SELECT o_orderkey AS page, 'img-' || o_custkey AS image_id, o_orderpriority AS content FROM orders WHERE o_orderkey % 3 = 0
      UNION ALL SELECT o_orderkey, 'b', o_orderstatus FROM orders WHERE o_orderstatus = 'F'""",
)
def s06(spark, d):
    rows = scanned(spark, d).select("page", F.explode("images").alias("i"))
    kept = rows.where(F.coalesce(C("i.image_base64") != "", F.lit(False)))
    return kept.select("page", C("i.id").alias("image_id"), F.decode(F.unbase64("i.image_base64"), "UTF-8").alias("content"))


# -- numbers, cells and names -------------------------------------------------------------------------

THOUSANDS = "regexp_replace(({n})::VARCHAR, '(\\d)(\\d\\d\\d)$', '\\1.\\2')"


def dotted(n):
    return F.regexp_replace(n.cast("string"), r"(\d)(\d\d\d)$", "$1.$2")


@query(
    "f16_parse_int",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'k. A.' WHEN o_orderkey % 5 = 0 THEN '1,5' ELSE ' ' || {THOUSANDS.format(n='o_custkey * 3')} END AS cell, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 15 ELSE o_custkey * 3 END::INTEGER AS value FROM orders",
)
def f16(spark, d):
    k = C("o_orderkey")
    cell = F.when(k % 7 == 0, "k. A.").when(k % 5 == 0, "1,5").otherwise(F.concat(F.lit(" "), dotted(C("o_custkey") * 3)))
    return read(spark, d, "orders").select("o_orderkey", cell.alias("cell"), T.parse_int(cell).alias("value"))


@query(
    "f17_parse_float",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_custkey % 100) + 0.5::DOUBLE END AS value FROM orders",
)
def f17(spark, d):
    k = C("o_orderkey")
    cell = F.when(k % 4 == 0, "1.234,5 %").otherwise(F.concat((C("o_custkey") % 100).cast("string"), F.lit(",5 %")))
    return read(spark, d, "orders").select("o_orderkey", T.parse_float(cell).alias("value"))


@query(
    "f18_parse_float_de",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1234.5::DOUBLE WHEN o_orderkey % 4 = 1 THEN NULL ELSE (o_custkey % 100) + 0.25::DOUBLE END AS value FROM orders",
)
def f18(spark, d):
    k = C("o_orderkey")
    cell = F.when(k % 4 == 0, "1.234,5 ").when(k % 4 == 1, "offen").otherwise(F.concat((C("o_custkey") % 100).cast("string"), F.lit(",25")))
    return read(spark, d, "orders").select("o_orderkey", T.parse_float_de(cell).alias("value"))


@query("f19_nth_line", "SELECT o_orderkey, o_orderpriority AS first, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS second FROM orders")
def f19(spark, d):
    cell = F.concat(F.lit("\n  "), C("o_orderpriority"), F.lit(" \n \n"), F.when(C("o_orderkey") % 2 == 0, C("o_orderstatus")).otherwise(""))
    return read(spark, d, "orders").select("o_orderkey", T.nth_line(cell, 0).alias("first"), T.nth_line(cell, 1).alias("second"))


@query(
    "f20_combined_id",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN 'YYY' WHEN 5 THEN NULL ELSE 'B' || o_custkey END AS lfd_nr,
      CASE WHEN o_orderkey % 6 IN (0, 1, 3) THEN o_orderkey % 900 END::INTEGER AS finve_nr, CASE o_orderkey % 6 WHEN 0 THEN 'N 07' WHEN 4 THEN 'L 06' END AS plan_nr FROM orders""",
)
def f20(spark, d):
    k = C("o_orderkey")
    b, n = F.concat(F.lit("B"), C("o_custkey").cast("string")), (k % 900).cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(b, F.lit("  "), n, F.lit(" N 07"))).when(k % 6 == 1, F.concat(b, F.lit(" "), n, F.lit(" –"))).when(k % 6 == 2, b)
        .when(k % 6 == 3, F.concat(F.lit("YYY "), n)).when(k % 6 == 4, F.concat(b, F.lit(" L 06"))).otherwise("Summe")
    )
    return read(spark, d, "orders").select("o_orderkey", T.combined_id(text).alias("i")).select("o_orderkey", "i.lfd_nr", "i.finve_nr", "i.plan_nr")


def budget_cells():
    """Ten kinds of table rows, chosen by the order key; sixteen cells each."""
    k, n = C("o_orderkey"), C("o_custkey").cast("string")
    amounts = F.concat(dotted(C("o_custkey") * 3), F.lit("\n"), n, F.lit("\n7"))
    blank = F.lit("")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    chapter, priority = (k % 90 + 1200).cast("string"), C("o_orderpriority")
    name = (
        F.when(k % 10 == 0, text("ABS ", priority, "\ndavon:\nKap. 1202, Titel 891 ", n, "\nKap. ", chapter, " Titel 892 02\nSumme"))
        .when(k % 10 == 1, text("Erläuterung:\n– Strecke ", n, "\nmit Tunnel\n- BÜ\n-\u00a0Strecke ", priority)).when(k % 10 == 2, text("nachrichtlich: ", priority, "\nnachrichtlich: Eigenmittel"))
        .when(k % 10 == 3, text("Kap. 1202 Titel 891 ", n)).when(k % 10 == 4, "– Strecke C").when(k % 10 == 5, "Name").when(k % 10 == 6, "FinVe Nr.").when(k % 10 == 7, "4")
        .when(k % 10 == 8, text("\tNBS ", n, "\nUnterlagen entsprechend § 24")).otherwise("Rest")
    )
    first = F.when(k % 10 == 0, text("\u00a0B1 ", (k % 900).cast("string"), " N1")).when(k % 10 == 5, "B0134 L 06").when(k % 10 == 7, "1").otherwise("")
    second = F.when(k % 10 == 8, dotted(k % 900 + 1000)).otherwise("")
    return F.array(first, second, blank, name, *[blank] * 2, amounts, amounts, *[blank] * 3, amounts, amounts, amounts, amounts, amounts)


KIND_SQL = "['main', 'explanation', 'memo', 'title', 'continuation', 'unnumbered', 'header', 'numbers', 'main', 'other'][(o_orderkey % 10 + 1)::BIGINT]"


@query("f21_row_kind", f"SELECT o_orderkey, {KIND_SQL} AS kind FROM orders")
def f21(spark, d):
    return read(spark, d, "orders").select("o_orderkey", T.row_kind(budget_cells()).alias("kind"))


def of_kind(spark, d, *kinds):
    """Rows of the budget table that the classifier takes for one of the kinds."""
    return read(spark, d, "orders").where(T.row_kind(budget_cells()).isin(*kinds))


@query("f22_project_name", "SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'ABS ' || o_orderpriority WHEN 5 THEN 'Name' ELSE 'NBS ' || o_custkey END AS name FROM orders WHERE o_orderkey % 10 IN (0, 5, 8)")
def f22(spark, d):
    return of_kind(spark, d, "main", "unnumbered").select("o_orderkey", T.project_name(budget_cells()[3]).alias("name"))


@query("f23_bullet_items", "SELECT o_orderkey, 'Strecke ' || o_custkey || ' mit Tunnel|Strecke ' || o_orderpriority AS items FROM orders WHERE o_orderkey % 10 = 1")
def f23(spark, d):
    return of_kind(spark, d, "explanation").select("o_orderkey", F.array_join(T.bullet_items(budget_cells()[3]), "|").alias("items"))


def exploded(rows, entries):
    return rows.select("o_orderkey", F.posexplode(entries).alias("pos", "e")).select("o_orderkey", "pos", "e.titel_key", "e.kapitel", "e.label", "e.cost_estimate_last_year", "e.vorhalten_future")


@query(
    "f24_inline_titles",
    """SELECT o_orderkey, 0 AS pos, '891_' || o_custkey AS titel_key, '1202' AS kapitel, 'Kap. 1202, Titel 891 ' || o_custkey AS label, o_custkey::INTEGER AS cost_estimate_last_year, o_custkey::INTEGER AS vorhalten_future FROM orders WHERE o_orderkey % 10 = 0
      UNION ALL SELECT o_orderkey, 1, '892_02', (o_orderkey % 90 + 1200)::VARCHAR, 'Kap. ' || (o_orderkey % 90 + 1200) || ', Titel 892 02', 7, 7 FROM orders WHERE o_orderkey % 10 = 0""",
)
def f24(spark, d):
    return exploded(of_kind(spark, d, "main"), T.inline_titles(budget_cells()))


@query(
    "f25_memo_titles",
    """SELECT o_orderkey, 0 AS pos, 'nachrichtlich: ' || o_orderpriority AS titel_key, '' AS kapitel, 'nachrichtlich: ' || o_orderpriority AS label, (o_custkey * 3)::INTEGER AS cost_estimate_last_year, (o_custkey * 3)::INTEGER AS vorhalten_future FROM orders WHERE o_orderkey % 10 = 2
      UNION ALL SELECT o_orderkey, 1, 'nachrichtlich: Eigenmittel', '', 'nachrichtlich: Eigenmittel', o_custkey::INTEGER, o_custkey::INTEGER FROM orders WHERE o_orderkey % 10 = 2""",
)
def f25(spark, d):
    return exploded(of_kind(spark, d, "memo"), T.memo_titles(budget_cells()))


@query(
    "f26_title_row",
    """SELECT o_orderkey, '891_' || o_custkey AS titel_key, '1202' AS kapitel, regexp_extract('891 ' || o_custkey || ' ' || regexp_replace((o_custkey * 3)::VARCHAR, '(\\d)(\\d\\d\\d)$', '\\1.\\2'), '^([\\d ]+)', 1) AS titel_nr,
      'Kap. 1202 Titel 891 ' || o_custkey AS label, (o_custkey * 3)::INTEGER AS veranschlagt FROM orders WHERE o_orderkey % 10 = 3""",
)
def f26(spark, d):
    rows = of_kind(spark, d, "title").select("o_orderkey", T.title_row(budget_cells()).alias("t"))
    return rows.select("o_orderkey", "t.titel_key", "t.kapitel", "t.titel_nr", "t.label", "t.veranschlagt")


@query(
    "f27_orphan_recovery",
    "SELECT s_suppkey, s_suppkey::INTEGER AS finve_nr FROM supplier",
)
def f27(spark, d):
    s = read(spark, d, "supplier")
    page = F.concat(F.lit("Kopf\nYYY  "), C("s_suppkey").cast("string"), F.lit(" SAMMELVEREINBARUNGEN SV Lph. 1/2 "), C("s_name"), F.lit(" 2012 4.000\nYYY 1 ohne Jahr"))
    found = s.select("s_suppkey", F.explode(T.orphan_names(page)).alias("f"))
    names = s.select(F.lower(F.concat(F.lit("SV Lph. 1/2 "), C("s_name"))).alias("name"))
    last = found.select("s_suppkey", F.regexp_replace("f.name", "^sammelvereinbarungen ", "").alias("name"), "f.finve_nr")
    return last.join(names, "name", "left_semi").select("s_suppkey", "finve_nr")


@query("f28_pooled_name", "SELECT s_suppkey, s_suppkey % 3 <> 2 AS pooled FROM supplier")
def f28(spark, d):
    k = C("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Die SV "), C("s_name"))).when(k % 3 == 1, "sammelfinanzierungsvereinbarung 7").otherwise("SVB Strecke")
    return read(spark, d, "supplier").select("s_suppkey", pooled_agreement(name).alias("pooled"))


# -- report text ---------------------------------------------------------------------------------------


@query(
    "f30_body_lines",
    f"WITH {LINES} SELECT doc_id, count(*) AS n_body FROM doc_lines WHERE NOT regexp_matches(line || CASE WHEN line_no % 4 = 0 THEN ' . . . 7' ELSE '' END, '\\.\\s\\.') GROUP BY 1",
)
def f30(spark, d):
    rows = doc_lines(spark, d)
    line = F.concat("line", F.when(C("line_no") % 4 == 0, " . . . 7").otherwise(""))
    return rows.where(F.size(T.body_lines(line)) > 0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_body"))


@query(
    "f31_contents",
    "SELECT p_partkey, 'B.4.' || (p_partkey % 3 + 1) || '.' || p_partkey AS section, 'Lfd. Nr. ' || p_name AS name FROM part WHERE p_partkey % 5 <> 0",
)
def f31(spark, d):
    k = C("p_partkey")
    head = F.when(k % 2 == 0, "B 4.").otherwise("B.4.")
    line = F.concat(head, (k % 3 + 1).cast("string"), F.lit("."), k.cast("string"), F.lit("  L fd. Nr. "), C("p_name"), F.lit(" . . . . "), (k % 99).cast("string"))
    line = F.when(k % 5 == 0, F.lit("Seite 7")).otherwise(line)
    e = T.contents_entry(line)
    return read(spark, d, "part").select("p_partkey", e.alias("e")).where("e is not null").select("p_partkey", "e.section", "e.name")


@query("f32_category", "SELECT p_partkey, ['laufend', 'neu', 'potentiell', 'abgeschlossen'][(p_partkey % 4 + 1)::BIGINT] AS category, p_partkey::VARCHAR AS lfd_nr FROM part")
def f32(spark, d):
    section = F.concat(F.lit("B.4."), (C("p_partkey") % 4 + 1).cast("string"), F.lit("."), C("p_partkey").cast("string"))
    return read(spark, d, "part").select("p_partkey", T.section_category(section).alias("category"), T.section_number(section).alias("lfd_nr"))


@query("f35_tidy_none", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Keine' WHEN 1 THEN o_orderpriority ELSE 'Keine Angabe' END AS text FROM orders")
def f35(spark, d):
    k = C("o_orderkey")
    t = F.when(k % 3 == 0, " – keine,.").when(k % 3 == 1, C("o_orderpriority")).otherwise("Keine Angabe")
    return read(spark, d, "orders").select("o_orderkey", T.tidy_none(t).alias("text"))


@query(
    "f37_key_figures",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size + 1000.5::DOUBLE END AS strecklaenge, CASE WHEN p_partkey % 2 = 0 THEN '160/200' END AS geschwindigkeit, (p_size * 2)::DOUBLE AS gesamtkosten FROM part",
)
def f37(spark, d):
    k = C("p_partkey")
    text = F.concat(
        F.when(k % 3 != 0, F.concat(F.when(k % 3 == 1, "STRECKENLÄNGE: rd. ").otherwise("Streckenlänge: rd. "), dotted(C("p_size") + 1000), F.lit(",5 km\n"))).otherwise(""),
        F.when(k % 2 == 0, "Geschwindigkeit 160/200 km/h\n").otherwise(""),
        F.lit("Gesamtkosten "), (C("p_size") * 2).cast("string"), F.lit(" Mio. EUR"),
    )
    return read(spark, d, "part").select("p_partkey", *T.key_figures(text))


@query(
    "f38_consolidated",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat_ws(E'\\n\\n', o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END) ELSE o_orderpriority END AS text FROM orders",
)
def f38(spark, d):
    k = C("o_orderkey")
    other = F.when(k % 3 == 0, C("o_orderstatus"))
    return read(spark, d, "orders").select("o_orderkey", F.when(k % 2 == 0, F.concat_ws("\n\n", "o_orderpriority", other)).otherwise(C("o_orderpriority")).alias("text"))


@query("f39_two_columns", "SELECT l_orderkey, avg(CASE WHEN l_quantity * 10 > 260 THEN 1.0::DOUBLE ELSE 0 END) >= 0.15 AS two_columns FROM lineitem GROUP BY 1")
def f39(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(C("l_quantity") * 10).alias("x0"))
    return g.select("l_orderkey", T.two_columns(C("x0")).alias("two_columns"))


@query(
    "f39_reading_order",
    """WITH w AS (SELECT l_orderkey, l_partkey, l_quantity * 10 AS x0, l_linenumber * 2.5 + l_suppkey % 3 AS top FROM lineitem),
      t AS (SELECT l_orderkey, avg(CASE WHEN x0 > 260 THEN 1.0::DOUBLE ELSE 0 END) >= 0.15 AS two FROM w GROUP BY 1),
      p AS (SELECT w.*, CASE WHEN two AND x0 > 260 THEN 1 ELSE 0 END AS col, round_even(top / 3, 0) AS line FROM w JOIN t USING (l_orderkey)),
      l AS (SELECT l_orderkey, col, line, string_agg(l_partkey::VARCHAR, ' ' ORDER BY x0, l_partkey) AS text FROM p GROUP BY 1, 2, 3)
      SELECT l_orderkey, CASE WHEN min(col) = 1 THEN E'\\n' ELSE '' END || string_agg(text, E'\\n' ORDER BY col, line) AS text FROM l GROUP BY 1""",
)
def f39_order(spark, d):
    """The parts of an order as words of a page, quantities across and line numbers down."""
    word = F.struct((C("l_quantity") * 10).alias("x0"), (C("l_linenumber") * 2.5 + C("l_suppkey") % 3).alias("top"), C("l_partkey").cast("string").alias("text"))
    pages = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", word.alias("w")))).alias("w"))
    return pages.select("l_orderkey", T.reading_order(F.transform("w", lambda x: x["w"])).alias("text"))


@query(
    "f40_model_merge",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'neu' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 12.5::DOUBLE ELSE o_totalprice END AS cost, o_orderkey % 4 <> 0 AS flag, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN o_orderstatus ELSE '- Teil ' || o_custkey END AS openings FROM orders",
)
def f40(spark, d):
    k = C("o_orderkey")
    ai = F.concat(F.lit('{"text":'), F.when(k % 2 == 0, '"neu"').otherwise("null"), F.lit(',"cost":'), F.when(k % 3 == 0, '"12.5"').otherwise('"unklar"'), F.lit("}"))
    got = F.from_json(ai, "text string, cost string")
    truth = F.when(k % 4 == 0, "0").when(k % 4 == 1, '"false"').otherwise("true")
    return read(spark, d, "orders").select(
        "o_orderkey", T.merge_value(got["text"], C("o_orderpriority")).alias("text"), T.merge_value(got["cost"].try_cast("double"), C("o_totalprice")).alias("cost"), T.python_truth(truth).alias("flag"),
        T.merge_openings(F.when(k % 5 == 0, F.when(k % 2 == 0, " - Keine.").otherwise("– keine")).when(k % 5 != 1, F.concat(F.lit("- Teil "), C("o_custkey").cast("string"))), C("o_orderstatus")).alias("openings"),
    )


@query(
    "f53_paper_metadata",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '20/' || o_orderkey END AS paper, strftime(o_orderdate, '%Y-%m-%d') AS report_date FROM orders",
)
def f53(spark, d):
    k = C("o_orderkey")
    text = F.concat(F.lit("Deutscher Bundestag "), F.when(k % 2 == 0, F.concat(F.lit("drucksache  20/"), k.cast("string"))).otherwise(""), F.lit(" vom "), F.date_format("o_orderdate", "dd.MM.yyyy"))
    return read(spark, d, "orders").select("o_orderkey", T.paper_number(text).alias("paper"), T.report_date(text).alias("report_date"))


# -- names -----------------------------------------------------------------------------------------------


@query(
    "f13_normalised",
    r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name) || '  (sued)', '[/\-–—,;:()\[\].]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part",
)
def f13(spark, d):
    name = F.concat(F.when(C("p_partkey") % 2 == 0, "ABS/NBS ").otherwise("neu-"), C("p_name"), F.lit("  (SUED)"))
    return read(spark, d, "part").select("p_partkey", normalize_name(name).alias("name"))


@query("f15_vde_number", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '8.1b' END AS vde FROM part")
def f15(spark, d):
    k = C("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Strecke (VDE Nr. "), C("p_size").cast("string"), F.lit(")"))).when(k % 3 == 1, "vde 8.1b").otherwise("XVDE 3")
    return read(spark, d, "part").select("p_partkey", vde_number(name).alias("vde"))


# -- whole reports ------------------------------------------------------------------------------------


def order_reports(spark, d):
    """A report per customer with an entry per order: paper number, contents, body, next part."""
    k = C("o_orderkey")
    n, third = k.cast("string"), (k % 3 + 1).cast("string")
    number = F.concat(F.when(k % 3 == 0, "B.4.").when(k % 3 == 1, "B 4.").otherwise("## B.4."), third, F.lit("."), n)
    head = F.concat(number, F.lit("  ABS "), C("o_orderpriority"), F.when(k % 2 == 1, "  Projektstand  alt").otherwise(""), F.lit("\n"))
    goal = F.when(k % 5 == 0, " – keine, ").otherwise(F.concat(F.lit("Ziel "), n))
    state = F.element_at(F.array(*map(F.lit, REPORT_STATES)), (k % 4 + 1).cast("int"))
    table = F.concat(F.lit("Nr. PFA | Örtlichkeit\n| 1 | Ort "), C("o_orderstatus"), F.lit(" | offen | | | | 2030 |\nzwei\n| Gruppe |\n"))
    block = F.concat(
        head, F.lit("Fußnote 7\nVerkehrliche Zielsetzung\n"), goal, F.lit("\nDurchgeführte Maßnahmen\nTeil "), C("o_orderstatus"), F.lit("\n\nTeil\nPlanungsstand\n"), state, F.lit("\n"),
        F.when(k % 7 == 0, table).otherwise(""), F.lit("Projektkenndaten\nStreckenlänge rund 1."), (k % 900 + 100).cast("string"), F.lit(",5 km\nGesamtkosten "), n, F.lit(" Mio. €\nDrucksache 20/1\n"),
    )
    listed = F.when(k % 2 == 0, F.concat(F.lit("B 4."), third, F.lit("."), n, F.lit(" L fd. Nr. "), n, F.lit(" . . . . 56\n"))).otherwise("")
    entry = F.struct(k.alias("k"), listed.alias("listed"), block.alias("block"))
    g = read(spark, d, "orders").groupBy(C("o_custkey").alias("report_id")).agg(F.array_sort(F.collect_list(entry)).alias("x"))
    lines = lambda part: F.array_join(F.transform("x", lambda e: e[part]), "")
    text = F.concat(F.lit("Inhalt\nB Schienenwege . . . 43\n"), lines("listed"), F.lit("C Bundesfernstraßen . . . 90\nB Schienenwege\n"), lines("block"), F.lit("C Bundesfernstraßen\nB.4.1.1 Straße\n"))
    return g.select("report_id", text.alias("text"))


REPORT_STATES = ("Im Bau.", "Vorhaben ist abgeschlossen", "In Planung, abgeschlossen", "läuft")


@query(
    "w07_report_entries",
    """WITH o AS (SELECT *, o_orderkey AS k, o_orderkey::VARCHAR AS n, ['Im Bau.', 'Vorhaben ist abgeschlossen', 'In Planung, abgeschlossen', 'läuft'][(o_orderkey % 4 + 1)::BIGINT] AS state,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Keine' ELSE 'Ziel ' || o_orderkey END AS goal, 'Teil ' || o_orderstatus || E'\n\nTeil' AS work FROM orders),
      f AS (SELECT *, k % 7 = 0 OR k % 4 = 2 AS planning, k % 4 = 0 AS building, k % 7 = 0 OR k % 4 IN (1, 2) AS completed FROM o),
      g AS (SELECT *, completed AND NOT planning AND NOT building AS only_done FROM f)
      SELECT o_custkey AS report_id, row_number() OVER (PARTITION BY o_custkey ORDER BY k) - 1 AS seq, 'B.4.' || (k % 3 + 1) || '.' || n AS vib_section, n AS vib_lfd_nr,
        CASE WHEN k % 2 = 0 THEN 'Lfd. Nr. ' || n ELSE 'ABS ' || o_orderpriority END AS vib_name_raw, ['laufend', 'neu', 'potentiell'][(k % 3 + 1)::BIGINT] AS category,
        CASE WHEN NOT only_done THEN goal END AS verkehrliche_zielsetzung,
        CASE WHEN only_done THEN goal || E'\n\n' || work || E'\n\n' || state || E'\n\nFußnote 7' WHEN completed THEN work || E'\n\n' || state ELSE work END AS durchgefuehrte_massnahmen,
        state AS planungsstand, (1000 + k % 900 + 100 + 0.5)::DOUBLE AS strecklaenge, k::DOUBLE AS gesamtkosten, planning AS status_planung, building AS status_bau, completed AS status_abgeschlossen,
        CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS n_sections, CASE WHEN k % 7 = 0 THEN 'Ort ' || o_orderstatus END AS place, CASE WHEN k % 7 = 0 THEN '| 1 | Ort ' || o_orderstatus || ' | offen | | | | 2030 |' END AS table_raw,
        CASE WHEN NOT only_done THEN 'Fußnote 7' END AS sonstiges FROM g""",
)
def w07_entries(spark, d):
    e = reports.report_entries(order_reports(spark, d))
    return e.select(
        "report_id", C("seq").cast("long").alias("seq"), "vib_section", "vib_lfd_nr", "vib_name_raw", "category", "verkehrliche_zielsetzung", "durchgefuehrte_massnahmen", "planungsstand", "strecklaenge",
        "gesamtkosten", "status_planung", "status_bau", "status_abgeschlossen", F.size("pfa_entries").alias("n_sections"), F.get("pfa_entries", F.lit(0))["oertlichkeit"].alias("place"),
        C("pfa_raw_markdown").alias("table_raw"), "sonstiges",
    )


# -- section tables ---------------------------------------------------------------------------------


def section_block(spark, d):
    """A pipe table per order: head, rule, group line, numbered row, row that inherits."""
    k = C("o_orderkey").cast("string")
    block = F.concat(
        F.lit("1. Baustufe Nord\n| Nr. PFA | Örtlichkeit | Entwurfsplanung | Abschluss | PFB | Bau | Betrieb |\n|---|---|---|---|---|---|---|\n| "), k,
        F.lit(" | Ort A | offen | - | 12/2020 | "), F.date_format("o_orderdate", "MM/yyyy"), F.lit(" | – |\n| | Ort B | | | | | 2030 |\n| Gruppe ("), C("o_orderstatus"),
        F.lit(") | | | | | | |\n| 7.1 | Ort C | abgeschlossen | | | | |"),
    )
    return read(spark, d, "orders").select("o_orderkey", block.alias("block"))


@query(
    "f33_section_table",
    """SELECT o_orderkey, pos, label, nr, ort, status, pfb, bau, betrieb FROM (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%m/%Y') AS m FROM orders) o,
      LATERAL (VALUES (0, '1. Baustufe Nord', o_orderkey::VARCHAR, 'Ort A', 'offen', '12/2020', m, NULL), (1, '1. Baustufe Nord', o_orderkey::VARCHAR, 'Ort B', NULL, NULL, NULL, '2030'),
        (2, 'Gruppe (' || o_orderstatus || ')', '7.1', 'Ort C', 'abgeschlossen', NULL, NULL, NULL)) v(pos, label, nr, ort, status, pfb, bau, betrieb)""",
)
def f33(spark, d):
    rows = section_block(spark, d).select("o_orderkey", F.posexplode(section_table(C("block"))).alias("pos", "s"))
    return rows.select(
        "o_orderkey", "pos", C("s.abschnitt_label").alias("label"), C("s.nr_pfa").alias("nr"), C("s.oertlichkeit").alias("ort"), C("s.entwurfsplanung").alias("status"),
        C("s.datum_pfb").alias("pfb"), C("s.baubeginn").alias("bau"), C("s.inbetriebnahme").alias("betrieb"),
    )


@query(
    "f34_plain_table",
    """SELECT o_orderkey, pos, nr, ort, status, finve, pfb FROM (SELECT * FROM orders) o,
      LATERAL (VALUES (0, o_orderkey || '.1', 'Ort A Nord', 'offen', '2020', '2021'), (1, '2', 'Ort B', 'abgeschlossen', NULL, NULL)) v(pos, nr, ort, status, finve, pfb)""",
)
def f34(spark, d):
    k = C("o_orderkey").cast("string")
    block = F.concat(F.lit("Nr. PFA Örtlichkeit\n2. Ausbaustufe\n"), k, F.lit(".1 Ort A\nNord offen 2020 2021\n2 Ort B abgeschlossen\nFußnote"))
    rows = read(spark, d, "orders").select("o_orderkey", F.posexplode(section_table(block)).alias("pos", "s"))
    return rows.select(
        "o_orderkey", "pos", C("s.nr_pfa").alias("nr"), C("s.oertlichkeit").alias("ort"), C("s.entwurfsplanung").alias("status"), C("s.abschluss_finve").alias("finve"), C("s.datum_pfb").alias("pfb")
    )


@query("f36_leftover", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority || E'\\n\\nx' ELSE 'x' END AS rest FROM orders")
def f36(spark, d):
    first = F.when(C("o_orderkey") % 2 == 0, C("o_orderpriority")).otherwise("")
    text = F.concat(F.lit("# B.4.1.3 ABS\n"), first, F.lit("\n\n\n\nVerkehrliche Zielsetzung\nused part\nTermine:\nx\nDrucksache 20/1"))
    return read(spark, d, "orders").select("o_orderkey", remaining_text(text, F.array(F.lit("used part"), F.lit(""))).alias("rest"))


@query("f48_thousand_euro", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN '0 T€' ELSE replace(format('{:,}', o_custkey * 1234), ',', '.') || ' T€' END AS text FROM orders")
def f48(spark, d):
    amount = F.when(C("o_custkey") % 7 == 0, 0).otherwise(C("o_custkey") * 1234)
    return read(spark, d, "orders").select("o_orderkey", thousand_euro(amount).alias("text"))


@query("f49_berlin_time", "SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%d.%m.%Y, %H:%M') AS text FROM events")
def f49(spark, d):
    return read(spark, d, "events").select("event_id", berlin_time(C("ts").cast("timestamp")).alias("text"))


# -- a whole report -----------------------------------------------------------------------------------


def report_rows(spark, d):
    """Orders as table rows of seven files; every second agreement of the old layout is pooled."""
    k = C("o_orderkey")
    cells = budget_cells()
    pooled = F.transform(cells, lambda c, i: F.when((i == 3) & (k % 20 == 8), "SV Lph. 1/2 Y").otherwise(c))
    rows = read(spark, d, "orders").select(F.concat(F.lit("f"), (C("o_custkey") % 7).cast("string")).alias("path"), k.alias("row_no"), pooled.alias("cells"))
    return cut(rows)  # as rows come from a table: the made-up cells are not computed again and again


REPORT = """rows AS (SELECT 'f' || (o_custkey % 7) AS path, o_orderkey AS k, o_custkey AS c, o_orderpriority AS pr, o_orderkey % 10 AS m FROM orders),
heads AS (SELECT path, min(k) AS h FROM rows WHERE m = 6 GROUP BY 1),
body AS (SELECT r.*, sum(CASE WHEN m IN (0, 5, 8) THEN 1 ELSE 0 END) OVER (PARTITION BY r.path ORDER BY k) AS part FROM rows r JOIN heads USING (path) WHERE k > h AND m NOT IN (6, 7)),
parts AS (SELECT path, part, min(k) AS row_no, arg_min(m, k) AS m0, arg_min(c, k) AS c0, arg_min(pr, k) AS pr0, sum(CASE WHEN m = 2 THEN 2 WHEN m = 3 THEN 1 ELSE 0 END) AS below,
  sum(CASE WHEN m = 1 THEN 2 WHEN m = 4 THEN 1 ELSE 0 END) AS items FROM body WHERE part > 0 GROUP BY 1, 2)"""


@query(
    "w06_report_entries",
    f"""WITH {REPORT} SELECT path, row_no, CASE m0 WHEN 0 THEN row_no % 900 ELSE row_no % 900 + 1000 END::INTEGER AS finve_nr,
      CASE WHEN m0 = 0 THEN 'ABS ' || pr0 WHEN row_no % 20 = 8 THEN 'SV Lph. 1/2 Y' ELSE 'NBS ' || c0 END AS name, row_no % 20 = 8 AS pooled, (c0 * 3)::INTEGER AS cost_estimate_last_year,
      CASE WHEN row_no % 20 = 8 THEN items ELSE 0 END::INTEGER AS n_items, (below + CASE WHEN m0 = 0 THEN 2 ELSE 0 END)::BIGINT AS n_titles FROM parts WHERE m0 <> 5""",
)
def w06_report_entries(spark, d):
    entries, titles, _ = imports.assemble_report(report_rows(spark, d))
    n = titles.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n"))
    return entries.join(n, ["path", "part"], "left").select(
        "path", "row_no", "finve_nr", "name", "pooled", "cost_estimate_last_year", F.size("items").alias("n_items"), F.coalesce("n", F.lit(0).cast("long")).alias("n_titles")
    )


@query("w06_report_unmatched", f"WITH {REPORT} SELECT path, row_no, 'B0134' AS lfd_nr, 'L 06' AS plan_nr, 'Name' AS name FROM parts WHERE m0 = 5")
def w06_report_unmatched(spark, d):
    return imports.assemble_report(report_rows(spark, d))[2]
