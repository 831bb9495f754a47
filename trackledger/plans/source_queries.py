"""Sources and sinks: driver tables landed in each format and read back through its reader."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from trackledger.lineage import ensure_checkpoint_dir
from trackledger.operators import search
from trackledger.plans.domain import read
from trackledger.plans.registry import query
from trackledger.sources import readers, versions

C = F.col


def landing(spark) -> str:
    """A new folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/landed-{uuid4().hex}"


#: A register file is read by one task: how many records it may hold.
RECORDS_PER_FILE = 20_000


def land_register(rows, path, tag):
    """``rows`` as XML files of bounded size."""
    rows.write.format("xml").option("rowTag", tag).option("rootTag", "RINF").option("maxRecordsPerFile", RECORDS_PER_FILE).save(path)


def value(c):
    return F.struct(c.cast("string").alias("_Value"))


@query(
    "s07_json_feed",
    "SELECT c_custkey::INTEGER AS id, c_nationkey::INTEGER AS parent_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS shorttitle, 47 + (c_custkey % 800) / 100.0::DOUBLE AS lat FROM customer",
)
def s07(spark, d):
    """A feed of many arrays, one per thousand customers."""
    k = C("c_custkey")
    item = F.struct(k.alias("id"), C("c_nationkey").alias("parent_id"), F.when(k % 3 != 0, C("c_name")).alias("shorttitle"), (F.lit(47) + k % 800 / F.lit(100.0)).alias("lat"), F.lit("x").alias("unknown"))
    arrays = read(spark, d, "customer").groupBy(F.floor(k / 1000).alias("file")).agg(F.to_json(F.collect_list(item)).alias("value"))
    path = landing(spark)
    arrays.write.partitionBy("file").text(path)
    return readers.json_feed(spark, f"{path}/*").select("id", "parent_id", "shorttitle", "lat")


@query(
    "s09_operational_points",
    """SELECT 'DE' || s_suppkey AS op_id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'station' ELSE '10' END AS type,
      CASE WHEN s_suppkey % 5 <> 0 THEN 47 + (s_suppkey % 800) / 100.0::DOUBLE END AS latitude, 6.5::DOUBLE AS longitude, DATE '2015-01-01' AS validity_date_start,
      CASE WHEN s_suppkey % 3 <> 0 THEN DATE '2099-12-31' END AS validity_date_end FROM supplier""",
)
def s09_points(spark, d):
    k = C("s_suppkey")
    lat = F.replace((F.lit(47) + k % 800 / F.lit(100.0)).cast("string"), F.lit("."), F.lit(","))
    kind = F.struct(F.lit("10").alias("_Value"), F.when(k % 2 == 0, "station").alias("_OptionalValue"))
    place = F.struct(F.when(k % 5 != 0, lat).otherwise("?").alias("_Latitude"), F.lit("6,5").alias("_Longitude"))
    rows = read(spark, d, "supplier").select(
        F.lit("2015-01-01").alias("_ValidityDateStart"), F.when(k % 3 != 0, "2099-12-31").otherwise("offen").alias("_ValidityDateEnd"), value(C("s_name")).alias("OPName"),
        value(F.concat(F.lit("DE"), k)).alias("UniqueOPID"), kind.alias("OPType"), place.alias("OPGeographicLocation"),
    )
    path = landing(spark)
    land_register(rows, path, "OperationalPoint")
    return readers.operational_points(spark, path)


@query(
    "s09_track_parameters",
    """SELECT 'DE' || l_orderkey AS sol_op_start, l_linenumber::VARCHAR AS track, v.id, v.value FROM lineitem,
      LATERAL (VALUES ('IPP_Qty', l_quantity::BIGINT::VARCHAR), ('IPP_Flag', l_returnflag)) v(id, value)""",
)
def s09_tracks(spark, d):
    parameters = F.array(
        F.struct(F.lit("IPP_Qty").alias("_ID"), C("l_quantity").cast("long").cast("string").alias("_Value")), F.struct(F.lit("IPP_Flag").alias("_ID"), C("l_returnflag").alias("_Value"))
    )
    track = F.struct(value(C("l_linenumber")).alias("SOLTrackIdentification"), parameters.alias("SOLTrackParameter"))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(track).alias("SOLTrack"))
    rows = rows.select(F.lit("2099-12-31").alias("_ValidityDateEnd"), value(F.concat(F.lit("DE"), C("l_orderkey"))).alias("SOLOPStart"), value(F.lit("DE0")).alias("SOLOPEnd"), value(F.lit("1,5")).alias("SOLLength"), "SOLTrack")
    path = landing(spark)
    land_register(rows, path, "SectionOfLine")
    tracks = readers.sections_of_line(spark, path).select("sol_op_start", F.explode("tracks").alias("t"))
    return tracks.select("sol_op_start", C("t.track").alias("track"), F.explode("t.parameters").alias("p")).select("sol_op_start", "track", "p.id", "p.value")


@query(
    "s11_csv_coerced",
    """SELECT p_partkey::INTEGER AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_size::INTEGER END AS size, p_partkey % 4 = 0 AS superior, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name FROM part""",
)
def s11(spark, d):
    k = C("p_partkey")
    flag = F.when(k % 4 == 0, "True").when(k % 4 == 1, "false").when(k % 4 == 2, "vielleicht")
    rows = read(spark, d, "part").select(
        k.alias("Projekt-Nr."), F.when(k % 3 != 0, F.concat(C("p_size").cast("string"), F.lit(".0"))).otherwise("k. A.").alias("Größe"), flag.alias("ist übergeordnet"),
        F.when(k % 5 != 0, C("p_name")).otherwise("  ").alias("Name"), F.lit("weg").alias("alt"),
    )
    path = landing(spark)
    rows.write.csv(path, header=True)
    return readers.csv_coerced(spark, path, {"Projekt-Nr.": ("id", "int"), "Größe": ("size", "int"), "ist übergeordnet": ("superior", "boolean"), "Name": ("name", "string")})


@query(
    "s12_csv_checked",
    """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'unreadable' WHEN o_orderkey % 5 = 0 THEN 'group_id is missing' ELSE 'ok' END AS verdict, o_orderstatus AS name, count(*) AS n
      FROM orders GROUP BY 1, 2""",
)
def s12(spark, d):
    k = C("o_orderkey")
    number = F.when(k % 7 == 0, "sieben").when(k % 5 != 0, k.cast("string"))
    path = landing(spark)
    read(spark, d, "orders").select(number.alias("group_id"), C("o_orderstatus").alias("name")).write.csv(path, header=True)
    good, bad = readers.csv_checked(spark, path, "group_id long, name string", ["group_id"])
    rows = good.select(F.lit("ok").alias("verdict"), "name").union(bad.select("reason", "name"))
    return rows.groupBy("verdict", "name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s13_attachments",
    """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/gif' END AS mime, CASE n_nationkey % 3 WHEN 2 THEN 'kind not allowed' ELSE 'ok' END AS verdict,
      length(n_name) + [8, 6, 0][(n_nationkey % 3 + 1)::BIGINT] + 1 AS n_bytes FROM nation""",
)
def s13(spark, d):
    k = C("n_nationkey")
    head = F.when(k % 3 == 0, "%PDF-1.7").when(k % 3 == 1, "GIF89a").otherwise("")
    path = landing(spark)
    read(spark, d, "nation").select(k, F.concat(head, C("n_name")).alias("value")).repartition(k).write.partitionBy("n_nationkey").text(path)
    files = readers.attachments(spark, f"{path}/*/*.txt")
    return files.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("long").alias("n_nationkey"), "mime", "verdict", C("length").alias("n_bytes"))


@query("s14_json_dump", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS o_custkey FROM orders")
def s14(spark, d):
    path = landing(spark)
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(C("o_orderkey") % 2 == 0, C("o_custkey")).alias("o_custkey"))
    readers.dump_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("s16_reload", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1")
def s16(spark, d):
    path = landing(spark)
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    readers.reload(c, path)
    held = versions.read(spark, path)  # a reader of the first version sees it whole after the second
    readers.reload(held.where("c_custkey % 2 = 1"), path)
    return versions.read(spark, path)


@query(
    "m01_touched_buckets",
    """WITH o AS (SELECT c_custkey, c_name, c_nationkey FROM customer), n AS (SELECT c_custkey, upper(c_name) || '!' AS c_name, c_nationkey FROM customer WHERE c_custkey <= 15)
      SELECT o.c_custkey, coalesce(n.c_name, o.c_name) AS c_name, o.c_nationkey, n.c_custkey IS NOT NULL AS audited FROM o LEFT JOIN n USING (c_custkey)""",
)
def m01_touched(spark, d):
    """Fifteen customers change: their bucket alone is written again."""
    path = landing(spark)
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    block = F.floor(C("c_custkey") / 16).cast("int")
    versions.publish(c, path, bucket=block)
    staged = c.where("c_custkey <= 15").withColumn("c_name", F.concat(F.upper("c_name"), F.lit("!")))
    number, audit = versions.upsert(staged, path, ["c_custkey"], ["c_name", "c_nationkey"], bucket=block)
    changed = audit.where("field_name = 'c_name' and action = 'UPDATE'").select("c_custkey", F.lit(True).alias("audited"))
    return versions.read(spark, path, number).join(changed, "c_custkey", "left").withColumn("audited", F.coalesce("audited", F.lit(False)))


# -- documents through an extractor: a format that needs no library stands for scans and tables --------


def split_cells(content: bytes) -> list[tuple[int, list[list[str | None]]]]:
    """Pages parted by form feeds, rows by lines, cells by bars; empty cells are null."""
    pages = content.decode().split("\f")
    return [(n, [[c or None for c in line.split("|")] for line in page.splitlines()]) for n, page in enumerate(pages, 1)]


def landed_files(spark, d):
    """A file per nation: two pages of its customers' lines; that of every fifth nation is damaged."""
    c = read(spark, d, "customer")
    page = lambda odd: F.array_join(F.array_sort(F.collect_list(F.when(C("c_custkey") % 2 == odd, F.concat_ws("|", C("c_custkey").cast("string"), "c_name", F.lit(""))))), "\n")
    text = c.groupBy("c_nationkey").agg(F.concat(page(0), F.lit("\f"), page(1)).alias("text"))
    content = F.when(C("c_nationkey") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.encode("text", "UTF-8"))
    return text.select(F.concat(F.lit("n"), C("c_nationkey").cast("string")).alias("path"), content.alias("content"))


@query(
    "s02_document_rows",
    """WITH lines AS (SELECT 'n' || c_nationkey AS path, 1 + c_custkey % 2 AS page, c_custkey, c_name, c_nationkey FROM customer),
      good AS (SELECT path, page, row_number() OVER (PARTITION BY path ORDER BY page, c_custkey::VARCHAR || '|' || c_name) - 1 AS row_no, c_custkey::VARCHAR AS id, c_name AS name FROM lines WHERE c_nationkey % 5 <> 0)
      SELECT path, page::INTEGER AS page, row_no, 3 AS n_cells, id, name FROM good UNION ALL SELECT DISTINCT path, 0, 0, NULL::INTEGER, NULL, NULL FROM lines WHERE c_nationkey % 5 = 0""",
)
def s02(spark, d):
    rows = readers.page_rows(landed_files(spark, d), split_cells)
    return rows.select("path", "page", "row_no", F.when(C("cells").isNotNull(), F.size("cells")).alias("n_cells"), F.get("cells", 0).alias("id"), F.get("cells", 1).alias("name"))


def remote_reader(content: bytes) -> str:
    """Reads short files only, as a service with a limit does."""
    if len(content) > 4000:
        raise ValueError("too long")
    return content.decode().upper()


@query(
    "s03_document_text",
    """WITH f AS (SELECT 'n' || c_nationkey AS path, c_nationkey, sum(length(c_custkey::VARCHAR) + length(c_name) + 3) - count(DISTINCT c_custkey % 2) + 1 AS n FROM customer GROUP BY 1, 2)
      SELECT path, CASE WHEN c_nationkey % 5 = 0 THEN 'failed' WHEN n > 4000 THEN 'fallback' ELSE 'done' END AS status, CASE WHEN c_nationkey % 5 <> 0 THEN n::INTEGER END AS n_chars FROM f""",
)
def s03(spark, d):
    found = readers.page_text(landed_files(spark, d), remote_reader, bytes.decode)
    return found.select("path", "status", F.length("text").alias("n_chars"))


def answer(text: str) -> str:
    """A stand-in for the extraction model: counts, and fails on what it doesn't know."""
    if text == "URGENT":
        raise RuntimeError(text)
    return '{"text": "%s", "n": %d}' % (text.lower(), len(text))


@query(
    "s18_model_answers",
    """SELECT o_orderkey, CASE WHEN p <> 'URGENT' THEN lower(p) END AS text, CASE WHEN p <> 'URGENT' THEN length(p)::INTEGER END AS n FROM (
      SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN substr(o_orderpriority, 3) END AS p FROM orders) x""",
)
def s18(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.when(C("o_orderkey") % 7 != 0, F.substring("o_orderpriority", 3, 99)).alias("t"))
    got = readers.extracted(rows, "t", answer).withColumn("a", F.from_json("answer", "text string, n int"))
    return got.select("o_orderkey", "a.text", "a.n")


# -- search through an index ----------------------------------------------------------------------------


@query("p13_indexed_search", "SELECT p_partkey, 'name' AS kind FROM part WHERE contains(lower(p_name), 'gre') OR contains(lower(p_type), 'gre') UNION ALL SELECT p_partkey, 'like' FROM part WHERE p_name ILIKE '%r_d%wid%' OR p_type ILIKE '%r_d%wid%'")
def p13_indexed(spark, d):
    path, part = landing(spark), read(spark, d, "part")
    search.build(part, path, "p_partkey", "p_name", "p_type")
    found = search.contains(part, path, "p_partkey", "GRe", "p_name", "p_type").select("p_partkey", F.lit("name").alias("kind"))
    return found.union(search.like_search(part, path, "p_partkey", "r_D%wid", "p_name", "p_type").select("p_partkey", F.lit("like")))


@query("p14_indexed_tokens", "SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'spec') AND contains(lower(o_orderpriority), 'not')")
def p14_indexed(spark, d):
    path, orders = landing(spark), read(spark, d, "orders")
    search.build(orders, path, "o_orderkey", "o_orderpriority")
    return search.all_tokens(orders, path, "o_orderkey", "Spec  NOT", "o_orderpriority").select("o_orderkey")
