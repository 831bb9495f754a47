"""Linkage, geometry, graph and upsert queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackledger.functions import geo
from trackledger.lineage import cut
from trackledger.operators import graph, imports, linkage, upsert
from trackledger.plans import domain as P
from trackledger.plans.domain import read
from trackledger.plans.registry import query

C = F.col

# -- linkage -----------------------------------------------------------------------------------

NAMES = "names AS (SELECT DISTINCT p_name AS name FROM part), tok AS (SELECT name, list_distinct(string_split(lower(name), ' ')) AS t FROM names)"
SHARE = "len(list_intersect(a.t, b.t))::DOUBLE / greatest(len(a.t), len(b.t))"


def name_rows(spark, d):
    n = read(spark, d, "part").select(C("p_name").alias("name")).distinct()
    return n.select(F.xxhash64("name").alias("id"), "name")


@query("f14_token_overlap", f"WITH {NAMES} SELECT a.name AS a, b.name AS b, round({SHARE}, 4) AS share FROM tok a, tok b WHERE a.name < b.name AND {SHARE} > 0")
def f14(spark, d):
    n = name_rows(spark, d)
    return linkage.candidates(n, n).where("a < b").select("a", "b", F.round("share", 4).alias("share"))


@query("f14_similarity")
def f14_full(spark, d):
    """Pairs that share a word, and those without one that reach the lowest threshold."""
    n = cut(name_rows(spark, d))
    listed = linkage.scored(linkage.candidates(n, n).where("a < b")).select("a", "b", "score")
    others = linkage.matches(n, n, linkage.THRESHOLD_SECTION).where("a < b").select("a", "b", "score")
    return listed.union(others.where(~F.arrays_overlap(F.split("a", " "), F.split("b", " ")))).select("a", "b", F.round("score", 4).alias("score"))


def marked_parts(n):
    """Both sides of report matching: every third part names a number, every part describes one."""
    mark = F.concat(F.lit("VDE Nr. "), (C("id") % 50).cast("string"))
    left = n.select("id", F.when(C("id") % 3 == 0, mark).otherwise("").alias("name"))
    return left, n.select("id", F.lit("x").alias("name"), mark.alias("description"))


def announced(n):
    return n.select(C("id").alias("left_id"), (C("id") + 1000).alias("superior_id"), F.when(C("id") % 5 == 0, " Gesamtprojekt").otherwise("West").alias("section"))


# SQL has no such score: tests compare these with brute force.


def part_scores(spark, d, threshold, k):
    """Scores of each part with its ``k`` best other parts, ties to the smaller id."""
    p = read(spark, d, "part").select(C("p_partkey").alias("id"), C("p_name").alias("name"))
    return linkage.top_scores(p, p, k + 1, threshold).where("left_id <> right_id")  # a part can only lose itself


@query("w02_top3_matches")
def w02(spark, d):
    scores = part_scores(spark, d, linkage.THRESHOLD_AGREEMENT, linkage.MAX_SUGGESTIONS)
    return linkage.top_matches(scores).select("left_id", "right_id", "rank")


@query("w03_best_match")
def w03(spark, d):
    scores = part_scores(spark, d, linkage.THRESHOLD_REPORT, 1)
    return linkage.best_match(scores, linkage.THRESHOLD_REPORT).select("left_id", "right_id", F.round("score", 4).alias("score"))


@query("w04_priority_matches")
def w04(spark, d):
    left, right = marked_parts(read(spark, d, "part").select(C("p_partkey").alias("id")))
    scores = part_scores(spark, d, linkage.THRESHOLD_REPORT, linkage.MAX_SUGGESTIONS)
    return linkage.report_matches(left, right, scores).select("left_id", "right_id", "klass", "rank")


@query("f52_leaf_choice")
def f52(spark, d):
    rows = announced(read(spark, d, "part").select(C("p_partkey").alias("id")))
    return linkage.resolve_leaf(rows, part_scores(spark, d, linkage.THRESHOLD_SECTION, 1))


@query(
    "w02_listed_matches",
    """WITH names AS (SELECT lower(p_name) AS name, min(p_partkey) AS id FROM part GROUP BY 1),
      lists AS (SELECT DISTINCT l_suppkey AS list_id, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE lower(p_name) END AS name FROM lineitem JOIN part ON p_partkey = l_partkey)
      SELECT DISTINCT list_id, n.id AS project_id FROM lists l JOIN names n ON n.name = l.name""",
)
def w02_listed(spark, d):
    """The names that each supplier's parts list, written another way, to the best part."""
    part = read(spark, d, "part")
    sold = read(spark, d, "lineitem").select(C("l_suppkey").alias("list_id"), C("l_partkey").alias("p_partkey"))
    written = F.when(C("p_partkey") % 9 == 0, F.concat(F.lit("#"), (C("p_partkey") * 7).cast("string"))).otherwise(F.concat(F.lit("NBS "), F.upper("p_name")))
    lists = sold.join(part, "p_partkey").groupBy("list_id").agg(F.array_sort(F.collect_set(written)).alias("names"))
    found = linkage.listed_matches(lists, part.select(C("p_partkey").alias("id"), C("p_name").alias("name")))
    return linkage.listed_projects(found).select("list_id", "project_id")


@query(
    "f52_section_choice",
    """SELECT c_custkey AS section_id, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE n_nationkey END AS subproject_id FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def f52_section(spark, d):
    """A customer's line in its region's report to the nation that it names."""
    nation = read(spark, d, "nation").select(C("n_nationkey").alias("id"), C("n_regionkey").alias("project_id"), C("n_name").alias("name"))
    c = read(spark, d, "customer").join(nation, C("c_nationkey") == C("id"))
    kind = C("c_custkey") % 4
    sections = c.select(
        C("c_custkey").alias("section_id"), "project_id",
        F.when(kind == 3, "###").when(kind == 0, F.lower("name")).when(kind == 1, F.concat(F.lit(" ABS "), C("name"))).alias("label"),
        F.when(kind == 3, F.lit("%%%")).otherwise(F.lit(" ")).alias("number"), F.when(kind == 2, C("name")).alias("place"),
    )
    return linkage.section_choice(sections, nation).select("section_id", "subproject_id")


# -- geometry -----------------------------------------------------------------------------------

HAV = "(2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({b1} - {b0}) / 2), 2) + cos(radians({b0})) * cos(radians({b1})) * pow(sin(radians({a1} - {a0}) / 2), 2)))))"


def point(key, col):
    return (F.lit(6) + C(key) % 900 / F.lit(100.0)).alias(col[0]), (F.lit(47) + C(key) % 800 / F.lit(100.0)).alias(col[1])


PTS = "c AS (SELECT c_custkey AS id, 6 + (c_custkey % 900) / 100.0::DOUBLE AS lon, 47 + (c_custkey % 800) / 100.0::DOUBLE AS lat FROM customer), s AS (SELECT s_suppkey AS id, 6 + (s_suppkey % 900) / 100.0::DOUBLE AS lon, 47 + (s_suppkey % 800) / 100.0::DOUBLE AS lat FROM supplier)"


@query("f43_distance", f"WITH {PTS} SELECT c.id, round({HAV.format(a0='c.lon', b0='c.lat', a1='10.0', b1='51.0')}, 3) AS km FROM c")
def f43(spark, d):
    c = read(spark, d, "customer").select(C("c_custkey").alias("id"), *point("c_custkey", ("lon", "lat")))
    return c.select("id", F.round(geo.haversine_km(C("lon"), C("lat"), F.lit(10.0), F.lit(51.0)), 3).alias("km"))


@query(
    "j13_nearest",
    f"""WITH {PTS} SELECT point_id, place_id, round(km, 3) AS km FROM (SELECT c.id AS point_id, s.id AS place_id, {HAV.format(a0="c.lon", b0="c.lat", a1="s.lon", b1="s.lat")} AS km,
      row_number() OVER (PARTITION BY c.id ORDER BY {HAV.format(a0="c.lon", b0="c.lat", a1="s.lon", b1="s.lat")}, s.id) AS rn FROM c, s) x WHERE rn = 1""",
)
def j13(spark, d):
    c = read(spark, d, "customer").select(C("c_custkey").alias("id"), *point("c_custkey", ("lon", "lat")))
    s = read(spark, d, "supplier").select(C("s_suppkey").alias("id"), *point("s_suppkey", ("lon", "lat")))
    return linkage.nearest(c, s).select("point_id", "place_id", F.round("km", 3).alias("km"))


def user_lines(spark, d):
    p = F.struct("event_id", *point("event_id", ("lon", "lat")))
    g = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(p)).alias("p"))
    return g.select("user_id", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"))


EV = "e AS (SELECT user_id, event_id, 6 + (event_id % 900) / 100.0::DOUBLE AS lon, 47 + (event_id % 800) / 100.0::DOUBLE AS lat FROM events)"
KM = "floor(km * 100 + 0.5) / 100"


@query(
    "a19_line_length",
    f"""WITH {EV}, g AS (SELECT *, lag(lon) OVER w AS x, lag(lat) OVER w AS y FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      h AS (SELECT user_id, CASE WHEN x IS NOT NULL THEN {HAV.format(a0="x", b0="y", a1="lon", b1="lat")} END AS hop FROM g),
      t AS (SELECT user_id, coalesce(sum(hop), 0) AS km FROM h GROUP BY 1) SELECT user_id, CASE WHEN km > 0 THEN {KM} END AS km FROM t""",
)
def a19(spark, d):
    return user_lines(spark, d).select("user_id", geo.rounded_km(geo.line_km(C("points"))).alias("km"))


@query("a18_bbox", f"WITH {EV} SELECT user_id, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM e GROUP BY 1")
def a18(spark, d):
    return user_lines(spark, d).select("user_id", geo.bbox(C("points")).alias("b")).select("user_id", "b.*")


@query("p19_valid_route", f"WITH {EV} SELECT user_id, count(*) >= 2 AS valid FROM e GROUP BY 1")
def p19_route(spark, d):
    return user_lines(spark, d).select("user_id", geo.valid_route(C("points")).alias("valid"))


GEO = "'{\"type\":\"LineString\",\"coordinates\":[[6,' || (47 + user_id % 5) || '],[7,' || (47 + user_id % 5) || ']]}'"


def geojson(spark, d):
    u = read(spark, d, "events").select("user_id").distinct()
    lat = (F.lit(47) + C("user_id") % 5).cast("string")
    line = F.concat(F.lit('{"type":"LineString","coordinates":[[6,'), lat, F.lit("],[7,"), lat, F.lit("]]}"))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), line, F.lit("}"))
    text = (
        F.when(C("user_id") % 4 == 0, F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit(","), feature, F.lit("]}")))
        .when(C("user_id") % 4 == 1, feature).when(C("user_id") % 4 == 2, line).otherwise("kein JSON")
    )
    return u.select("user_id", text.alias("text"))


@query("f44_features", "SELECT DISTINCT user_id, [2, 1, 1, 0][(user_id % 4 + 1)::BIGINT] AS n_features FROM events")
def f44(spark, d):
    return geojson(spark, d).select("user_id", F.size(geo.features_of(C("text"))).alias("n_features"))


@query(
    "f45_geojson_length",
    f"""SELECT DISTINCT user_id, CASE user_id % 4 WHEN 3 THEN NULL ELSE {KM} END AS km FROM (
      SELECT user_id, (CASE WHEN user_id % 4 = 0 THEN 2 ELSE 1 END) * {HAV.format(a0="6", b0="(47 + user_id % 5)", a1="7", b1="(47 + user_id % 5)")} AS km FROM events) x""",
)
def f45(spark, d):
    return geojson(spark, d).select("user_id", geo.geojson_km(C("text")).alias("km"))


@query("f46_route_key", "SELECT c_custkey, sha256('rail|' || printf('%.6f', 47 + (c_custkey % 800) / 100.0::DOUBLE) || ',' || printf('%.6f', 6 + (c_custkey % 900) / 100.0::DOUBLE) || ';50.000000,8.000000') AS cache_key FROM customer")
def f46(spark, d):
    c = read(spark, d, "customer").select("c_custkey", *point("c_custkey", ("lon", "lat")))
    points = F.array(F.struct("lon", "lat"), F.struct(F.lit(8.0).alias("lon"), F.lit(50.0).alias("lat")))
    return c.select("c_custkey", geo.route_key(points, F.lit("rail")).alias("cache_key"))


@query(
    "f47_geometry_edit",
    """WITH f AS (SELECT user_id, list(event_id::VARCHAR ORDER BY event_id) AS f FROM events GROUP BY 1)
      SELECT user_id, array_to_string(list_concat(list_concat(list_filter(f, lambda x, i: i - 1 <> user_id % 3 AND i <> 2), ['n' || user_id]), CASE WHEN user_id % 3 = 0 THEN f[1:1] ELSE [] END), ',') AS features FROM f""",
)
def f47(spark, d):
    """Of each user's features two go by place; a new one and the first are added, unless it is there still."""
    u = read(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")).alias("f"))
    kept = geo.without_indices(C("f"), F.array((C("user_id") % 3).cast("int"), F.lit(1)))
    added = F.array(F.concat(F.lit("n"), C("user_id").cast("string")), F.get("f", 0))
    return u.select("user_id", F.array_join(F.array_distinct(F.concat(kept, added)), ",").alias("features"))


@query(
    "s15_route_feature",
    """SELECT s_suppkey, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || (6 + s_suppkey % 64 / 8.0::DOUBLE) || ',' || (47 + s_suppkey % 48 / 8.0::DOUBLE) || '],[' || (6 + s_nationkey / 4.0::DOUBLE) || ',48.0]]},"properties":{"id":' || s_suppkey || '}}' AS feature FROM supplier""",
)
def s15(spark, d):
    spot = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    k = C("s_suppkey")
    points = F.array(spot(F.lit(6) + k % 64 / F.lit(8.0), F.lit(47) + k % 48 / F.lit(8.0)), spot(F.lit(6) + C("s_nationkey") / F.lit(4.0), F.lit(48.0)))
    return read(spark, d, "supplier").select("s_suppkey", geo.route_feature(points, F.struct(k.alias("id"))).alias("feature"))


#: Over any supplier number, so edge ids do not repeat.
EDGE_BASE = 1 << 32

# -- graph ---------------------------------------------------------------------------------------


def supplier_edges(spark, d):
    """Edges between successive suppliers of an order, the cheapest kept per pair."""
    li = read(spark, d, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("x"))
    hops = g.select(F.explode(F.transform(F.slice("x", 2, F.size("x")), lambda v, i: F.struct(F.get("x", i)["l_suppkey"].alias("a"), v["l_suppkey"].alias("b"), v["l_quantity"].alias("cost")))).alias("h"))
    pairs = hops.select(F.least("h.a", "h.b").alias("a"), F.greatest("h.a", "h.b").alias("b"), "h.cost").where("a < b")
    return pairs.groupBy("a", "b").agg(F.min("cost").alias("cost")).select((C("a") * EDGE_BASE + C("b")).alias("edge_id"), "a", "b", "cost")


EDGES = """hops AS (SELECT lag(l_suppkey) OVER w AS x, l_suppkey AS y, l_quantity AS cost FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
edges AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(cost) AS cost FROM hops WHERE x <> y GROUP BY 1, 2), ways AS (SELECT a, b, cost FROM edges UNION ALL SELECT b, a, cost FROM edges)"""


def _rounds(n: int) -> str:
    out = ["r0 AS (SELECT min(a) AS node, 0.0::DOUBLE AS cost FROM edges)"]
    for i in range(1, n + 1):
        out.append(f"r{i} AS (SELECT node, min(cost) AS cost FROM (SELECT node, cost FROM r{i - 1} UNION ALL SELECT b, r.cost + e.cost FROM r{i - 1} r JOIN ways e ON e.a = r.node) x GROUP BY 1)")
    return ", ".join(out)


@query("g01_distances", f"WITH {EDGES}, {_rounds(24)} SELECT node, round(cost, 4) AS cost FROM r24")
def g01(spark, d):
    edges = cut(supplier_edges(spark, d))
    start = edges.agg(F.min("a")).first()[0]
    return graph.distances(edges, start).select("node", F.round("cost", 4).alias("cost"))


@query("g01_shortest_path")
def g01_path(spark, d):
    return end_to_end(cut(supplier_edges(spark, d)))


def end_to_end(edges):
    ends = edges.agg(F.min("a").alias("s"), F.max("b").alias("e")).first()
    return graph.shortest_path(edges, ends["s"], ends["e"])


@query(
    "g02_numbered_edges",
    f"WITH {EDGES}, v AS (SELECT id, dense_rank() OVER (ORDER BY id) AS node FROM (SELECT a AS id FROM edges UNION SELECT b FROM edges) x) SELECT a * {EDGE_BASE} + b AS edge_id, s.node::BIGINT AS source, t.node::BIGINT AS target, cost FROM edges JOIN v s ON s.id = a JOIN v t ON t.id = b",
)
def g02(spark, d):
    return graph.numbered_edges(supplier_edges(spark, d))


@query("j17_path_edges")
def j17(spark, d):
    edges = cut(supplier_edges(spark, d))
    path = end_to_end(edges)
    return path.join(edges.select("edge_id", "a", "b", C("cost").alias("edge_cost")), "edge_id").select("seq", "edge_id", "a", "b", "edge_cost")


@query("g03_edges_of_lines")
def g03(spark, d):
    """Lines between the places of neighbouring customers, laid onto the supplier graph."""
    c = read(spark, d, "customer")
    spot = lambda k: F.struct((F.lit(6) + k % 900 / F.lit(100.0)).alias("lon"), (F.lit(47) + k % 800 / F.lit(100.0)).alias("lat"))
    lines = c.select(C("c_custkey").alias("line_id"), F.array(spot(C("c_custkey")), spot(C("c_custkey") * 7)).alias("points"))
    edges = cut(supplier_edges(spark, d))
    on_graph = edges.select(C("a").alias("s_suppkey")).union(edges.select("b")).distinct()
    places = on_graph.select(C("s_suppkey").alias("id"), *point("s_suppkey", ("lon", "lat")))
    return graph.edges_of_lines(lines, places, edges)


# -- upsert and audit ----------------------------------------------------------------------------------


def part_year(spark, d, year):
    li = read(spark, d, "lineitem").where(F.year("l_shipdate") == year)
    return li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").cast("long").alias("qty"), F.max("l_returnflag").alias("flag"))


YEAR = "SELECT l_partkey, count(*) AS n_rows, sum(l_quantity)::BIGINT AS qty, max(l_returnflag) AS flag FROM lineitem WHERE year(l_shipdate) = {y} GROUP BY 1"
LONG = "SELECT l_partkey, unnest(['n_rows', 'qty', 'flag']) AS field_name, unnest([n_rows::VARCHAR, qty::VARCHAR, '\"' || flag || '\"']) AS v FROM ({t})"
FIELDS = ("n_rows", "qty", "flag")


@query(
    "m01_upsert_audit",
    f"""WITH o AS ({LONG.format(t=YEAR.format(y=1997))}), n AS ({LONG.format(t=YEAR.format(y=1998))})
      SELECT n.l_partkey, CASE WHEN o.l_partkey IS NULL THEN 'CREATE' ELSE 'UPDATE' END AS action, n.field_name, o.v AS old_value, n.v AS new_value
      FROM n LEFT JOIN o ON o.l_partkey = n.l_partkey AND o.field_name = n.field_name WHERE o.v IS DISTINCT FROM n.v""",
)
def m01_audit(spark, d):
    return upsert.upsert(part_year(spark, d, 1997), part_year(spark, d, 1998), ["l_partkey"], FIELDS)[1]


@query(
    "m01_upsert_snapshot",
    f"WITH o AS ({YEAR.format(y=1997)}), n AS ({YEAR.format(y=1998)}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE l_partkey NOT IN (SELECT l_partkey FROM n)",
)
def m01_snapshot(spark, d):
    return upsert.upsert(part_year(spark, d, 1997), part_year(spark, d, 1998), ["l_partkey"], FIELDS)[0]


@query("m01_second_run", "SELECT 0::BIGINT AS l_partkey, '' AS action WHERE false")
def m01_twice(spark, d):
    staged = part_year(spark, d, 1998)
    snapshot, _ = upsert.upsert(part_year(spark, d, 1997), staged, ["l_partkey"], FIELDS)
    return upsert.upsert(snapshot, staged, ["l_partkey"], FIELDS)[1].select("l_partkey", "action")


@query(
    "m10_diff",
    f"""WITH o AS ({LONG.format(t=YEAR.format(y=1997))}), n AS ({LONG.format(t=YEAR.format(y=1998))})
      SELECT coalesce(n.l_partkey, o.l_partkey) AS l_partkey, coalesce(n.field_name, o.field_name) AS field_name,
        CASE WHEN o.l_partkey IS NULL THEN 'CREATE' WHEN n.l_partkey IS NULL THEN 'DELETE' ELSE 'PATCH' END AS action, o.v AS old_value, n.v AS new_value
      FROM n FULL JOIN o ON o.l_partkey = n.l_partkey AND o.field_name = n.field_name WHERE o.v IS DISTINCT FROM n.v AND coalesce(n.field_name, o.field_name) <> 'flag'""",
)
def m10(spark, d):
    return upsert.diff(part_year(spark, d, 1997), part_year(spark, d, 1998), ["l_partkey"], FIELDS, skip=["flag"])


@query(
    "m11_revert",
    f"""WITH o AS ({LONG.format(t=YEAR.format(y=1997))}), n AS ({LONG.format(t=YEAR.format(y=1998))})
      SELECT n.l_partkey, n.field_name, 'REVERT' AS action, n.v AS old_value, o.v AS new_value FROM n JOIN o ON o.l_partkey = n.l_partkey AND o.field_name = n.field_name
      WHERE o.v IS DISTINCT FROM n.v AND n.l_partkey % 3 = 0 AND n.field_name = 'qty'""",
)
def m11(spark, d):
    current = upsert.unpivot(part_year(spark, d, 1998), ["l_partkey"], FIELDS)
    audit = m01_audit(spark, d).where("action = 'UPDATE'").withColumn("entry_id", F.xxhash64("l_partkey", "field_name"))
    chosen = audit.where("l_partkey % 3 = 0 and field_name = 'qty'").select("entry_id")
    return upsert.revert(current, audit, chosen, "l_partkey")[1]


@query("m03_get_or_create", "SELECT * FROM (SELECT n_nationkey AS k, n_name AS label FROM nation WHERE n_nationkey < 20) x UNION ALL SELECT c_nationkey, arg_min(c_name, c_custkey) FROM customer WHERE c_nationkey >= 20 GROUP BY 1")
def m03(spark, d):
    dim = read(spark, d, "nation").where("n_nationkey < 20").select(C("n_nationkey").alias("k"), C("n_name").alias("label"))
    staged = read(spark, d, "customer").select(C("c_nationkey").alias("k"), C("c_name").alias("label"), "c_custkey")
    return upsert.get_or_create(dim, staged, "k", "c_custkey")


@query(
    "m04_overwrite_facts",
    f"WITH {P.BUDGETS} SELECT fin_ve, budget_year, CASE WHEN budget_year = 1998 THEN NULL ELSE planned END AS planned, CASE WHEN budget_year = 1998 THEN planned + 1 ELSE spent END AS spent FROM budgets",
)
def m04(spark, d):
    b = P.budgets(spark, d).select("fin_ve", "budget_year", "planned", "spent")
    new = b.where("budget_year = 1998").select("fin_ve", "budget_year", F.lit(None).cast("long").alias("planned"), (C("planned") + 1).alias("spent"), F.lit(2).alias("seq"))
    early = new.select("fin_ve", "budget_year", F.lit(0).cast("long").alias("planned"), F.lit(0).cast("long").alias("spent"), F.lit(1).alias("seq"))
    return upsert.overwrite_facts(b, new.unionByName(early), ["fin_ve", "budget_year"], "seq")


@query("m06_delete_import", f"WITH {P.LINKS}, {P.BUDGETS} SELECT 'budget' AS kind, fin_ve AS id, count(*) AS n FROM budgets WHERE budget_year <> 1996 GROUP BY 2 UNION ALL SELECT 'link', finve_id, count(*) FROM links WHERE haushalt_year IS DISTINCT FROM 1996 GROUP BY 2")
def m06(spark, d):
    b, k = upsert.delete_import(P.budgets(spark, d), P.links(spark, d), 1996)
    count = lambda df, kind, key: df.groupBy(C(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "id", "n")
    return count(b, "budget", "fin_ve").union(count(k, "link", "finve_id"))


@query(
    "m07_feed_upsert",
    """SELECT k AS external_id, CASE WHEN k % 3 = 0 THEN c.title ELSE f.title END AS title, CASE WHEN k % 3 = 0 OR k % 5 = 0 AND k % 7 <> 0 THEN c.sug ELSE k + 1 END AS suggested_id,
        CASE WHEN k % 7 <> 0 THEN c.proj END AS project_id, k % 5 = 0 AND k % 7 <> 0 AS confirmed,
        CASE WHEN k % 7 = 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS fetched,
        CASE WHEN k % 7 = 0 THEN 'created' WHEN k % 3 = 0 THEN 'kept' WHEN k % 2 = 0 THEN 'unchanged' ELSE 'updated' END AS action
      FROM (SELECT s_suppkey AS k, s_name AS title, s_suppkey * 2 AS sug, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey END AS proj FROM supplier) c
      JOIN (SELECT s_suppkey AS k2, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE upper(s_name) || '!' END AS title FROM supplier) f ON k2 = k
      WHERE NOT (k % 7 = 0 AND k % 3 = 0)""",
)
def m07(spark, d):
    k = C("s_suppkey")
    s = read(spark, d, "supplier").where(~((k % 7 == 0) & (k % 3 == 0)))
    current = s.where(k % 7 != 0).select(
        k.alias("external_id"), C("s_name").alias("title"), (k * 2).alias("suggested_id"), F.when(k % 5 == 0, k).alias("project_id"), (k % 5 == 0).alias("confirmed"), F.to_date(F.lit("2024-01-01")).alias("fetched")
    )
    feed = s.where(k % 3 != 0).select(
        k.alias("external_id"), F.when(k % 2 == 0, C("s_name")).otherwise(F.concat(F.upper("s_name"), F.lit("!"))).alias("title"), (k + 1).alias("suggested_id"), F.to_date(F.lit("2024-02-01")).alias("fetched")
    )
    return upsert.feed_upsert(current, feed, ["title"])


@query("m08_replace_drafts", "SELECT o_orderkey AS id, year(o_orderdate)::INTEGER AS year, o_orderstatus = 'F' AS confirmed FROM orders WHERE year(o_orderdate) <> 1996 OR o_orderstatus = 'F' UNION ALL SELECT s_suppkey, 1996, false FROM supplier")
def m08(spark, d):
    now = read(spark, d, "orders").select(C("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), (C("o_orderstatus") == "F").alias("confirmed"))
    staged = read(spark, d, "supplier").select(C("s_suppkey").alias("id"), F.lit(1996).alias("year"), F.lit(False).alias("confirmed"))
    return upsert.replace_drafts(now, staged, 1996)


@query("m09_confirm_all", "SELECT DISTINCT o_custkey AS project_id FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 3 = 0")
def m09(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.when(C("o_custkey") % 3 == 0, C("o_custkey")).alias("project_id"), (C("o_orderstatus") == "F").alias("confirmed"))
    return upsert.confirm_all(rows)[1]


@query("m12_replace_children", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 AND o_orderkey % 16 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def m12(spark, d):
    parents = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    change = parents.where("o_orderkey % 8 = 0").select("o_orderkey", F.when(C("o_orderkey") % 16 == 0, "X").alias("o_orderstatus"))
    kids = read(spark, d, "lineitem").select(C("l_orderkey").alias("o_orderkey"), "l_linenumber")
    new = change.select("o_orderkey", F.lit(1).alias("l_linenumber"))
    return upsert.replace_children(parents, change, kids, new, "o_orderkey", ["o_orderstatus"])[0]


@query("m12_new_children", "SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 8 <> 0 GROUP BY 1 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 8 = 0")
def m12_children(spark, d):
    parents = read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    change = parents.where("o_orderkey % 8 = 0").select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"))
    kids = read(spark, d, "lineitem").select(C("l_orderkey").alias("o_orderkey"), "l_linenumber")
    out = upsert.replace_children(parents, change, kids, change.select("o_orderkey", F.lit(1).alias("l_linenumber")), "o_orderkey", ["o_orderstatus"])[1]
    return out.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("m13_draft_by_task", "SELECT user_id AS task_id, arg_max(props, event_id) AS payload FROM events GROUP BY 1")
def m13(spark, d):
    e = read(spark, d, "events").select(C("user_id").alias("task_id"), C("props").alias("payload"), "event_id")
    empty = e.select("task_id", "payload").limit(0)
    return upsert.overwrite_facts(empty, e, ["task_id"], "event_id")


@query(
    "m14_completion_time",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN DATE '2025-01-31' WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS completed_at FROM orders""",
)
def m14(spark, d):
    old = F.when(C("o_orderstatus") == "F", "DONE").otherwise("OPEN")
    new = F.when(C("o_orderkey") % 2 == 0, "DONE").otherwise("OPEN")
    return read(spark, d, "orders").select("o_orderkey", upsert.completion_time(old, new, F.to_date("o_orderdate"), P.today()).alias("completed_at"))


@query("m15_backfill", """SELECT s_suppkey, '[{"url":"' || s_name || '","comment":null}]' AS links FROM supplier WHERE s_suppkey % 2 = 0""")
def m15(spark, d):
    item = F.struct(C("s_name").alias("url"), F.lit(None).cast("string").alias("comment"))
    return read(spark, d, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", F.to_json(F.array(item), {"ignoreNullFields": "false"}).alias("links"))


@query("m16_idempotent_insert", "SELECT p_name AS cache_key, min(p_partkey) AS id FROM part GROUP BY 1")
def m16(spark, d):
    p = read(spark, d, "part").select(C("p_name").alias("cache_key"), C("p_partkey").alias("id"))
    first = p.groupBy("cache_key").agg(F.min("id").alias("id")).where("id % 2 = 0")
    return upsert.insert_idempotent(first, p, "cache_key", "id")


@query(
    "f51_json_escapes",
    r"""SELECT n_nationkey, '"' || n_name || ' \u00fc\u2013 \ud83d\u' || printf('%04x', 56832 + n_nationkey) || ' \ud835\udd38"' AS value FROM nation""",
)
def f51(spark, d):
    face = F.decode(F.unhex(F.concat(F.lit("F09F98"), F.hex(C("n_nationkey") + 0x80))), "UTF-8")
    return read(spark, d, "nation").select("n_nationkey", upsert.as_json(F.concat("n_name", F.lit(" ü– "), face, F.lit(" 𝔸"))).alias("value"))


@query("m10_patch", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN 7 ELSE s_nationkey END::INTEGER AS s_nationkey FROM supplier")
def m10_patch(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    name = F.when(C("s_suppkey") % 3 == 0, F.create_map(F.lit("s_name"), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    nation = F.when(C("s_suppkey") % 2 == 0, F.create_map(F.lit("s_nationkey"), F.lit("7"))).otherwise(F.create_map().cast("map<string,string>"))
    return upsert.patch(s, s.select("s_suppkey", F.map_concat(name, nation).alias("patch")), "s_suppkey", ["s_name", "s_nationkey"])


def confirmed(spark, d):
    """An import of 2026 over agreements and budgets of 2025 made from the same report rows."""
    from trackledger.plans.text_queries import report_rows

    entries, titles, unmatched = imports.assemble_report(report_rows(spark, d))
    old = upsert.first_per_key(entries, ["finve_nr"], C("row_no")).where("finve_nr % 3 = 0")
    finves = old.select(C("finve_nr").alias("id"), F.lit("alt").alias("name"), "starting_year", "cost_estimate_original", C("pooled").alias("is_sammel_finve"))
    none = {c: F.lit(None).cast(t) for c, t in (("plan_nr", "string"), ("lfd_nr", "string"))}
    budgets = old.withColumns(none).select(
        F.lit(2025).alias("budget_year"), C("finve_nr").alias("fin_ve"), C("plan_nr").alias("bedarfsplan_number"), C("pooled").alias("sammel_finve"),
        *[c for c in upsert.BUDGET_FIELDS if c not in ("bedarfsplan_number", "sammel_finve")],
    )
    dim = titles.where("titel_key = '891_01'").select("titel_key", F.lit("alt").alias("label")).distinct()
    facts = titles.limit(0).select(F.lit(2025).alias("budget_year"), C("finve_nr").alias("fin_ve"), "titel_key", "veranschlagt")
    links = old.select(C("finve_nr").alias("finve_id"), F.lit(1).alias("project_id"), F.lit(None).cast("int").alias("haushalt_year"))
    wanted = entries.select(C("finve_nr").alias("finve_id"), (C("finve_nr") % 5 + 1).alias("project_id")).distinct()
    receipt = spark.createDataFrame([(1, None)], "parse_id int, confirmed_at date")
    return imports.confirm_import(2026, receipt, entries, titles, wanted, unmatched, finves, budgets, dim, facts, links, P.today())


_REP = """WITH {r}, e AS (SELECT *, CASE m0 WHEN 0 THEN row_no % 900 ELSE row_no % 900 + 1000 END AS f FROM parts WHERE m0 <> 5),
last AS (SELECT f, arg_max(row_no, (path, row_no)) AS row_no, arg_max(m0, (path, row_no)) AS m0 FROM e GROUP BY 1)"""


def _confirm_sql() -> str:
    from trackledger.plans.text_queries import REPORT

    return _REP.format(r=REPORT) + """
      SELECT 'finve' AS what, 'UPDATE' AS action, count(DISTINCT f) AS n FROM last WHERE f % 3 = 0
      UNION ALL SELECT 'finve', 'CREATE', count(DISTINCT f) FROM last WHERE f % 3 <> 0
      UNION ALL SELECT 'budget', 'CREATE', count(DISTINCT f) FROM last
      UNION ALL SELECT 'links', 'ROWS', count(*) FROM (SELECT f, f % 5 + 1 AS p, CASE WHEN row_no % 20 = 8 THEN 2026 END AS y FROM last
        UNION SELECT f, 1, NULL FROM last WHERE f % 3 = 0 AND row_no % 20 = 8) x
      UNION ALL SELECT 'unmatched', 'ROWS', count(*) FROM parts WHERE m0 = 5
      UNION ALL SELECT 'receipt', 'ROWS', 1"""


@query("m05_confirm_import", _confirm_sql())
def m05(spark, d):
    c = confirmed(spark, d)
    rows = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit("ROWS").alias("action"), "n")
    acts = lambda df, what, key: df.groupBy("action").agg(F.countDistinct(key).alias("n")).select(F.lit(what).alias("what"), "action", "n")
    parts = [acts(c.finve_audit, "finve", "id"), acts(c.budget_audit, "budget", "fin_ve"), rows(c.links, "links"), rows(c.quarantine, "unmatched")]
    parts.append(rows(c.receipt.where("confirmed_at is not null"), "receipt"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
