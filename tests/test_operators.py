"""Upsert and audit, linkage, graph, text and table parsing, views."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from trackledger.functions import geo, tables
from trackledger.functions import text as T
from trackledger.functions.names import normalize_name, vde_number
from trackledger.operators import graph, linkage, upsert, views


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


# -- upsert --------------------------------------------------------------------------------------

FINVE = "id int, name string, starting_year int, cost int, pooled boolean"
FIELDS = ("name", "starting_year", "cost", "pooled")


def test_upsert_create_update_and_no_op(spark):
    current = spark.createDataFrame([(1, "Alt", 2020, 5, False), (2, "Gleich", None, 7, True), (9, "Rest", 1, 1, None)], FINVE)
    staged = spark.createDataFrame([(1, "Größe –", 2020, None, False), (2, "Gleich", None, 7, True), (3, "Neu", None, 4, False)], FINVE)
    snapshot, audit = upsert.upsert(current, staged, ["id"], FIELDS)
    assert {r["id"]: tuple(r)[1:] for r in snapshot.collect()} == {
        1: ("Größe –", 2020, None, False), 2: ("Gleich", None, 7, True), 3: ("Neu", None, 4, False), 9: ("Rest", 1, 1, None),
    }
    assert sorted(map(str, map(tuple, audit.collect()))) == sorted(
        map(str, [
            (1, "UPDATE", "name", '"Alt"', '"Gr\\u00f6\\u00dfe \\u2013"'), (1, "UPDATE", "cost", "5", None), (3, "CREATE", "name", None, '"Neu"'),
            (3, "CREATE", "cost", None, "4"), (3, "CREATE", "pooled", None, "false"),
        ])
    )
    assert upsert.upsert(snapshot, staged, ["id"], FIELDS)[1].count() == 0


def test_null_keys_are_keys(spark):
    kind = "finve_id int, project_id int, year int"
    have = spark.createDataFrame([(1, 1, None), (1, 2, 2024), (1, 3, 2023)], kind)
    want = spark.createDataFrame([(1, 1, None), (1, 4, 2024)], kind)
    got = sorted(map(str, map(tuple, upsert.link_changes(have, want, ["finve_id", "project_id", "year"], F.col("year") == 2024).collect())))
    assert got == sorted(map(str, [(1, 4, 2024, "INSERT"), (1, 2, 2024, "DELETE")]))
    assert upsert.link_changes(want, want, ["finve_id", "project_id", "year"]).count() == 0


def test_patch_tells_null_from_absent(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    changes = spark.createDataFrame([(1, {"name": None, "n": "x"})], "id int, patch map<string,string>")
    assert sorted(map(tuple, upsert.patch(rows, changes, "id", ["name", "n"]).collect())) == [(1, None, None), (2, "b", 6)]


def test_revert_writes_its_own_audit(spark):
    current = spark.createDataFrame([(1, "name", '"new"'), (1, "n", "1")], "id int, field_name string, value string")
    audit = spark.createDataFrame([(7, 1, "name", '"old"'), (8, 1, "n", "1")], "entry_id int, id int, field_name string, old_value string")
    values, log = upsert.revert(current, audit, spark.createDataFrame([(7,), (8,)], "entry_id int"), "id")
    assert sorted(map(tuple, values.collect())) == [(1, "n", "1"), (1, "name", '"old"')]
    assert [tuple(r) for r in log.collect()] == [(1, "name", "REVERT", '"new"', '"old"')]


def test_feed_keeps_confirmed_matches(spark):
    kind = "external_id int, title string, suggested_id int, project_id int, confirmed boolean, fetched date"
    current = spark.createDataFrame([(1, "A", 5, 5, True, None), (2, "B", 6, None, False, None)], kind)
    feed = spark.createDataFrame([(1, "A2", 9, None), (2, "B", 9, None), (3, "C", 9, None)], "external_id int, title string, suggested_id int, fetched date")
    got = {r["external_id"]: (r["title"], r["suggested_id"], r["confirmed"], r["action"]) for r in upsert.feed_upsert(current, feed, ["title"]).collect()}
    assert got == {1: ("A2", 5, True, "updated"), 2: ("B", 9, False, "unchanged"), 3: ("C", 9, False, "created")}


# -- linkage ------------------------------------------------------------------------------------------


def slow_score(a, b):
    share = len(set(a.split()) & set(b.split())) / max(len(set(a.split())), len(set(b.split())))
    return 0.6 * SequenceMatcher(None, a, b, autojunk=False).ratio() + 0.4 * share


def test_scores_ranks_and_thresholds(spark):
    left = spark.createDataFrame([(1, "ABS Lübeck - Rostock"), (2, "Völlig anders"), (3, None), (4, "")], "id long, name string")
    right = spark.createDataFrame([(10, "NBS Lübeck–Rostock"), (11, "Rostock"), (12, "Lübeck Rostock"), (13, None)], "id long, name string")
    scores = linkage.scored(linkage.candidates(left, right))
    got = {(r["left_id"], r["right_id"]): r["score"] for r in scores.collect()}
    assert got[(1, 10)] == pytest.approx(slow_score("lübeck rostock", "lübeck rostock"))
    assert got[(1, 11)] == pytest.approx(slow_score("lübeck rostock", "rostock"))
    assert [r["right_id"] for r in linkage.top_matches(scores, k=2).orderBy("rank").collect()] == [10, 12]
    assert [tuple(r)[:2] for r in linkage.best_match(scores, 0.5).collect()] == [(1, 10)]


def test_names(spark):
    assert one(spark, normalize_name, "ABS/NBS  Hanau–Fulda (2.BA)") == "hanau fulda 2 ba"
    assert one(spark, lambda c: normalize_name(c, compose=True), "Lübeck") == "lübeck"
    for text, want in [("VDE Nr. 1", "1"), ("vde8.1b", "8.1b"), ("VDE 8.2 x", "8.2"), ("XVDE 3", None), (None, None)]:
        assert one(spark, vde_number, text) == want


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    spot = lambda i: (i, rng.uniform(-180, 180), rng.uniform(-90, 90))
    points = [spot(i) for i in range(60)] + [(100, 179.95, 10.0), (101, 0.0, 89.9)]
    places = [spot(i) for i in range(25)] + [(500, -179.95, 10.0), (501, 120.0, 89.0)]
    # A dense spot: many places in what a coarse grid holds as one cell, some of them equal.
    places += [(600 + i, 8 + i % 20 / 1000, 50 + i // 20 / 1000) for i in range(200)] + [(900 + i, 8.0, 50.0) for i in range(70)]
    points += [(200 + i, 8 + rng.random() / 40, 50 + rng.random() / 40) for i in range(40)] + [(300, 11.0, 50.0), (301, None, 1.0)]

    def km(a, b):
        p, q, dl = math.radians(a[2]), math.radians(b[2]), math.radians(b[1] - a[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dl / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    kind = "id long, lon double, lat double"
    got = linkage.nearest(spark.createDataFrame(points, kind), spark.createDataFrame(places, kind)).collect()
    assert {r["point_id"]: r["place_id"] for r in got} == {p[0]: min(places, key=lambda q: (km(p, q), q[0]))[0] for p in points if p[1] is not None}
    assert linkage.nearest(spark.createDataFrame(points, kind), spark.createDataFrame([], kind)).count() == 0
    assert len(linkage.grid_sizes(spark.createDataFrame(places[:20], "place_id long, plon double, plat double"))) == 1


# -- graph -----------------------------------------------------------------------------------------------


def test_shortest_path(spark):
    rng = random.Random(2)
    edges = [(i, rng.randrange(30), rng.randrange(30), float(rng.randrange(1, 20))) for i in range(60)] + [(99, 100, 101, 1.0)]
    df = spark.createDataFrame(edges, "edge_id long, a long, b long, cost double")
    best = {0: 0.0}
    for _ in range(40):
        for _, a, b, c in edges:
            for x, y in ((a, b), (b, a)):
                if x in best and best[x] + c < best.get(y, math.inf):
                    best[y] = best[x] + c
    assert {r["node"]: r["cost"] for r in graph.distances(df, 0).collect()} == best
    end = max(best, key=best.get)
    path = graph.shortest_path(df, 0, end).orderBy("seq").collect()
    assert path[-1]["node"] == end and path[-1]["total"] == best[end] and [r["seq"] for r in path] == list(range(1, len(path) + 1))
    at, total = 0, 0.0
    by_id = {e[0]: e for e in edges}
    for r in path:
        _, a, b, c = by_id[r["edge_id"]]
        at = b if a == at else a
        total += c
        assert (at, total) == (r["node"], r["total"])
    assert graph.shortest_path(df, 0, 100).count() == 0 and graph.shortest_path(df, 0, 0).count() == 0
    with pytest.raises(ValueError):
        graph.shortest_path(df, 0, 5555)


def test_lines_lie_on_paths_between_their_nearest_places(spark):
    places = spark.createDataFrame([(i, float(i), 50.0) for i in range(6)], "id long, lon double, lat double")
    edges = spark.createDataFrame([(10 + i, i, i + 1, 1.0) for i in range(5)] + [(99, 0, 5, 2.5)], "edge_id long, a long, b long, cost double")
    lines = spark.createDataFrame(
        [(1, [(0.1, 50.1), (9.0, 1.0), (2.2, 49.9)]), (2, [(0.0, 50.0), (4.9, 50.2)]), (3, [(3.0, 50.0)]), (4, [(1.0, 50.0), (1.1, 50.0)])],
        "line_id int, points array<struct<lon:double,lat:double>>",
    )
    got = sorted(map(tuple, graph.edges_of_lines(lines, places, edges).collect()))
    assert got == [(1, 10), (1, 11), (2, 99)]
    pairs = spark.createDataFrame([(0, 2), (0, 5), (4, 4), (1, 77)], "source long, target long")
    paths = graph.all_paths(edges, pairs).orderBy("source", "target", "seq").collect()
    assert [(r["source"], r["target"], r["seq"], r["edge_id"]) for r in paths] == [(0, 2, 1, 10), (0, 2, 2, 11), (0, 5, 1, 99)]


# -- geometry ----------------------------------------------------------------------------------------------


def test_lengths(spark):
    line = lambda *p: "[" + ",".join(f"[{a},{b}]" for a, b in p) + "]"
    degree = f'{{"type":"LineString","coordinates":{line((0, 0), (1, 0))}}}'
    multi = f'{{"type":"MultiLineString","coordinates":[{line((0, 0), (1, 0))},{line((0, 0), (0, 1))}]}}'
    for text, want in [
        (degree, 111.19), (multi, 222.39), (f'{{"type":"GeometryCollection","geometries":[{degree},{degree}]}}', 222.39),
        ('{"type":"Point","coordinates":[1,2]}', None), ("kein json", None), (None, None), ('{"type":"FeatureCollection","features":[]}', None),
        (f'{{"type":"Feature","geometry":{degree}}}', 111.19),
    ]:
        assert one(spark, geo.geojson_km, text) == want, text


# -- text ------------------------------------------------------------------------------------------------------


def test_html(spark):
    html = "<html><SCRIPT a=1>var x='</p>';</SCRIPT><style>p{}</style><p>A&amp;B&nbsp;&lt;c&gt;</p>\n\n\n\n<b>x</b>\ty  z"
    assert one(spark, T.html_to_text, html) == "A&B <c> \n\n x y z"
    assert len(one(spark, T.html_to_text, "ab " * 9000)) == 12_000


@pytest.mark.parametrize("text, want", [("1.234", 1234), ("1,5", 15), (" 7 ", 7), ("", None), (None, None), ("k. A.", None), ("-3", -3)])
def test_parse_int(spark, text, want):
    assert one(spark, T.parse_int, text) == want


def test_floats(spark):
    assert [one(spark, T.parse_float, t) for t in ("12,5 %", "1.234,5", None)] == [12.5, None, None]
    assert [one(spark, T.parse_float_de, t) for t in ("1.234,5", "x", "")] == [1234.5, None, None]


def test_bullets_and_names(spark):
    cell = "Erläuterung:\nVorwort\n– Strecke A\nmit Tunnel\n- BÜ\n‐ \nStrecke B lang"
    assert one(spark, T.bullet_items, cell) == ["Strecke A mit Tunnel", "Strecke B lang"]
    assert one(spark, T.project_name, "SAMMELVEREINBARUNGEN\nSV Lph. 1/2\nA\nUnterlagen entsprechend § 24\ndavon:\nKap. 1") == "SV Lph. 1/2 A"


def test_status_flags(spark):
    df = spark.createDataFrame([("Neubau offen",), ("im Bau",), ("Inbetriebnahme 12/2020",), (None,), ("Überplanung",)], "t string")
    assert [tuple(r) for r in df.select(*T.status_flags(F.col("t"))).collect()] == [
        (True, False, False), (False, True, False), (False, False, True), (False, False, False), (False, False, False),
    ]


def test_contents_and_sections(spark):
    line = "B 4.1.1  L fd. Vorhaben Nr. 2 – ABS Lübeck (VDE Nr. 1) . . . . 17"
    assert tuple(one(spark, T.contents_entry, line)) == ("B.4.1.1", "Lfd. Vorhaben Nr. 2 – ABS Lübeck (VDE Nr. 1)")
    assert one(spark, T.section_category, "B.4.9.1") == "abgeschlossen" and one(spark, T.section_number, "B.4.2.17") == "17"


def test_section_tables(spark):
    rows_of = lambda block: one(spark, tables.section_table, block)
    pipe = "| Nr. PFA | Örtlichkeit |\n|---|---|\n| | verloren |\n| 1 | A | offen | - | 2020 |\n| | B |\n| Gruppe | | - |\n| 2.1 | C |"
    rows = rows_of(pipe)
    assert [(r["nr_pfa"], r["oertlichkeit"], r["abschnitt_label"], r["datum_pfb"]) for r in rows] == [("1", "A", None, "2020"), ("1", "B", None, None), ("2.1", "C", "Gruppe", None)]
    plain = rows_of("Nr. PFA\n1. Ausbaustufe X\n1 Ort in Überarbeitung 2020\n2 Lang\nname offen 1 2 3 4 5\nrest")
    assert [(r["nr_pfa"], r["oertlichkeit"], r["entwurfsplanung"], r["inbetriebnahme"]) for r in plain] == [("1", "Ort", "in", None), ("2", "Lang name", "offen", "4")]
    assert plain[0]["abschnitt_label"] == "1. Ausbaustufe X" and rows_of(None) == [] and rows_of(" \n\t\n") == []
    stages = rows_of("2. Baustufe Süd\n| 3 | D |\n| 1. Ausbaustufe | x |\n| Ort ohne Nummer | y |\n| | E | | | | | 2031 | zu viel |\n")
    assert [(r["abschnitt_label"], r["nr_pfa"], r["oertlichkeit"], r["inbetriebnahme"]) for r in stages] == [("2. Baustufe Süd", "3", "D", None), ("1. Ausbaustufe", "3", "E", "2031")]
    runs = rows_of("lose Zeile\n4 Ort\n2. Baustufe Ost\nweiter\n5.1 Feld offenbar\noffen\n6 abgeschlossen 1/2020")
    assert [(r["nr_pfa"], r["oertlichkeit"], r["entwurfsplanung"], r["abschnitt_label"]) for r in runs] == [
        ("4", "Ort weiter", None, None), ("5.1", "Feld offenbar", "offen", "2. Baustufe Ost"), ("6", None, "abgeschlossen", "2. Baustufe Ost"),
    ]
    assert runs[2]["abschluss_finve"] == "1/2020"


def test_remaining_text(spark):
    frame = spark.createDataFrame([("a\na\n\n\n\nb", ["a"]), ("Termine", None), (None, ["x"]), ("a.b a.b", ["a.b", None, ""])], "t string, u array<string>")
    assert [r[0] for r in frame.select(tables.remaining_text(F.col("t"), F.col("u"))).collect()] == ["a\n\nb", None, None, "a.b"]


# -- views -----------------------------------------------------------------------------------------------------------


def test_search_page_and_remap(spark):
    df = spark.createDataFrame([(1, "Aachen Hbf"), (2, "Bad_X"), (3, None)], "id int, name string")
    ids = lambda c: sorted(r["id"] for r in df.where(c).collect())
    assert ids(views.like_search("", "name")) == [] and ids(views.contains("AACH", "name")) == [1]
    assert ids(views.like_search("d_x", "name")) == [2] and ids(views.all_tokens("hbf aa", "name")) == [1]
    with pytest.raises(ValueError):
        views.page(df, 0, 0, F.col("id"))
    mapping = spark.createDataFrame([(1, 10)], "id int, new int")
    with pytest.raises(Exception, match="no new for"):
        views.remap(df, mapping, "id", "new").collect()


def test_group_selection(spark):
    groups = spark.createDataFrame([(1, None, True), (2, False, True), (3, True, False)], "group_id int, is_visible boolean, is_default boolean")
    ids = lambda df: sorted(r["group_id"] for r in df.collect())
    assert ids(views.selected_groups(groups, "all")) == [1, 3] and ids(views.selected_groups(groups, "x")) == [1]
    assert ids(views.selected_groups(groups, "x", [2, 3])) == [3]
    assert ids(views.selected_groups(groups.withColumn("is_default", F.lit(False)), "x")) == [1, 3]


def test_keep_newest(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 3), (None, 9, 4), ("b", None, 5)], "k string, e int, seq int")
    assert sorted(r["seq"] for r in views.keep_newest(df, "k", "e", "seq").collect()) == [2, 5]
