"""Queries whose work grew faster than their tables."""

import math
import random

import duckdb
import pytest
from compare import assert_equal
from pyspark.sql import functions as F

from trackledger.functions.tables import remaining_text, section_table
from trackledger.lineage import cut
from trackledger.operators import graph, linkage, reports
from trackledger.plans import ORACLES, QUERIES
from trackledger.plans import domain as P
from trackledger.plans import other_queries, source_queries


@pytest.fixture
def shuffled(spark):
    """Bytes that the shuffles of a plan write."""

    def run(df):
        df.collect()
        size, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            while node.nodeName() in ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
                node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan()
            if node.nodeName() == "Exchange":
                size += node.metrics().apply("shuffleBytesWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return size

    return run


def test_label_slices_shuffle_a_text_once(spark, tmp_path, shuffled):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    texts = ["the ".join(f"{word()} {word()} " for _ in range(300)) for _ in range(8)]
    texts += [None, "", "the", "the ", "the the ", "xthe ythe", "größe the 😀 the", " the end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["w08_label_slices"](spark, str(tmp_path))
    assert_equal(df, con, ORACLES["w08_label_slices"])
    assert shuffled(QUERIES["w08_label_slices"](spark, str(tmp_path))) < 4 * sum(len(t or "") for t in texts)


def test_a_number_brings_no_more_rows_than_wanted(spark, shuffled):
    n = 3000
    left = spark.range(n).selectExpr("id", "if(id % 3 = 0, 'VDE Nr. ' || id % 2, '') AS name")
    right = spark.range(n).selectExpr("id", "'x' AS name", "'VDE Nr. ' || id % 2 AS description").union(spark.createDataFrame([(0, "x", "VDE Nr. 0")], "id long, name string, description string"))
    scores = spark.createDataFrame([(0, 2, 0.9), (0, 7, 0.9), (1, 5, 0.8), (1, 4, 0.3), (3, 9, 0.7)], "left_id long, right_id long, score double")
    got = sorted(map(tuple, linkage.report_matches(left, right, scores).collect()))
    assert got == sorted([(i, i % 2 + 2 * k, 0, k + 1) for i in range(0, n, 3) for k in range(3)] + [(1, 5, 1, 1)])
    assert shuffled(linkage.report_matches(left, right, scores)) < 1 << 19


def test_budgets_round_exact_sums(spark, tmp_path):
    """0.1 and 0.7 in doubles add up to less than the half thousand that they make."""
    rows = [(1, 0.1, 0.5, "1995-03-01")] * 5000 + [(2, 0.7, 0.1, "1996-03-01")] * 15000
    frame = spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_discount double, day string")
    frame.selectExpr("*", "to_timestamp(day) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["fin_ve"]: (r["planned"], r["spent"]) for r in P.budgets(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0), 2: (11, 1)}


def budget_tables(spark, tmp_path):
    """Lines without a supplier, a day or an amount; suppliers that stand twice, without a number or without a line."""
    rows = [(1, 5000.0, 0.5, "1995-03-01"), (1, 7000.0, 0.1, "1998-03-01"), (2, None, 0.1, "1996-03-01"), (2, 9000.0, None, None), (3, None, None, "1998-01-01"), (None, 4000.0, 0.0, "1998-03-01"), (None, 3000.0, 0.5, "1997-03-01")]
    frame = spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_discount double, day string")
    frame.selectExpr("*", "to_timestamp(day) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (4,), (None,), (None,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    return con


def test_budgets_nest_under_a_supplier_number(spark, tmp_path):
    con = budget_tables(spark, tmp_path)
    assert_equal(QUERIES["j14_nested_load"](spark, str(tmp_path)), con, ORACLES["j14_nested_load"])


def test_budgets_without_a_supplier_are_overwritten(spark, tmp_path):
    con = budget_tables(spark, tmp_path)
    assert_equal(QUERIES["m04_overwrite_facts"](spark, str(tmp_path)), con, ORACLES["m04_overwrite_facts"])


def test_a_round_of_walks_reads_the_edges_where_they_lie(spark, monkeypatch):
    """The side of the edges has no shuffle above the kept copy; the copy is given back."""
    plans = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), cut(df))[1])
    edges = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(4)] + [(9, 0, 4, 2.5)], "edge_id long, a long, b long, cost double")
    got = sorted((r["node"], r["cost"], r["hops"], r["edge_id"]) for r in graph.distances(edges, 0).collect())
    assert got == [(0, 0.0, 0, None), (1, 1.0, 1, 0), (2, 2.0, 2, 1), (3, 3.0, 3, 2), (4, 2.5, 1, 9)]
    rounds = [p for p in plans if "edge_id" in p and "Join" in p]
    assert rounds and all("InMemoryTableScan" in p for p in rounds)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_the_edges_of_a_path_are_made_once(spark, sf_dir, monkeypatch):
    calls = []
    made = other_queries.supplier_edges
    monkeypatch.setattr(other_queries, "supplier_edges", lambda *a: (calls.append(a), made(*a))[1])
    assert QUERIES["j17_path_edges"](spark, sf_dir).count() > 0
    assert len(calls) == 1


def test_walks_are_bounded_in_every_component(spark, monkeypatch):
    """Rings of 12 vertices: each has landmarks of its own, and walks end well before half of a ring."""
    starts = []
    made = graph.all_distances
    monkeypatch.setattr(graph, "all_distances", lambda e, s, *a, **k: (starts.append(s), made(e, s, *a, **k))[1])
    ring = [(100 * r + i, 100 * r + i, 100 * r + (i + 1) % 12, 1.0) for r in range(3) for i in range(12)]
    pairs = [(100 * r + i, 100 * r + (i + 2) % 12) for r in range(3) for i in range(12)] + [(0, 100), (100, 205), (0, 999)]
    frame = spark.createDataFrame(ring, "edge_id long, a long, b long, cost double")
    got = sorted((r["source"], r["target"], r["seq"], r["node"], r["total"]) for r in graph.all_paths(frame, spark.createDataFrame(pairs, "source long, target long"), n_landmarks=2).collect())
    assert got == sorted((s, t, k, s // 100 * 100 + (s % 100 + k) % 12, float(k)) for s, t in pairs[:36] for k in (1, 2))
    most = [s.agg({"most": "max"}).first()[0] for s in starts if "most" in s.columns]
    assert most and max(most[:-1]) < 4 and most[-1] < 1.01
    marks = {r["node"]: (r["component"], r["far"]) for r in graph.landmark_costs(frame, 2).collect()}
    assert len(marks) == 36 and all(c == v // 100 * 100 and None not in far for v, (c, far) in marks.items())


def test_bounds_come_from_few_edges(spark, monkeypatch):
    """A dense graph: no walk, those of the landmarks included, is over all of its edges."""
    sizes = []
    made = graph.all_distances
    monkeypatch.setattr(graph, "all_distances", lambda e, *a, **k: (sizes.append(e.count()), made(e, *a, **k))[1])
    rng = random.Random(5)
    dense = [(60 * a + b, a, b, float(rng.randint(1, 50))) for a in range(60) for b in range(a)]
    frame = spark.createDataFrame(dense, "edge_id long, a long, b long, cost double")
    got = graph.all_paths(frame, spark.createDataFrame([(0, 59), (7, 30)], "source long, target long")).collect()
    assert {(r["source"], r["target"]) for r in got} == {(0, 59), (7, 30)}
    assert len(sizes) == 3 and max(sizes) < 480 < len(dense) / 2


def test_a_table_names_each_pattern_once(spark):
    """What a lambda's body names several times is worked out as often: patterns stand at one place each."""
    block = "2. Ausbaustufe\n1.5 Ort A\nNord\noffen 2020 2021\n2 Ort B abgeschlossen\n3. Baustufe\nRest\n4 Ort C\nWest"
    df = spark.createDataFrame([(block,), (None,)], "b string").select(section_table(F.col("b")).alias("s"))
    got = [[tuple(r)[:5] for r in row["s"]] for row in df.collect()]
    assert got == [[("2. Ausbaustufe", "1.5", "Ort A Nord", "offen", "2020"), ("2. Ausbaustufe", "2", "Ort B", "abgeschlossen", None), ("3. Baustufe", "4", "Ort C West", None, None)], []]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 15 and plan.count("regexp_extract") < 6


def test_what_remains_of_a_block_is_worked_out_once(spark):
    text = "B.4.1.3 ABS\nFußnote\nNoch umzusetzende Maßnahmen\n x\n#B 4.2.1\n4. Stufe\ndrucksache 20/1\nRest"
    df = spark.createDataFrame([(text,), ("Termine",), (None,)], "b string").select(remaining_text(F.col("b"), F.array(F.lit("x"))).alias("s"))
    assert [r["s"] for r in df.collect()] == ["Fußnote\n \n4. Stufe\nRest", None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_slices_are_found_behind_wide_characters(spark):
    texts = ["Kopf 😀😀\nVERKEHRLICHE  Zielſetzung\nZiel 😀\nteilinbetriebnahmen\n 2030 \nTermine\n", "Planungsſtand\nläuft\nNr. PFA Örtlichkeit\n1 A"]
    df = spark.createDataFrame([(t,) for t in texts], "b string").select(reports.label_slices(F.col("b")).alias("s"))
    got = [[tuple(x) for x in r["s"]] for r in df.collect()]
    assert got == [[("verkehrliche_zielsetzung", "Ziel 😀"), ("teilinbetriebnahmen", "2030")], [("planungsstand", "läuft"), ("pfa", "1 A")]]


def test_a_register_file_is_bounded(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "RECORDS_PER_FILE", 150, raising=False)
    monkeypatch.setattr(source_queries, "landing", lambda spark: f"{tmp_path}/landed")
    assert QUERIES["s09_track_parameters"](spark, sf_dir).count() == 2 * P.read(spark, sf_dir, "lineitem").count()
    sizes = [f.read_text().count("<SectionOfLine>") + f.read_text().count("<SectionOfLine ") for f in (tmp_path / "landed").glob("part-*")]
    assert sum(sizes) == P.read(spark, sf_dir, "lineitem").select("l_orderkey").distinct().count() and max(sizes) <= 150


def test_points_at_one_spot_are_one_search(spark, monkeypatch):
    """Copies of few spots: what the search writes between its grids does not grow with them."""
    seen = []
    monkeypatch.setattr(linkage, "cut", lambda df: (seen.append(df), cut(df))[1])
    points = spark.range(6000).selectExpr("id", "double(id % 6) AS lon", "double(50) AS lat").union(spark.createDataFrame([(9000, None, 1.0), (9001, -0.0, 50.0)], "id long, lon double, lat double"))
    places = spark.range(3000).selectExpr("3000 - id AS id", "id % 3 * 2.0D AS lon", "50.25D AS lat")
    got = {r["point_id"]: (r["place_id"], round(r["km"], 6)) for r in linkage.nearest(points, places).collect()}
    km = lambda a, b: round(2 * 6371.0 * math.asin(math.sqrt(math.sin(math.radians(0.125)) ** 2 + math.cos(math.radians(50)) * math.cos(math.radians(50.25)) * math.sin(math.radians(abs(a - b) / 2)) ** 2)), 6)
    first = {0.0: 3, 2.0: 2, 4.0: 1}
    spot = lambda i: float(i % 6) if i < 6000 else 0.0
    assert set(got) == {*range(6000), 9001}
    assert all(got[i] == min((km(spot(i), x), p) for x, p in first.items())[::-1] for i in got)
    assert max(df.count() for df in seen) <= 6
