import math

import numpy as np
import pandas as pd
import pytest

from trackledger.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, pid long, n_links string"


def brute(rows):
    """(n_links, component) per row by comparing every pair."""
    n = len(rows)
    ok, unit = [], []
    for _, v, lab, *_ in rows:
        fine = v is not None and lab is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
        a = np.array(v, np.float32).astype(float) if fine else None
        fine = bool(fine and np.linalg.norm(a) > 0)
        ok.append(fine)
        unit.append(a / np.linalg.norm(a) if fine else None)
    links, at = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if float(unit[i] @ unit[j]) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    low, high = sorted((at[i], at[j]))
                    at = [low if x == high else x for x in at]
    smallest = {}
    for i in range(n):
        if rows[i][0] is not None:
            smallest[at[i]] = min(smallest.get(at[i], rows[i][0]), rows[i][0])
    return links, [smallest.get(c) for c in at]


@pytest.mark.parametrize("shard_rows", [8192, 40, 15])
def test_against_all_pairs(spark, shard_rows):
    rng = np.random.default_rng(2)
    rows = []
    for label in range(3):
        for _ in range(9):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 14))):
                rows.append((centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.27])).tolist() + [label])
    ids = rng.permutation(10_000)[: len(rows)]
    rows = [(int(i), r[:-1], r[-1], 0, "x") for i, r in zip(ids, rows, strict=True)]
    rows += [
        (20_001, None, 1, 0, ""), (20_002, [0.0] * 16, 1, 0, ""), (20_003, [math.nan] + [1.0] * 15, 1, 0, ""),
        (20_004, [None] + [1.0] * 15, 1, 0, ""), (20_005, [math.inf] * 16, 1, 0, ""), (20_006, rows[0][1], None, 0, ""),
        (20_007, [], 1, 0, ""), (20_008, [1.0, 2.0], 1, 0, ""), (20_009, [1.0, 2.0], 1, 0, ""), (None, rows[0][1], rows[0][2], 0, ""),
        (20_010, rows[5][1], rows[5][2], 0, ""), (20_010, rows[5][1], rows[5][2], 0, ""),
        (20_011, [-0.0, 1.0], 2, 0, ""), (20_012, [0.0, 1.0], 2, 0, ""),
    ]
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows).collect()
    links, comp = brute(rows)
    want = [(r[0], n, c, r[0] is not None and r[0] == c) for r, n, c in zip(rows, links, comp, strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_and_one_label_of_equal_vectors(spark):
    frame = spark.createDataFrame([(i, [1.0, 0.0], 7, 0, "") for i in range(500)], SCHEMA)
    got = vectors.near_duplicates(frame).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(499, 0)}
    assert sum(r["kept"] for r in got) == 1
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_graph_search_reaches_recall_and_audit_widens():
    rng = np.random.default_rng(4)
    points = vectors.unit_rows(np.repeat(rng.normal(size=(300, 24)), 8, axis=0) + 0.15 * rng.normal(size=(2400, 24)))
    index = vectors.SmallWorld(points, vectors.scramble(np.arange(2400)))
    truth = int((points @ points.T >= 0.93).sum())
    beam = vectors.audited_beam(index, points[:50], 0.93, 0.99)
    row, hit = vectors.links_of(index, points, beam, 0.93)
    assert len(row) >= 0.97 * truth
    assert (np.einsum("rd,rd->r", points[row], points[hit]) >= 0.93).all()
    assert len(set(zip(row.tolist(), hit.tolist(), strict=True))) == len(row)
    assert vectors.audited_beam(index, points[:50], 0.93, 1.01) == len(points)


def test_audit_counts_each_query_for_itself():
    rng = np.random.default_rng(6)
    dense = np.repeat(rng.normal(size=(1, 24)), 900, axis=0) + 0.02 * rng.normal(size=(900, 24))
    pairs = np.repeat(rng.normal(size=(30, 24)), 2, axis=0) + 0.02 * rng.normal(size=(60, 24))
    points = vectors.unit_rows(np.concatenate((dense, pairs)))
    index = vectors.SmallWorld(points, vectors.scramble(np.arange(len(points))))
    own = np.arange(895, 960)
    beam = vectors.audited_beam(index, points[own], 0.93, 0.99, beam=1, own=own)
    row, hit = vectors.links_of(index, points[900:], beam, 0.93)
    met = set(zip((row + 900).tolist(), hit.tolist(), strict=True))
    assert sum((i, i ^ 1) in met for i in range(900, 960)) >= 58


def test_planted_queries_audit_where_no_natural_query_has_a_link():
    rng = np.random.default_rng(11)
    points = vectors.unit_rows(rng.normal(size=(3000, 64)))
    marks = vectors.scramble(np.arange(3000))
    queries = vectors.planted(points, marks, 0.93)
    truth = queries @ points.T >= 0.93
    assert len(queries) == vectors.PLANTED_ROWS and truth.any(axis=1).all()
    assert ((points[:48] @ points.T >= 0.93).sum(axis=1) == 1).all()  # nothing but themselves
    index = vectors.SmallWorld(points, marks)
    beam = vectors.audited_beam(index, queries, 0.93, 0.99)
    fresh = vectors.planted(points, vectors.scramble(np.arange(7, 3007)), 0.93, 400)
    row, hit = vectors.links_of(index, fresh, beam, 0.93)
    assert len(row) >= 0.97 * (fresh @ points.T >= 0.93).sum()
    poor = vectors.SmallWorld(points, marks)
    poor.layers = poor.layers[:1]
    poor.layers[0].next[:, 3:] = -1  # most links cut: no narrow beam finds them
    assert vectors.audited_beam(poor, queries, 0.93, 0.99) > beam


def test_a_shard_survives_as_bytes():
    rng = np.random.default_rng(12)
    points = pd.DataFrame({"pid": np.arange(500), "n": np.ones(500, int), "vec": list(rng.normal(size=(500, 16)))})
    shard = vectors.Shard.build(points, 0.93)
    again = vectors.Shard.from_bytes(shard.to_bytes())
    assert again.beam == shard.beam and np.array_equal(again.pid, shard.pid)
    for one, other in zip(shard.asks(shard, 0.5), again.asks(again, 0.5), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(one, other, strict=True))


def test_links_count_for_both_ends(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (np.eye(8)[i % 4] + 0.08 * rng.normal(size=8)).tolist(), 1, 0, "") for i in range(400)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard_rows=60).collect()
    links, comp = brute(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {r[0]: (n, c) for r, n, c in zip(rows, links, comp, strict=True)}
