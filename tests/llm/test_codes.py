"""Product codes against a plain k-means on Python integers."""

import hashlib
import math

import numpy as np
import pytest

from trackledger.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, vid long"


def plain(rows, parts=4, entries=256, rounds=4):
    good = [r for r in rows if r[1] is not None and r[1] and len(r[1]) % parts == 0 and all(v is not None and math.isfinite(v) for v in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good:
        return []
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    size = len(good[0][1]) // parts
    x = [[[math.floor(1024 * v) for v in r[1][p * size : (p + 1) * size]] for p in range(parts)] for r in good]
    books = [[v[p] for v in x[:entries]] for p in range(parts)]

    def nearest(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(v[p], books[p])[1] for v in x]
            for e in set(at):
                mine = [v[p] for v, i in zip(x, at, strict=True) if i == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for r, v in zip(good, x, strict=True):
        found = [nearest(v[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), min(error, 2**63 - 1), r[2]))
    return [(*o[:3], min(by_label[o[3]], 2**63 - 1), sha) for o in out]


def rows_of(n, seed, width=8, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width)) * spread
    out = []
    for i in range(n):
        v = (centres[i % 7] + rng.normal(size=width) * 0.2 * spread).astype(np.float32)
        out.append((int(i), [float(c) for c in v], int(i % 5) if i % 9 else None, "x", 1))
    return out


ODD = [
    (901, None, 1, "", 0), (902, [1.0, None] * 4, 1, "", 0), (903, [math.nan] * 8, 1, "", 0), (904, [math.inf] + [0.0] * 7, 1, "", 0),
    (905, [], 1, "", 0), (906, [1.0] * 12, 1, "", 0), (907, [1.0] * 7, 2, "", 0), (None, [0.5] * 8, 3, "", 0), (None, [0.25] * 8, None, "", 0),
    (3, [0.125] * 8, 1, "", 0), (3, [0.125] * 8, 1, "", 0), (908, [-0.0] * 8, None, "", 0),
]


@pytest.mark.parametrize(("n", "entries"), [(400, 16), (300, 256), (60, 256), (5, 3)])
def test_against_plain_integers(spark, n, entries):
    rows = rows_of(n, n) + ODD
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in codes.compress(frame, entries=entries).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, entries=entries)))


def test_components_beyond_64_bits(spark):
    rows = rows_of(40, 3, spread=3e37) + [(77, [3e38, -3e38] * 4, 1, "", 0), (78, [1e30] * 8, None, "", 0), (79, [1.0] * 8, 4, "", 0)]
    rows = [(i, [float(np.float32(c)) for c in v], *rest) for i, v, *rest in rows]
    got = [tuple(r) for r in codes.compress(spark.createDataFrame(rows, SCHEMA), entries=8).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, entries=8)))


def test_equal_vectors_empty_tables_and_no_usable_vector(spark):
    rows = [(i, [0.5, -0.5, 0.25, 0.0], 1, "", 0) for i in range(700)]
    got = codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in got} == {("00000000", 0, 0)}
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    empty = codes.compress(spark.createDataFrame(ODD[:5], SCHEMA))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert empty.count() == 0


@pytest.mark.parametrize("kind", [np.int64, object])
def test_tree_search_keeps_the_lower_of_equal_entries(kind):
    rng = np.random.default_rng(1)
    for size in (1, 2, 9, 256):
        entries = rng.integers(-3, 4, (size, 4)).astype(kind)
        q = rng.integers(-4, 5, (500, 4)).astype(kind)
        index, d = codes.KdTree.build(entries).nearest(q)
        every = ((q[:, None] - entries[None]) ** 2).sum(axis=2).astype(np.int64)
        assert np.array_equal(index, every.argmin(axis=1))  # the first of equals
        assert np.array_equal(d.astype(np.int64), every.min(axis=1))


def test_search_leaves_nodes_out():
    rng = np.random.default_rng(2)
    entries = (rng.normal(size=(256, 4)) * 1000).astype(np.int64)
    q = entries[rng.integers(0, 256, 400)] + rng.integers(-20, 20, (400, 4))
    tree = codes.KdTree.build(entries)
    seen = []
    real = tree.try_leaf
    tree.try_leaf = lambda q, *rest: (seen.append(len(q)), real(q, *rest))
    tree.nearest(q)
    assert sum(seen) < 6 * len(q)  # of 32 leaves or more


def test_limbs():
    for v in (0, 5, -5, 2**60, -(2**60), 2**200 + 7, -(2**200) - 7):
        assert sum(x << (codes.LIMB * i) for i, x in enumerate(codes.limbs(v))) == v
        assert all(-(2**63) <= x < 2**63 for x in codes.limbs(v))


def test_bad_entries(spark):
    with pytest.raises(ValueError, match="entries"):
        codes.compress(spark.createDataFrame([], SCHEMA), entries=257)
