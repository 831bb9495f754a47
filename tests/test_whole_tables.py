"""Queries over whole tables that have no SQL, against brute force on small tables."""

import collections
import heapq
import math
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from compare import connect

from trackledger.functions.names import PUNCTUATION, TYPE_PREFIX
from trackledger.operators import graph, linkage, matching
from trackledger.plans import QUERIES

NAMES = ["blue anvil", "blue bolt", "old bolt", "Anvil, blue", "hot gear", "hot gear wheel", "red widget", "red widgets", "x"]
#: Compound and hyphen-free spellings, typos: pairs without a common word.
NAMES += ["blueanvil", "hotgear", "redwidget", "bolts", "bolt", "bahnhof", "bahnhoff", "größe 𝔸", "größe𝔸", "abcd", "axbxcxd"]


def plain_score(a, b):
    a, b = (" ".join(re.sub(PUNCTUATION, " ", re.sub(TYPE_PREFIX, "", (t or "").lower())).split()) for t in (a, b))
    if not a or not b:
        return 0.0
    s, t = set(a.split()), set(b.split())
    return 0.6 * SequenceMatcher(None, a, b, autojunk=False).ratio() + 0.4 * (len(s & t) / max(len(s), len(t)))


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Parts from number 190 on, most of them past 200: names repeat."""
    folder = tmp_path_factory.mktemp("parts")
    rows = [(190 + i, NAMES[i * i % len(NAMES) if i % 4 else i % len(NAMES)]) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{folder}/part.parquet")
    return str(folder), dict(rows)


def ranked(rows, threshold):
    out = collections.defaultdict(list)
    for i, a in rows.items():
        found = sorted((-plain_score(a, b), j) for j, b in rows.items() if j != i)
        out[i] = [(-s, j) for s, j in found if -s >= threshold]
    return out


def test_linkage_takes_every_part_and_the_full_score(spark, parts):
    folder, rows = parts
    run = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())
    top = ranked(rows, 0.45)
    assert run("w02_top3_matches") == sorted((i, j, k + 1) for i in rows for k, (_, j) in enumerate(top[i][:3]))
    best = ranked(rows, 0.5)
    assert run("w03_best_match") == [(i, best[i][0][1], pytest.approx(best[i][0][0], abs=1e-4)) for i in sorted(rows) if best[i]]
    leaf = ranked(rows, 0.35)
    assert run("f52_leaf_choice") == [(i, i + 1000 if i % 5 == 0 or not leaf[i] else leaf[i][0][1]) for i in sorted(rows)]
    want = []
    for i in rows:
        strong = {j: (0, -1.0, j) for j in rows if i % 3 == 0 and i % 50 == j % 50}
        both = {j: (1, -s, j) for s, j in best[i]} | strong
        want += [(i, j, c, k + 1) for k, (c, _, j) in enumerate(sorted(both.values())[:3])]
    assert run("w04_priority_matches") == sorted(want)


def test_all_pairs_from_a_threshold_up(spark):
    rng = random.Random(3)
    texts = NAMES + ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))) for _ in range(60)] + [None, "", " - "]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    for threshold in (0.35, 0.6):
        want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if plain_score(a, b) >= threshold}
        got = linkage.matches(frame, frame, threshold, left_chunk=20, right_chunk=30).collect()
        assert len(got) == len({(r["left_id"], r["right_id"]) for r in got})
        assert {(r["left_id"], r["right_id"]) for r in got} == want
        assert all(r["score"] == pytest.approx(plain_score(texts[r["left_id"]], texts[r["right_id"]])) for r in got)


def test_best_matches_over_several_chunks_ties_and_repeats(spark):
    rng = random.Random(4)
    texts = [rng.choice(NAMES) + rng.choice(["", "", " strecke", "strecke", " neu", " - teil"]) for _ in range(150)]
    left, right = list(enumerate(texts[:60])), [(i * 7 % 150, t) for i, t in enumerate(texts)]
    for k, threshold in ((1, 0.35), (3, 0.45)):
        got = linkage.top_scores(
            spark.createDataFrame(left, "id long, name string"), spark.createDataFrame(right, "id long, name string"), k, threshold, left_chunk=10, right_chunk=12
        )
        want = []
        for i, a in left:
            found = sorted((-plain_score(a, b), j) for j, b in right)
            want += [(i, j, pytest.approx(-s)) for s, j in found[:k] if -s >= threshold]
        assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda w: w[:2])


SYLLABLES = "ber lin stadt hof burg dorf wald neu alt strecke bahn brueck feld hausen heim ing en er tal bach see weil rod au stein mark nord sued".split()


def compound_names(n, seed):
    rng = random.Random(seed)
    return sorted({" ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))) for _ in range(n)})


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.45), (None, 0.45), (1, 0.35)])
def test_few_compound_names_reach_the_ratio(k, threshold):
    names = compound_names(6000, 1)
    asked = names[::400]
    counts = collections.Counter()
    got = matching.best_pairs(asked, names, k, threshold, counts)
    assert counts["pairs"] == len(asked) * len(names)
    assert counts["ratio"] < 0.01 * counts["pairs"]
    for i, a in enumerate(asked):
        want = sorted((-plain_score(a, b), j) for j, b in enumerate(names) if plain_score(a, b) >= threshold)[:k]
        assert sorted((-s, j) for x, j, s in got if x == i) == [(pytest.approx(s), j) for s, j in want]


def test_a_word_in_every_name_and_very_long_names():
    rng = random.Random(6)
    names = ["strecke " + n for n in compound_names(700, 2)] + ["lang " * 60 + n for n in ("a", "b")] + ["x" * 300, "x" * 299 + "y"]
    counts = collections.Counter()
    asked = rng.sample(names, 12) + names[-4:]
    got = matching.best_pairs(asked, names, 3, 0.45, counts)
    assert counts["ratio"] < 0.05 * counts["pairs"]
    for i, a in enumerate(asked):
        want = sorted((-plain_score(a, b), j) for j, b in enumerate(names))[:3]
        assert sorted((-s, j) for x, j, s in got if x == i) == [(pytest.approx(s), j) for s, j in want if -s >= 0.45]


def test_longest_common_subsequence():
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 70))) for _ in range(40)]
    left, right = matching.Names(words), matching.Names(words[::-1])
    ways = matching.Subsequences(left)
    i, j = (x.ravel() for x in np.indices((40, 40)))
    got = ways.lengths(ways.table(0, 40), 0, right, ways.spelled(right), i, j)
    for x, y, n in zip(i, j, got, strict=True):
        a, b = words[x], words[39 - y]
        row = [0] * (len(b) + 1)
        for c in a:
            row = lcs_row(row, c, b)
        assert n == row[-1]


def lcs_row(row, c, b):
    out = [0]
    for m, d in enumerate(b):
        out.append(row[m] + 1 if c == d else max(row[m + 1], out[m]))
    return out


def test_section_to_subproject(spark):
    subs = [(1, 10, "Abzweig Nord"), (2, 10, "Bahnhof Süd"), (3, 10, "Bahnhof Süd"), (4, 11, "Knoten Mitte"), (5, 10, None), (6, 10, " ")]
    sections = [
        (1, 10, "Bahnhof", "2", "Süd"), (2, 10, "PFA", "1", "Abzweig-Nord"), (3, 11, "Bahnhof", None, "Süd"), (4, 10, None, " ", ""),
        (5, 12, "Knoten Mitte", None, None), (6, 11, "Knoten", "", "Mitte"), (7, 10, "qqq", "www", "zzz"),
    ]
    got = linkage.section_choice(
        spark.createDataFrame(sections, "section_id long, project_id long, label string, number string, place string"),
        spark.createDataFrame(subs, "id long, project_id long, name string"),
    )
    want = {}
    for i, project, *texts in sections:
        text = " ".join(t.strip() for t in texts if t and t.strip())
        found = sorted((-plain_score(text, n), j) for j, p, n in subs if p == project and n)
        want[i] = found[0][1] if text and found and -found[0][0] >= 0.35 else None
    assert {r["section_id"]: r["subproject_id"] for r in got.collect()} == want


def test_similarity_lists_pairs_without_a_common_word(spark, parts):
    folder, rows = parts
    plain = lambda t: " ".join(re.sub(PUNCTUATION, " ", t.lower()).split())
    names = sorted(set(rows.values()))
    want = []
    for a in names:
        for b in names:
            x, y = plain(a), plain(b)
            if x < y and (set(x.split()) & set(y.split()) or plain_score(a, b) >= 0.35):
                want.append((x, y, pytest.approx(plain_score(a, b), abs=1e-4)))
    assert ("blue anvil", "blueanvil") in [w[:2] for w in want]
    assert sorted(tuple(r) for r in QUERIES["f14_similarity"](spark, folder).collect()) == sorted(want, key=lambda w: w[:2])


def cheapest(cost, start):
    """Dijkstra: (cost, fewest edges among the cheapest) per vertex."""
    ways = collections.defaultdict(dict)
    for (a, b), c in cost.items():
        ways[a][b] = ways[b][a] = c
    best, heap = {}, [(0.0, 0, start)]
    while heap:
        c, hops, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = (c, hops)
        for w, more in ways[v].items():
            if w not in best:
                heapq.heappush(heap, (c + more, hops + 1, w))
    return best


def check_path(steps, start, end, ids, want):
    """The steps lead from start to end over edges of the graph, at the wanted cost and length."""
    at, total = start, 0.0
    for n, r in enumerate(sorted(steps, key=lambda r: r["seq"]), 1):
        a, b, c = ids[r["edge_id"]]
        assert r["seq"] == n and {a, b} == {at, r["node"]}
        at, total = r["node"], total + c
        assert r["total"] == pytest.approx(total)
    assert at == end
    assert (total, len(steps)) == (pytest.approx(want[0]), want[1])


def supplier_costs(sf_dir):
    con = connect(sf_dir)
    hops = con.sql("SELECT lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity), l_suppkey, l_quantity FROM lineitem").fetchall()
    cost = {}
    for x, y, q in hops:
        if x is not None and x != y:
            cost[min(x, y), max(x, y)] = min(q, cost.get((min(x, y), max(x, y)), q))
    return cost


def test_paths_use_every_order(spark, sf_dir):
    cost = supplier_costs(sf_dir)
    start, end = min(a for a, _ in cost), max(b for _, b in cost)
    ids = {a * (1 << 32) + b: (a, b, c) for (a, b), c in cost.items()}
    path = QUERIES["g01_shortest_path"](spark, sf_dir).collect()
    check_path(path, start, end, ids, cheapest(cost, start)[end])
    steps = QUERIES["j17_path_edges"](spark, sf_dir).collect()
    assert sorted((r["seq"], r["edge_id"]) for r in steps) == sorted((r["seq"], r["edge_id"]) for r in path)
    assert all(ids[r["edge_id"]] == (r["a"], r["b"], r["edge_cost"]) for r in steps)


@pytest.mark.parametrize(("n", "m", "seed"), [(50, 200, 1), (40, 45, 3)])
def test_paths_of_all_pairs_equal_dijkstra(spark, n, m, seed):
    rng = random.Random(seed)
    cost, rows = {}, []
    for i in range(m):
        a, b, c = rng.randrange(n), rng.randrange(n), float(rng.choice([0, 1, 1, 2, 3, 7, 30]))
        if (min(a, b), max(a, b)) not in cost and a != b:
            cost[min(a, b), max(a, b)] = c
            rows.append((i, a, b, c))
    ids = {i: (a, b, c) for i, a, b, c in rows}
    rows += [(1001, 1, 2, None), (1002, 3, 4, -5.0), (1003, None, 4, 1.0), (1004, 5, 5, 0.0)]
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(1, None), (None, 2), (3, 3), (1, 9999)]
    got = graph.all_paths(spark.createDataFrame(rows, "edge_id long, a long, b long, cost double"), spark.createDataFrame(pairs, "source long, target long"), n_landmarks=3).collect()
    found = collections.defaultdict(list)
    for r in got:
        found[r["source"], r["target"]].append(r)
    for s, t in set(pairs):
        want = cheapest(cost, s).get(t) if None not in (s, t) and s != t else None
        assert ((s, t) in found) == (want is not None)
        if want is not None:
            check_path(found[s, t], s, t, ids, want)


def test_paths_over_edges_that_no_end_has_among_its_cheapest(spark):
    """Dense groups in a ring, joined by dear edges only; a group of its own; edges that repeat and that end where they start."""
    rng = random.Random(9)
    groups, rows = [range(100 * g, 100 * g + 12) for g in range(5)], []
    add = lambda a, b, c: rows.append((len(rows), a, b, float(c)))
    for g in groups:
        for a in g:
            for b in range(g[0], a):
                add(a, b, rng.choice([1, 2, 2, 3]))
    for i, j in ((0, 1), (1, 2), (2, 3), (3, 0)):
        for _ in range(4):
            add(rng.choice(groups[i]), rng.choice(groups[j]), rng.choice([40, 41, 45]))
    for _ in range(12):
        add(5, 6, 7)
        add(5, 5, 0)
    ids = {i: (a, b, c) for i, a, b, c in rows}
    cost = {}
    for _, a, b, c in rows:
        if a != b:
            cost[a, b] = min(c, cost.get((a, b), c), cost.get((b, a), c))
    vertices = [v for g in groups for v in g]
    pairs = {tuple(rng.sample(vertices, 2)) for _ in range(120)}
    got = graph.all_paths(spark.createDataFrame(rows, "edge_id long, a long, b long, cost double"), spark.createDataFrame(sorted(pairs), "source long, target long"), n_landmarks=3).collect()
    found = collections.defaultdict(list)
    for r in got:
        found[r["source"], r["target"]].append(r)
    for s, t in pairs:
        want = cheapest(cost, s).get(t)
        assert ((s, t) in found) == (want is not None)
        if want is not None:
            check_path(found[s, t], s, t, ids, want)


def test_lines_are_laid_for_every_customer(spark, sf_dir):
    """Every line's edges make a cheapest path between the places nearest to its ends."""
    cost = supplier_costs(sf_dir)
    ids = {a * (1 << 32) + b: (a, b, c) for (a, b), c in cost.items()}
    spots = {v: (6 + v % 900 / 100.0, 47 + v % 800 / 100.0) for e in cost for v in e}

    def nearest(k):
        lon, lat = 6 + k % 900 / 100.0, 47 + k % 800 / 100.0

        def km(v):
            x, y = spots[v]
            h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
            return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

        return min(spots, key=lambda v: (km(v), v))

    got = collections.defaultdict(set)
    for r in QUERIES["g03_edges_of_lines"](spark, sf_dir).collect():
        got[r["line_id"]].add(r["edge_id"])
    customers = [r[0] for r in connect(sf_dir).sql("SELECT c_custkey FROM customer").fetchall()]
    for k in customers:
        s, t = nearest(k), nearest(7 * k)
        edges = {ids[e][:2] for e in got.get(k, ())}
        if s == t:
            assert not edges
            continue
        want = cheapest(cost, s)[t]
        assert (sum(cost[e] for e in edges), len(edges)) == (pytest.approx(want[0]), want[1])
        assert cheapest({e: cost[e] for e in edges}, s)[t] == want
