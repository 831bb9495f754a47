import numpy as np
import pytest
import xxhash

from trackledger.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp int, component_id int"


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, radius):
    at = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                low, high = sorted((at[i], at[j]))
                at = [low if x == high else x for x in at]
    return at


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B c", "É é A\x0bB\x1cC d e", "x " * 500, "a b c d e f"])
def test_fingerprint_matches_plain_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_block_links_equal_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = []
    for b in base:
        for _ in range(25):
            flips = rng.integers(0, 64, rng.integers(0, 9))
            for f in flips:
                b = b ^ (np.uint64(1) << np.uint64(f))
            values.append(b)
    values = np.unique(np.array(values, np.uint64))
    left, right = simhash.link_block(np.zeros(len(values), int), values, radius)
    index = {int(v): i for i, v in enumerate(values)}
    got = simhash.spanning_labels(
        len(values), np.array([index[int(v)] for v in left], int), np.array([index[int(v)] for v in right], int)
    )
    assert got.tolist() == slow_components([int(v) for v in values], radius)


@pytest.mark.parametrize("cap", [4096, 3])
def test_whole_operator_against_brute_force(spark, cap):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    rows, texts = [], []
    for _ in range(12):
        words = list(rng.choice(vocab, 120))
        for k in range(6):
            edit = list(words)
            for p in rng.integers(0, 120, k // 2):
                edit[p] = "zz"
            texts.append(" ".join(edit))
    texts += [None, "", "   ", "word", "word"]
    ids = rng.permutation(1000)[: len(texts)].tolist()
    rows = [(i, t, "x", 1, 2) for i, t in zip(ids, texts, strict=True)] + [(None, texts[0], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = simhash.near_duplicates(docs, bucket_cap=cap).collect()
    assert len(got) == len(rows)
    values = [slow_fingerprint(r[1]) for r in rows]
    label = slow_components(values, 4)
    want = sorted(
        (str(r[0]), v, min(rows[j][0] for j in range(len(rows)) if label[j] == c and rows[j][0] is not None))
        for r, v, c in zip(rows, values, label, strict=True)
    )
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got) == want
    kept = simhash.keep_one_per_group(docs, bucket_cap=cap)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})


def test_long_text_ties_and_empty_table(spark):
    long = "alpha beta gamma delta " * 40_000
    docs = spark.createDataFrame([(1, long, None, 0, 0), (1, long, None, 0, 0), (2, long, None, 0, 0)], SCHEMA)
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1}
    assert simhash.keep_one_per_group(docs).count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b", None, 0, 0), (None, "a b", None, 0, 1)], SCHEMA)
    assert [r["component_id"] for r in simhash.near_duplicates(nulls).collect()] == [None, None]
    assert simhash.keep_one_per_group(nulls).count() == 1


def test_wide_fingerprints_vote_over_mixed_hashes():
    text = "one two three four five six seven eight nine ten " * 30
    h = simhash.shingle_hashes(text, 5, 42)
    got = simhash.fingerprint_words(text, 5, 42, 3)
    for k in range(3):
        x = simhash.mixed(h, k)
        want = sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x) > len(h))
        assert int(got[k]) == want
    assert int(got[0]) == simhash.fingerprint(text, 5)


def jaccard(a, b, width=5):
    x, y = (set(simhash.shingle_hashes(t, width, 42).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_are_found_and_others_left(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocab, 300))
        rows.append((10 * i, " ".join(words)))
        for k in (1, 2):
            edit = list(words)
            for p in rng.choice(300, 2 * k, replace=False):
                edit[p] = "zz"
            rows.append((10 * i + k, " ".join(edit)))
        for p in rng.choice(300, 60, replace=False):
            words[p] = "yy"
        rows.append((10 * i + 5, " ".join(words)))
    assert all(jaccard(rows[4 * i][1], rows[4 * i + k][1]) >= 0.85 for i in range(60) for k in (1, 2))
    assert all(jaccard(rows[4 * i][1], rows[4 * i + 3][1]) < 0.5 for i in range(60))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one_per_group(docs, width=5, rule=simhash.Similar(0.8)).collect()}
    assert {10 * i for i in range(60)} | {10 * i + 5 for i in range(60)} <= kept
    assert sum(10 * i + k in kept for i in range(60) for k in (1, 2)) <= 2


def test_hot_keys_are_split_from_the_join(spark):
    from trackledger.llm.common import lookup

    rows = spark.createDataFrame([(i, 7 if i % 3 else i, None) for i in range(300)] + [(-1, None, None)], "id long, k long, k2 string")
    small = spark.createDataFrame([(i, str(i)) for i in range(0, 300, 2)] + [(7, "7")], "k long, v string")
    assert sorted(map(str, lookup(rows, small, ["k"]).collect())) == sorted(map(str, rows.join(small, ["k"]).collect()))
    assert sorted(map(str, lookup(rows, small, ["k"], "left").collect())) == sorted(map(str, rows.join(small, ["k"], "left").collect()))
