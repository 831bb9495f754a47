"""The queries that have SQL against it; the pipeline against a brute-force version."""

import collections
import hashlib
import sys

import public_tokenizers
import pytest
import sentencepiece

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from compare import assert_equal, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from trackledger.llm import mixing, quality, queries, simhash, sql, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert_equal(queries.QUERIES[name](spark, sf_dir), duck, sql.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_a_row_per_input_row(spark, sf_dir, name):
    n = queries.QUERIES[name](spark, sf_dir).count()
    per_doc = {f"op{i}_" for i in (2, 4, 6, 9, 10)}
    if any(name.startswith(p) for p in per_doc):
        assert n == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    else:
        assert n > 0


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = [r for r in quality.score_quality(docs, labels).collect() if r["score"] >= 0.3]
    frame = spark.createDataFrame(good).drop("score")
    civil = [r for r in toxicity.score_toxicity(frame, labels).collect() if r["score"] < 0.3]
    rule = simhash.Similar(0.8)
    marks = {r["doc_id"]: int.from_bytes(simhash.fingerprint_words(r["text"], 5, 42, rule.words).tobytes(), "little") for r in civil}
    lowest = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for a in marks:
            for b in marks:
                if (marks[a] ^ marks[b]).bit_count() <= rule.radius and lowest[b] > lowest[a]:
                    lowest[b], changed = lowest[a], True
    first = [r for r in civil if lowest[r["doc_id"]] == r["doc_id"]]
    counts = collections.Counter(r["source"] for r in first)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = collections.Counter()
    for r in first:
        u = (int(hashlib.md5(f"{queries.MIX_SEED}:{r['doc_id']}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        n = sum(p <= u for p in mixing.poisson_cdf(len(first) / len(counts) / counts[r["source"]]))
        ids = lib.encode(r["text"])
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[(r["doc_id"], len(ids), sha, hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += n
    out = corpus_pipeline.run(spark, sf_dir)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
    assert got == +want


def test_stages_keep_the_columns_and_cope_with_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0)], docs.schema)
    docs = docs.union(odd).union(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
