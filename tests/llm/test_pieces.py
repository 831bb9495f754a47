import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from trackledger.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.load(PATH)
CASES = [
    "", " ", "  ", "a", " a", "a  b", "a\nb", "\na", "a \nb", "a\n b", "▁x", "x ▁ y", "a\x00b", "<s>", "</s> <unk> <0x41>",
    "�", "tab\tnew\r\nline", "\U0001d518é", "aaaaaaaaaaaaaaaaaaaa", "ababababababab", "  lead and trail  ", "And And And",
    "漢字かな", "é", "=" * 300, " " * 500, "hahahahahaha", "1234567890" * 20, "\n\n\n",
]


@pytest.mark.parametrize("text", CASES)
def test_encode_and_decode_equal_the_library(text):
    ids = LIB.encode(text)
    assert MODEL.encode(text) == ids
    assert MODEL.decode(ids) == LIB.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aehnost \n.,▁é"), st.characters(codec="utf-8")), max_size=80))
def test_random_texts(text):
    ids = LIB.encode(text)
    assert MODEL.encode(text) == ids
    assert MODEL.decode(ids) == LIB.decode(ids)


def test_random_ids_decode_like_the_library():
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(0, 262) if rng.random() < 0.6 else rng.randrange(0, 32000) for _ in range(rng.randrange(1, 9))]
        assert MODEL.decode(ids) == LIB.decode(ids), ids


def test_segments_join_to_the_whole(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "be", "\nnew", "", "x▁y", "gamma,"], k=4000))
    monkeypatch.setattr(pieces, "SEGMENT_CHARS", 100)
    parts = [w for words in MODEL.segments(text, 100) for w in words]
    assert [i for w in parts for i in MODEL.merge_rounds([w])[0]] == LIB.encode(text)
    (row,) = pieces.digest_texts(MODEL, [text])
    ids = LIB.encode(text)
    assert row == digests(ids)


def digests(ids):
    ids = list(ids)
    return (
        len(ids),
        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(LIB.decode(ids).encode()).hexdigest(),
    )


def test_small_table_of_words(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 5)
    model = pieces.PieceModel(PATH)
    texts = ["one two three four five six seven", "eight nine ten", None, ""]
    assert list(pieces.digest_texts(model, texts)) == [digests(LIB.encode(t or "")) for t in texts]
    assert model.encode(texts[0]) == LIB.encode(texts[0])


def test_columns(spark):
    long = "lorem ipsum dolor " * 60_000
    rows = [(1, "x", "a"), (1, "x", "a"), (None, None, None), (2, "", "b"), (3, long, "c"), (4, "été\n", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    got = pieces.token_digests(docs, PATH, into="found").collect()
    assert sorted(map(str, [tuple(r["found"]) for r in got])) == sorted(str(digests(LIB.encode(t or ""))) for _, t, _ in rows)
    back = pieces.decode_column(pieces.encode_column(docs, PATH, into="ids"), PATH, ids_col="ids", into="back").collect()
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert pieces.token_digests(docs.limit(0), PATH, into="found").count() == 0
