import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackledger.llm import tokencounts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ENCODER = tokencounts.load(PATH, PATTERN)


def slow(text, starts, rule):
    """Allocation of every token by looking at its characters one by one."""
    raw = text.encode()
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    section_of = [max(s for s, a in enumerate(starts) if a <= i) for i in range(len(text))]
    counts, touched, at = [0] * len(starts), [0] * len(starts), 0
    for t in ENCODER.encoding.encode_ordinary(text):
        n = len(ENCODER.encoding.decode_single_token_bytes(t))
        chars = sorted({char_of[k] for k in range(at, at + n)})
        at += n
        homes = [section_of[c] for c in chars]
        if rule == "start":
            home = homes[0]
        elif rule == "end":
            home = homes[-1]
        else:
            home = max(sorted(set(homes)), key=homes.count)
        counts[home] += 1
        if len(set(homes)) > 1:
            for h in set(homes):
                touched[h] += 1
    assert at == len(raw)
    return counts, touched


@pytest.mark.parametrize("rule", tokencounts.RULES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("ab \n.é漢"), st.characters(codec="utf-8")), max_size=60))
def test_allocation_equals_a_walk_over_characters(rule, text):
    starts = tokencounts.line_starts(text)
    got = tokencounts.allocate(*ENCODER.spans(text), np.append(starts, len(text)), rule)
    want = slow(text, starts.tolist(), rule) if text else ([0], [0])
    assert [g.tolist() for g in got] == [list(w) for w in want]
    assert got[0].sum() == len(ENCODER.encoding.encode_ordinary(text))


def test_rows_for_nulls_repeats_long_and_empty(spark):
    long = "one two\n" * 30_000
    rows = [(1, "a\n\n\n\nb", 1), (1, "a\n\n\n\nb", 1), (None, None, 2), (2**60 + 1, "", 3), (4, long, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, section int")
    got = tokencounts.count_tokens(docs, PATH, PATTERN)
    assert dict(got.dtypes)["doc_id"] == "bigint"
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(r["n_tokens"] for r in by[4]) == len(ENCODER.encoding.encode_ordinary(long)) and len(by[4]) == 30_000
    assert [tuple(r)[1:] for r in by[None]] == [(0, 0, 0, 0, 0)] and [tuple(r)[1:] for r in by[2**60 + 1]] == [(0, 0, 0, 0, 0)]
    assert len(by[1]) == 10
    assert tokencounts.count_tokens(docs.limit(0), PATH, PATTERN).count() == 0


def test_fields(spark):
    docs = spark.createDataFrame([("x", "title", "body text", None)], "k string, a string, b string, c string")
    got = tokencounts.count_tokens(docs, PATH, PATTERN, id_col="k", text_cols=("a", "b", "c"), lines=False, rule="start")
    rows = sorted(map(tuple, got.collect()))
    assert [r[:4] for r in rows] == [("x", 0, 0, 6), ("x", 1, 6, 16), ("x", 2, 16, 16)]
    assert sum(r[4] for r in rows) == len(ENCODER.encoding.encode_ordinary("title\nbody text\n"))
    with pytest.raises(ValueError):
        tokencounts.count_tokens(docs, PATH, PATTERN, rule="other")
