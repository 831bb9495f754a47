"""Line dedup against sets of documents per line."""

import hashlib

import pytest

from trackledger.llm import lines

SCHEMA = "doc_id long, text string, gone string, pos int, line_h1 long"
BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=10, min_docs=2):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    owners = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                owners.setdefault(key(line), set()).add((i is None, i or 0))
    out = []
    for i, text, *rest in rows:
        mine = (text or "").split("\n")
        stay = []
        for line in mine:
            held = owners.get(key(line), ())
            if len(held) < min_docs or min(held) == (i is None, i or 0):
                stay.append(line)
        out.append((i, "\n".join(stay), *rest, len(mine), len(mine) - len(stay)))
    return out


ROWS = [
    (1, "a shared line here\nown line of one\n\nshort\n", "g", 1, 5), (2, "  A SHARED line HERE\t\nanother own line\nshort", "g", 1, 5),
    (3, "a shared line here\na shared line here\r\n", None, None, None), (4, None, "", 0, 0), (5, "", "", 0, 0), (6, "\n\n", "", 0, 0),
    (None, "a shared line here\nonly without an id", "", 0, 0), (None, "only without an id\nlast of all lines", "", 0, 0),
    (9, "last of all lines", "", 0, 0), (9, "last of all lines\nlast of all lines\nx", "", 0, 0), (9, "twice in one id\nrest", "", 0, 0),
    (9, "twice in one id\nrest", "", 0, 0), (12, "Größe äöü ß\nten chars!\nnine char", "", 0, 0), (11, "größe äöü ß\nTEN CHARS!\nnine char", "", 0, 0),
    (13, "GRÖSSE über\n\xa0ten chars!", "", 0, 0), (14, "größe über!\n\xa0ten chars!\n\xa0TEN chars!\x0b", "", 0, 0), (15, "😀😀😀😀😀😀😀😀😀😀", "", 0, 0),
    (-3, "😀😀😀😀😀😀😀😀😀😀\n😀😀😀😀😀😀😀😀😀", "", 0, 0), (16, "😀😀😀😀😀😀😀😀😀", "", 0, 0), (17, "a\x00b a\x00b a\x00b\ntail", "", 0, 0), (18, "A\x00b a\x00b a\x00b", "", 0, 0),
]


@pytest.mark.parametrize(("min_chars", "min_docs"), [(10, 2), (1, 3), (0, 1), (5, 50)])
def test_against_sets(spark, min_chars, min_docs):
    frame = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = lines.drop_repeated(frame, min_chars=min_chars, min_docs=min_docs)
    assert got.columns == [*frame.columns, "n_lines", "n_dropped"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(ROWS, min_chars, min_docs)))


def test_digests(spark):
    got = lines.line_digests(spark.createDataFrame(ROWS, SCHEMA)).collect()
    want = [(r[0], r[-2], r[-1], hashlib.sha256(r[1].encode()).hexdigest()) for r in plain(ROWS)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_long_texts_a_line_of_all_documents_and_an_empty_table(spark):
    rows = [(i, "the same line everywhere\n" + "\n".join(f"line {j // 2} of some" for j in range(i)), "", 0, 0) for i in range(300)]
    rows.append((1000, "\n".join(f"line {j} of some" for j in range(50_000)) + "\n" + "w" * 1_000_000, "", 0, 0))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = lines.drop_repeated(frame).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))
    assert lines.drop_repeated(frame.limit(0)).count() == 0


def test_names_that_are_taken(spark):
    frame = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, N_LINES int")
    with pytest.raises(ValueError, match="n_lines"):
        lines.drop_repeated(frame)
