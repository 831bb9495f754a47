"""Line dedup: lines that many documents share stay in the first of them.

Normalised lines are exploded and hashed, distinct documents are counted per hash, lines over
the threshold go, and the text is put together again by position.

Only hashes, ids and positions travel by line; texts are shuffled once, when the positions of
the lines to drop come back to their document. The count of documents and the smallest id of a
key are combined before the shuffle, and the way back is a join that can split a frequent key,
so no task holds the lines of one key or more than one document at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm.common import cut, fresh

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
MIN_DOCS = 2


def lower_az(column: str) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(lines: Column, gone: Column) -> Column:
    """The array ``lines`` without the 0-based positions of ``gone``, an ascending array."""
    stops = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + F.lit(1)))
    return F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + F.lit(1), b - a)))


def drop_repeated(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    count_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """``docs`` with the text that stays, and two columns more: lines before, lines dropped.

    A key of at least ``min_chars`` code points that stands in at least ``min_docs`` documents
    loses all its lines, except in the document with the smallest id that holds it; there all
    of them stay, repeats included. Keys are compared by 128 bits of hash.

    A null or empty text is one empty line. Rows with one id are one document; rows without an
    id are one document, after all others. An empty table stays empty. Other columns stay as
    they are; ``count_col`` and ``dropped_col`` must be new names.
    """
    if {count_col.lower(), dropped_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"{count_col} or {dropped_col} is a column already")
    text, owner = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    # Rows with one id and one text have the same lines to drop, so these three name a row well enough.
    t1, t2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    split = docs.select(owner.alias("doc"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    bare = split.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.char_length("line") >= min_chars)
    lines = bare.select("doc", "t1", "t2", "pos", F.xxhash64(lower_az("line")).alias("k1"), F.xxhash64(F.lit(1), lower_az("line")).alias("k2"))
    n_docs = F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))
    per_key = lines.groupBy("k1", "k2").agg(n_docs.alias("n"), F.min("doc").alias("first"))  # null only if no id holds it
    # Cut, the shared keys bring no partitioning of their own, so the join can split a frequent key.
    shared = cut(per_key.where(F.col("n") >= min_docs).select("k1", "k2", "first"))
    h1, h2, at, kept, g1, g2, g3, g4 = (fresh(docs, f"line_{n}") for n in ("h1", "h2", "at", "kept", "g1", "g2", "g3", "g4"))
    gone = (
        lines.join(shared, ["k1", "k2"]).where(~F.col("doc").eqNullSafe(F.col("first")))
        .groupBy(F.col("t1").alias(g1), F.col("t2").alias(g2), F.col("doc").alias(g3)).agg(F.array_sort(F.collect_set("pos")).alias(g4))
    )
    joined = docs.withColumns({h1: t1, h2: t2}).join(
        gone, (F.col(h1) == F.col(g1)) & (F.col(h2) == F.col(g2)) & owner.eqNullSafe(F.col(g3)), "left"
    )
    parts = joined.withColumn(at, F.coalesce(F.col(g4), F.array().cast("array<int>"))).withColumn(kept, F.split(text, "\n"))
    return parts.withColumns(
        {text_col: F.array_join(without(F.col(kept), F.col(at)), "\n"), count_col: F.size(kept), dropped_col: F.size(at)}
    ).select(*docs.columns, count_col, dropped_col)


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """Per row: id, lines before, lines dropped, and the digest of the text that stays."""
    found = drop_repeated(docs.select("doc_id", "text"), **options)
    return found.select(
        "doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.sha2(F.col("text"), 256).alias("kept_sha256")
    )
