"""Text search through an index of trigrams.

The index is a table of postings ``(gram, side, id)``, a row per trigram of each searched column,
in buckets by the trigram's hash: one version of ``sources.versions``. A search reads the buckets of
its term's trigrams, intersects the postings by count, and lets the real predicate decide on the
rows that are left; so its rows are those of a scan. Terms without three letters in a row have no
trigram, and are looked for in all rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.operators import views
from trackledger.sources import versions

BUCKETS = 256


def grams(text: Column) -> Column:
    """Distinct trigrams of the text in lower case; none for null and for shorter texts."""
    low = F.lower(text)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    found = F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(3))))
    return F.when(F.length(low) >= 3, found).otherwise(F.array().cast("array<string>"))


def build(rows: DataFrame, path: str, id_col: str, *columns: str, buckets: int = BUCKETS) -> int:
    """Writes the index of the columns; ids must be unique. The number of its version."""
    sides = [rows.select(F.col(id_col).alias("id"), F.lit(side).alias("side"), F.explode(grams(F.col(c).cast("string"))).alias("gram")) for side, c in enumerate(columns)]
    return versions.publish(reduce(DataFrame.union, sides), path, bucket=versions.hashed(["gram"], buckets))


def postings(spark: SparkSession, path: str, wanted: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of the trigrams, from their buckets alone."""
    found = versions.record(spark, path)
    if found is None:
        raise ValueError(f"no index at {path}")
    asked = spark.createDataFrame([(g,) for g in wanted], "gram string")
    needed = {str(r[0]) for r in asked.select(versions.hashed(["gram"], buckets)).collect()}  # one per trigram of the term
    return versions.select_buckets(spark, path, found, needed).where(F.col("gram").isin(*wanted))


def holding(spark: SparkSession, path: str, texts: Sequence[str], buckets: int = BUCKETS) -> DataFrame | None:
    """``(id)`` of rows with a column that may hold all the texts; null where no text has a trigram."""
    # The term is the caller's literal, so its trigrams are worked out here.
    wanted = sorted({t[i : i + 3] for t in (x.lower() for x in texts) for i in range(len(t) - 2)})
    if not wanted:
        return None
    met = postings(spark, path, wanted, buckets).groupBy("id", "side").agg(F.count(F.lit(1)).alias("n"))
    return met.where(F.col("n") == len(wanted)).select("id").distinct()


def _narrowed(rows: DataFrame, path: str, id_col: str, texts: Sequence[str], predicate: Column, buckets: int) -> DataFrame:
    ids = holding(rows.sparkSession, path, texts, buckets)
    kept = rows if ids is None else rows.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi").select(*rows.columns)
    return kept.where(predicate)


def contains(rows: DataFrame, path: str, id_col: str, term: str, *columns: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows where any of the indexed columns holds the term, whatever the case; an empty term matches nothing."""
    return _narrowed(rows, path, id_col, [term], views.contains(term, *columns), buckets)


def like_search(rows: DataFrame, path: str, id_col: str, term: str, *columns: str, buckets: int = BUCKETS) -> DataFrame:
    """As ``contains``, with ``%`` and ``_`` in the term as wildcards; a backslash makes the next character plain."""
    pieces, plain = [""], re.findall(r"\\.|.", term, re.S)
    for c in plain:
        if c in "%_":
            pieces.append("")
        else:
            pieces[-1] += c[-1]
    return _narrowed(rows, path, id_col, pieces, views.like_search(term, *columns), buckets)


def all_tokens(rows: DataFrame, path: str, id_col: str, query: str, column: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows whose column holds every word of the query; the index must be of that column alone."""
    return _narrowed(rows, path, id_col, query.lower().split(), views.all_tokens(query, column), buckets)
