"""Helpers the training-data operators share: scratch names, lineage cuts, components."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.lineage import cut

__all__ = ["components", "crc_mod", "cut", "fresh", "lookup", "sigmoid", "spanning_labels", "table", "union_all"]


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null ids give null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def spanning_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index per vertex of an undirected graph held in memory."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def lookup(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``small``, which has one row per key, when a key may hold most rows.

    Keys with more than a quarter of a task's fair share of the rows are joined by broadcast:
    whatever the input, there are at most four of them per shuffle partition. The other rows
    are shuffled by key, so no task gets much over its share. ``how`` is inner or left; null
    keys match nothing.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("lookup_n")))
    total = held.agg(F.sum("lookup_n")).first()[0] or 0
    heavy = cut(held.where(F.col("lookup_n") * (4 * tasks) > total).select(*keys))
    known = F.broadcast(small.join(F.broadcast(heavy), keys, "left_semi"))
    few = F.broadcast(heavy)
    hot = rows.join(few, keys, "left_semi").join(known, keys, how)
    return hot.union(rows.join(few, keys, "left_anti").join(small, keys, how))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(src, dst)`` as ``(node, component)``.

    Alternating large-star and small-star rounds until the edge set stands still; every
    node then points at the smallest node of its component. Self loops and nulls are
    ignored; a node without an edge to another node gets no row. The per-node minimum is
    a map-side-combined aggregate joined back, so a hub is neither gathered in one task
    nor broadcast.
    """
    now = cut(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    before = None
    while True:
        mark = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        mark = (mark["n"], mark["h"])
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
        before = mark
        both = now.union(now.select("v", "u"))
        # Cut, the minima bring no partitioning of their own, so AQE can split a hub's links.
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        now = cut(small.select("e.u", "e.v").where("u != v").distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
