"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate ``target rows / rows it has``. Every document draws
its own copy count by inverting the Poisson distribution of that rate at a uniform number
hashed from (seed, key), so the draw is reproducible, needs no state and is independent of
partitioning. The copies are exploded and dealt out by a second hash: a global shuffle.

Source counts are a map-side-combined aggregate with one row per source, the inversion
compares the uniform number with the cumulative distribution. Up to ``MAX_LITERAL`` sources
the distributions are literals of the plan; more of them stay in a table that is joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trackledger.llm.common import cut, fresh

UNIT = float(2**32)
PART_RATE = 300.0
MAX_LITERAL = 1000
SALTS = 16
PLAN = "struct<parts:int,cdf:array<double>>"


def hashed_uniform(seed: int, key: Column) -> Column:
    """Uniform number in (0, 1): the first 32 bits of an MD5, at the middle of their cell."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(UNIT)


def tail_bound(rate: float) -> int:
    """Smallest k whose upper tail lies below the resolution of the uniform number."""
    term = total = math.exp(-rate)
    k = 0
    while 1.0 - total > 0.25 / UNIT and k < 20 * rate + 60:
        k += 1
        term *= rate / k
        total += term
    return k


def poisson_count(seed: int, key: Column, parts: Column, cdf: Column) -> Column:
    """Poisson draw of a key: steps of the cumulative distribution at or below the uniform number.

    A high rate is the sum of ``parts`` independent draws, each with its own uniform number.
    """

    def draw(total: Column, part: Column) -> Column:
        own = F.concat(key, F.when(part > 0, F.concat(F.lit("#"), part.cast("string"))).otherwise(""))
        uniform = hashed_uniform(seed, own)
        return total + F.size(F.filter(cdf, lambda p: p <= uniform))

    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), draw)


def parts_of(rate: float) -> int:
    """Number of draws that keep each one's rate at or below PART_RATE."""
    return max(1, math.ceil(rate / PART_RATE))


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... as far as a 32-bit uniform number can reach."""
    if rate > PART_RATE:
        raise ValueError("split the rate first: the distribution would underflow")
    term = total = math.exp(-rate)
    out = [total]
    for k in range(1, tail_bound(rate) + 1):
        term *= rate / k
        total += term
        out.append(total)
    return out


def checked(weights: Mapping[str | None, float]) -> dict[str | None, float]:
    if any(w < 0 or math.isnan(w) for w in weights.values()):
        raise ValueError("weights must not be negative")
    return dict(weights)


def source_rates(
    counts: Mapping[str | None, int], weights: Mapping[str | None, float] | None, total: int | None
) -> dict[str | None, float]:
    """Mean copies per document of every source.

    ``weights`` maps a source to its share of the output (normalised here; sources it does
    not name get none). ``None`` asks for equal shares. ``total`` is the expected output
    size, the input size when ``None``.
    """
    present = {s: n for s, n in counts.items() if n}
    wanted = {s: 1.0 for s in present} if weights is None else checked(weights)
    mass = sum(w for s, w in wanted.items() if s in present)
    size = sum(present.values()) if total is None else total
    return {s: (size * wanted.get(s, 0.0) / mass / n if mass else 0.0) for s, n in present.items()}


def literal_plan(source: Column, rates: Mapping[str | None, float]) -> Column:
    """Draws of a row's source out of literals."""
    draws = lambda r: F.struct(F.lit(parts_of(r)).alias("parts"), F.array(*map(F.lit, poisson_cdf(r / parts_of(r)))).alias("cdf"))
    plan = F.lit(None).cast(PLAN)
    named = [(s, r) for s, r in rates.items() if s is not None]
    if named:
        plan = F.try_element_at(F.create_map(*[x for s, r in named for x in (F.lit(s), draws(r))]), source)
    if None in rates:
        plan = F.when(source.isNull(), draws(rates[None])).otherwise(plan)
    return plan


def draws_of(rate: Column) -> Column:
    """The same draws for a column of rates."""

    @F.pandas_udf(PLAN)
    def draws(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [parts_of(r) for r in batch]
            cdf = [poisson_cdf(r / n) for r, n in zip(batch, parts, strict=True)]
            yield pd.DataFrame({"parts": pd.Series(parts, dtype="int32"), "cdf": pd.Series(cdf, dtype="object")})

    return draws(rate)


def join_plan(docs: DataFrame, counts: DataFrame, weights: Mapping[str | None, float] | None, total: int | None, key: Column, into: str) -> DataFrame:
    """``docs`` with the draws of each row's source in ``into``, for any number of sources.

    ``counts`` holds the rows ``n`` per source. A source is dealt over ``SALTS`` keys of the join.
    """
    source = counts.columns[0]
    mark, salt = fresh(docs, "mix_source"), fresh(docs, "mix_salt")
    known = cut(counts.withColumnRenamed(source, mark))
    if weights is None:
        known = known.withColumn("weight", F.lit(1.0))
    else:
        kind = StructType([StructField("named", known.schema[mark].dataType), StructField("weight", DoubleType())])
        given = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in checked(weights).items()], kind)
        known = known.join(given, F.col(mark).eqNullSafe(F.col("named")), "left").select(mark, "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = known.agg(F.sum("n").alias("rows"), F.sum("weight").alias("mass")).first()
    size, mass = sums["rows"] if total is None else total, sums["mass"]
    rate = F.lit(float(size)) * F.col("weight") / F.lit(mass) / F.col("n") if mass else F.lit(0.0)
    plans = known.select(mark, draws_of(rate).alias(into))
    # Cut, the distributions are worked out once per source and not once per salt.
    plans = cut(plans).select(mark, into, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    plans = plans.withColumnRenamed("salt", fresh(docs, "mix_plan_salt"))
    salted = docs.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    same = F.col(f"`{source}`").eqNullSafe(F.col(mark)) & (F.col(salt) == F.col(plans.columns[-1]))
    return salted.join(plans, same).select(*[F.col(f"`{c}`") for c in docs.columns], into)


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    total: int | None = None,
    source_col: str = "source",
    key_col: str = "doc_id",
    seed: int = 42,
    copy_col: str | None = None,
    order_col: str | None = None,
    max_sources: int | None = None,
) -> DataFrame:
    """Rows of ``docs`` replicated to the target weights and globally shuffled.

    Null sources form a source of their own; null keys hash as the empty text; repeated
    rows with one key draw the same count, each row for itself; an empty table stays empty.
    All columns are kept. ``copy_col`` and ``order_col`` name added columns (copy number
    from 0; shuffle key) when given. Any number of sources is taken, unless ``max_sources``
    asks for an error when there are more. A small source may have any rate.
    """
    counts = docs.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"))
    found = counts.limit(max(MAX_LITERAL, max_sources or 0) + 1).collect()
    if max_sources is not None and len(found) > max_sources:
        raise ValueError(f"{source_col} has more than {max_sources} values")
    plan_col = fresh(docs, "mix_plan")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    n_col, copy, order = (fresh(docs, n) for n in ("mix_n", copy_col or "mix_copy", order_col or "mix_order"))
    if len(found) <= MAX_LITERAL:
        rates = source_rates({r[0]: r[1] for r in found}, weights, total)
        drawn = docs.withColumn(plan_col, literal_plan(F.col(source_col), rates))
    else:
        drawn = join_plan(docs, counts, weights, total, key, plan_col)
    drawn = drawn.withColumn(n_col, poisson_count(seed, key, F.col(plan_col)["parts"], F.col(plan_col)["cdf"]))
    copies = (
        drawn.where(F.col(n_col) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n_col) - 1)))
        .withColumn(
            order,
            F.conv(
                F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key, F.lit("/"), F.col(copy).cast("string")).cast("binary")), 1, 15),
                16,
                10,
            ).cast("long"),
        )
        .drop(plan_col, n_col)
    )
    shuffled = copies.repartition(F.col(order)).sortWithinPartitions(order)
    if not copy_col:
        shuffled = shuffled.drop(copy)
    return shuffled if order_col else shuffled.drop(order)
