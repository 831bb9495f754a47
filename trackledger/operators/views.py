"""List, search and lookup operators shared by the views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackledger.lineage import cut


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the predicates that are given: ``None`` leaves a column open."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in wanted.items() if v is not None), rows)


def contains(term: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns; an empty term matches nothing."""
    if not term:
        return F.lit(False)
    return reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False)) for c in columns])


def like_search(term: str, *columns: str) -> Column:
    """As ``contains``, with ``%`` and ``_`` in the term as wildcards."""
    if not term:
        return F.lit(False)
    return reduce(Column.__or__, [F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False)) for c in columns])


def all_tokens(query: str, column: str) -> Column:
    """Every word of the query occurs in the column, whatever the case; no word matches all."""
    words = query.lower().split()
    return reduce(Column.__and__, [F.contains(F.lower(F.col(column)), F.lit(w)) for w in words], F.lit(True))


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """One page under a total order; the limit must lie within 1 and 100."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return rows.orderBy(*order).offset(offset).limit(limit)


def global_position(rows: DataFrame, *order: Column | str, into: str = "pos") -> DataFrame:
    """``into``: the 1-based position of every row under a total order.

    Rows are dealt by ranges of the order and numbered within their range; the ranges'
    offsets come from their counts, one row per partition. No single task sees all rows.
    """
    part = "range_part"
    while part in rows.columns:
        part += "_"
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_offset"))  # one row per partition
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    numbered = ranged.join(F.broadcast(offsets), part).withColumn(into, own + F.col("range_offset"))
    return numbered.select(*rows.columns, into)


def missing_ids(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def remap(rows: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """``old`` ids replaced by ``new`` ones; an id without a partner is an error."""
    joined = rows.join(mapping.select(F.col(old).alias("map_old"), F.col(new).alias("map_new")), F.col(old) == F.col("map_old"), "left")
    ok = F.assert_true(F.col("map_new").isNotNull(), F.concat(F.lit(f"no {new} for "), F.col(old).cast("string")))
    return joined.where(ok.isNull()).select(*[c for c in rows.columns if c != old], F.col("map_new").alias(new))


def latest_links(links: DataFrame) -> DataFrame:
    """Links of the newest year per agreement; ties keep all rows; permanent links left out.

    The newest year per agreement is a combined aggregate joined back, so one agreement
    with many links is no window partition.
    """
    dated = links.where("haushalt_year is not null")
    newest = dated.groupBy("finve_id").agg(F.max("haushalt_year").alias("haushalt_year"))
    return dated.join(newest, ["finve_id", "haushalt_year"])


def active_links(links: DataFrame) -> DataFrame:
    """Permanent links and those of the newest year, duplicates kept."""
    return links.where("haushalt_year is null").unionByName(latest_links(links).select(*links.columns))


def keep_newest(rows: DataFrame, key: str, end: str, seq: str) -> DataFrame:
    """Per key the row valid the longest: null ends lose, the first of equals stays, null keys go."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last(end), seq)
    return rows.where(F.col(key).isNotNull()).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def overlay(default: DataFrame, override: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Defaults with fields replaced where an override row has them."""
    other = override.select(key, *[F.col(f).alias(f"o_{f}") for f in fields])
    return default.join(other, key, "left").select(*[F.coalesce(f"o_{c}", c).alias(c) if c in fields else F.col(c) for c in default.columns])


def fill_down(rows: DataFrame, group: Sequence[str], order: str, *columns: str) -> DataFrame:
    """Nulls take the last value above them within the group."""
    above = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*[F.last(c, ignorenulls=True).over(above).alias(c) if c in columns else F.col(c) for c in rows.columns])


def assemble(rows: DataFrame, group: Sequence[str], order: str, opens: Column) -> DataFrame:
    """``part`` numbers the blocks that opening rows start; rows before the first have 0."""
    above = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("part", F.sum(opens.cast("int")).over(above))


def first_group_wins(memberships: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key: that of the group that comes first."""
    return memberships.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in memberships.columns if c != key]), F.col(position)).alias("m")).select(key, "m.*")


def selected_groups(groups: DataFrame, mode: str, ids: Sequence[int] = ()) -> DataFrame:
    """Visible groups under a selection: all, the given ids, else the defaults, and all of
    them when none is a default. A null visibility counts as visible."""
    visible = groups.where(F.coalesce("is_visible", F.lit(True)))
    if mode == "all":
        return visible
    if ids:
        return visible.where(F.col("group_id").isin(*ids))
    none = visible.agg(F.coalesce(F.bool_or("is_default"), F.lit(False)).alias("any_default"))
    return visible.join(F.broadcast(none)).where(F.col("is_default") | ~F.col("any_default")).drop("any_default")  # one row


def active_labels(rows: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """``key, label``: the flags that hold, in long form."""
    pairs = F.array(*[F.struct(F.lit(f).alias("label"), F.col(f).alias("on")) for f in flags])
    return rows.select(key, F.explode(F.filter(pairs, lambda p: F.coalesce(p["on"], F.lit(False)))).alias("p")).select(key, "p.label")
