"""SimHash near-duplicates with bit-sliced comparison.

1. One Arrow pass turns each text into a fingerprint of one or more 64-bit words. The first
   word votes over the shingles' XXH64, further words over mixes of it.
2. Distinct fingerprints are dealt to tables. For a radius on 64 bits the bits are cut into
   ``radius + extra`` blocks and a table exists for every choice of ``extra`` blocks: two
   fingerprints within the radius spoil at most ``radius`` blocks, so some table has both
   under one key (exact). For a similarity on wide fingerprints a table keys by as many
   bits as the number of fingerprints asks for, and there are as many tables as find a pair
   at that similarity with probability ``recall``.
3. Within a key, fingerprints stand as vertical bit planes (64 lanes a machine word). For
   each lane distance the planes are XORed with themselves shifted, the difference bits go
   through a carry-save counter, and words whose lanes have all passed the radius, or
   which have no open pair, are abandoned. Lanes already known to be connected are closed,
   so a dense group costs a few passes instead of all pairs.
4. A task returns spanning links only; components are alternating-star rounds.

A key over ``bucket_cap`` fingerprints is cut into chunks and every pair of chunks becomes
its own group, so no task holds an unbounded group and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm.common import components, cut, fresh, lookup, spanning_labels

BITS = 64
SEGMENT = 255 * 64
#: Fingerprints for a similarity: words of 64 bits, chance to link at exactly the similarity.
WIDE_WORDS, CERTAINTY = 8, 1.645


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; all words when there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - width + 1
    return np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)),
        np.uint64,
        last,
    )


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hashes for one word of a fingerprint: as they are, or mixed with the word's number."""
    if not word:
        return h
    x = h ^ np.uint64((word * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprint_words(text: str | None, width: int, seed: int, words: int) -> np.ndarray:
    """Majority vote of the shingle hashes per bit; all zero for a text without words."""
    h = shingle_hashes(text or "", width, seed)
    if not len(h):
        return np.zeros(words, np.uint64)
    votes = np.zeros((words, BITS), np.int64)
    for k in range(words):
        x = mixed(h, k)
        for a in range(0, len(x), SEGMENT):
            raw = np.unpackbits(x[a : a + SEGMENT].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(raw) // 255 * 255  # sums of up to 255 bits fit a byte
            votes[k] += raw[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            votes[k] += raw[whole:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(h), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text."""
    return int(fingerprint_words(text, width, seed, 1)[0])


def fingerprints(docs: DataFrame, text_col: str, width: int = 4, seed: int = 42, words: int = 1) -> Column:
    """Fingerprint column for ``docs``: a signed long, or an array of them for several words."""

    @F.pandas_udf("long" if words == 1 else "array<long>")
    def mark(texts: pd.Series) -> pd.Series:
        out = [fingerprint_words(t, width, seed, words).view(np.int64) for t in texts]
        return pd.Series(np.concatenate(out)) if words == 1 and out else pd.Series(out, dtype=None if words == 1 else object)

    return mark(docs[text_col])


def to_planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of ``values`` (uint64, one or more words a row): row b holds bit b of every lane."""
    values = values.reshape(len(values), -1)
    lanes = -(-len(values) // 64) * 64
    padded = np.zeros((lanes, values.shape[1]), np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def pack_lanes(flags: np.ndarray, words: int) -> np.ndarray:
    padded = np.zeros(words * 64, np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def shifted(planes: np.ndarray, plane: int, words: np.ndarray, by: int) -> np.ndarray:
    """Words of one plane as seen ``by`` lanes further on (zeros past the end)."""
    whole, part = divmod(by, 64)
    row, n = planes[plane], planes.shape[1]
    at = words + whole
    low = np.where(at < n, row[np.minimum(at, n - 1)], np.uint64(0))
    if not part:
        return low
    high = np.where(at + 1 < n, row[np.minimum(at + 1, n - 1)], np.uint64(0))
    return (low >> np.uint64(part)) | (high << np.uint64(64 - part))


def close_lanes(planes: np.ndarray, by: int, open_words: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (packed) among ``open_words`` whose fingerprint lies within ``radius`` of the one ``by`` further on.

    ``over`` collects lanes past the radius; the count per lane stands in carry-save planes
    plus the overflow. Words with no lane left are dropped every eight planes.
    """
    depth = max(1, int(radius + 1).bit_length())
    result = np.zeros(len(words), np.uint64)
    alive = np.arange(len(words))
    at, live = words, open_words
    count = [np.zeros(len(words), np.uint64) for _ in range(depth)]
    over = np.zeros(len(words), np.uint64)
    for b in range(len(planes)):
        carry = planes[b][at] ^ shifted(planes, b, at, by)
        for k in range(depth):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 8 == 7 and b >= radius:
            beyond = over | exceeds(count, radius)
            over = beyond
            keep = (live & ~beyond) != 0
            if not keep.all():
                alive, at, live, over = alive[keep], at[keep], live[keep], over[keep]
                count = [c[keep] for c in count]
                if not len(alive):
                    return result
    result[alive] = live & ~(over | exceeds(count, radius))
    return result


def exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary counter is over ``radius``: compare from the highest plane down."""
    above = np.zeros_like(count[0])
    equal = ~above
    for k in range(len(count) - 1, -1, -1):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def link_block(group: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among equal ``group`` (rows sorted by it) whose values lie within ``radius`` bits."""
    n = len(values)
    planes = to_planes(values)
    n_words = planes.shape[1]
    label = np.arange(n)
    by = 0
    while True:
        by += 1
        if by >= n:
            break
        same = group[by:] == group[:-by]
        if not same.any():
            break
        open_ = pack_lanes(same & (label[by:] != label[:-by]), n_words)
        words = np.flatnonzero(open_)
        if not len(words):
            continue
        found = close_lanes(planes, by, open_[words], words, radius)
        hit = np.flatnonzero(found)
        if not len(hit):
            continue
        bits = np.unpackbits(found[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        left = words[hit][row] * 64 + lane
        merged = spanning_labels(n, np.concatenate((left, np.arange(n))), np.concatenate((left + by, label)))
        label = merged
    child = np.flatnonzero(label != np.arange(n))
    return values[label[child]], values[child]


def compare_partition(batches: Iterator[pd.DataFrame], radius: int, block: int) -> Iterator[pd.DataFrame]:
    """Links of a partition whose rows arrive sorted by (table, key, part); groups stay whole."""
    held: list[pd.DataFrame] = []
    rows = 0

    def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        t, key, part = (pdf[c].to_numpy() for c in ("t", "key", "part"))
        group = np.concatenate(([0], np.cumsum((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        fp = pdf["fp"].to_numpy()
        values = np.ascontiguousarray(np.stack(fp) if fp.dtype == object else fp).view(np.uint64)
        left, right = link_block(group, values, radius)
        if len(left):
            yield pd.DataFrame({"src": list(left.view(np.int64)), "dst": list(right.view(np.int64))})

    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        rows += len(pdf)
        if rows < block:
            continue
        pdf = pd.concat(held, ignore_index=True)
        last = pdf.iloc[-1]
        open_ = ((pdf["t"] == last["t"]) & (pdf["key"] == last["key"]) & (pdf["part"] == last["part"])).to_numpy()
        first = int(np.argmax(open_))
        if first:
            yield from work(pdf.iloc[:first])
        held, rows = [pdf.iloc[first:]], len(pdf) - first
    if rows:
        yield from work(pd.concat(held, ignore_index=True))


def table_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of the tables: every choice of ``blocks - radius`` of the blocks."""
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [sum(one[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]


def blocks_for(n: int, radius: int, per_key: int = 8) -> int:
    """Fewest blocks whose keys are long enough to hold ``per_key`` random fingerprints each."""
    for extra in range(1, 5):
        if n >> (BITS * extra // (radius + extra)) <= per_key:
            return radius + extra
    return radius + 4


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@dataclass(frozen=True)
class Exact:
    """64-bit fingerprints link at ``radius`` or fewer differing bits; every such pair is found."""

    radius: int = 4
    words: int = 1

    def keys(self, n: int) -> list[Column]:
        masks = table_masks(blocks_for(n, self.radius), self.radius)
        return [F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks]


@dataclass(frozen=True)
class Similar:
    """Wide fingerprints link when they speak for shingle sets of at least ``similarity``.

    Two sets of Jaccard similarity s have a cosine of about 2s / (1 + s), and each bit differs
    with probability acos(cosine) / pi. The radius lies ``CERTAINTY`` standard deviations over
    the mean, so a pair at exactly the similarity links with a chance of 0.95, and a pair is
    met in some table with a chance of at least ``recall``; both rise fast with the similarity.
    """

    similarity: float = 0.8
    words: int = WIDE_WORDS
    recall: float = 0.98
    per_key: int = 64

    @property
    def differing(self) -> float:
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi

    @property
    def radius(self) -> int:
        bits, p = self.words * BITS, self.differing
        return int(bits * p + CERTAINTY * math.sqrt(bits * p * (1 - p)))

    def shape(self, n: int) -> tuple[int, int]:
        """(bits of a key, number of tables) for ``n`` fingerprints."""
        width = max(4, min(48, (max(n, 1) // self.per_key).bit_length()))
        met = (1 - self.differing) ** width
        return width, 1 if met >= 1 else math.ceil(math.log(1 - self.recall) / math.log(1 - met))

    def keys(self, n: int) -> list[Column]:
        """Blocks of bits while unused ones are left, then choices drawn by a fixed seed."""
        width, tables = self.shape(n)
        per_word = BITS // width
        rng = np.random.default_rng(42)
        out = []
        for t in range(tables):
            word, block = t % self.words, t // self.words
            picked = range(block * width, (block + 1) * width) if block < per_word else rng.permutation(BITS)[:width].tolist()
            out.append(F.col("fp")[word].bitwiseAND(F.lit(signed(sum(1 << b for b in picked)))))
        return out


def fingerprint_links(marks: DataFrame, rule: Exact | Similar, bucket_cap: int = 4096, block: int = 1 << 16) -> DataFrame:
    """Spanning links ``(src, dst)`` between the distinct values of ``marks.fp`` that the rule links.

    Null fingerprints link with nothing.
    """
    distinct = cut(marks.select("fp").where("fp is not null").distinct())
    keys = rule.keys(distinct.count())
    dealt = distinct.select(F.posexplode(F.array(*keys)).alias("t", "key"), "fp")
    # Counted apart, map-side first: a key that most fingerprints share is gathered nowhere.
    sized = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(bucket_cap)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    parts = (
        dealt.join(sized, ["t", "key"])
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("part", F.least("own", "other") * F.col("chunks") + F.greatest("own", "other"))
        .select("t", "key", "part", "fp")
    )

    radius, kind = rule.radius, "long" if rule.words == 1 else "array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from compare_partition(batches, radius, block)

    found = parts.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part")
    return found.mapInPandas(run, f"src {kind}, dst {kind}").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    rule: Exact | Similar | None = None,
    seed: int = 42,
    bucket_cap: int = 4096,
    with_group: bool = False,
) -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` (signed long, or an array of them), ``component_id``.

    ``component_id`` is the smallest id reachable over links of the rule (at most four of 64
    bits unless another is given), the row's own included; rows with a null id take part and
    get their group's smallest id (null when the group has none). Null texts count as empty;
    texts without words share fingerprint 0. Repeated rows stay repeated; an empty table gives
    an empty result. Columns other than the two named are not looked at. ``with_group`` adds
    ``group_fp``, the smallest fingerprint of the component.
    """
    rule = rule or Exact()
    marks = cut(docs.select(F.col(id_col).alias("id"), fingerprints(docs, text_col, width, seed, rule.words).alias("fp")))
    per_fp = marks.groupBy("fp").agg(F.min("id").alias("low"))
    joined = components(fingerprint_links(marks, rule, bucket_cap))
    tied = cut(per_fp.join(joined.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "low"))
    lowest = tied.groupBy("component").agg(F.min("low").alias("lowest"))
    # A component may hold most fingerprints.
    linked = lookup(tied, cut(lowest), ["component"]).select("fp", "lowest", "component")
    root = per_fp.join(linked, "fp", "left").select(
        "fp", F.coalesce("lowest", "low").alias("component_id"), F.coalesce("component", "fp").alias("group_fp")
    )
    rows = lookup(marks, cut(root), ["fp"]).select(F.col("id").alias(id_col), "fp", "component_id", "group_fp")
    return rows if with_group else rows.drop("group_fp")


def keep_one_per_group(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    rule: Exact | Similar | None = None,
    seed: int = 42,
    bucket_cap: int = 4096,
) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    Rows with a null id go when their group has an id, else one of them stays. Among rows that
    share the winning id the one with the smallest row hash stays.
    """
    rule = rule or Exact()
    settings = {"text_col": text_col, "width": width, "rule": rule, "seed": seed, "bucket_cap": bucket_cap}
    found = cut(near_duplicates(docs, id_col=id_col, with_group=True, **settings))
    own = [F.col(f"`{c}`") for c in docs.columns]
    row_hash = F.xxhash64(*own)
    row, mark, group = (fresh(docs, n) for n in ("simhash_row", "simhash_fp", "simhash_group"))
    keep = found.where(F.col(id_col) == F.col("component_id"))
    named = docs.join(keep.select(id_col).distinct(), id_col, "left_semi").select(*docs.columns)
    if not keep.groupBy(id_col).count().where("count > 1").isEmpty():
        named = named.groupBy(F.col(f"`{id_col}`").alias(group)).agg(F.min_by(F.struct(*own), row_hash).alias(row)).select(f"{row}.*")
    orphans = found.where("component_id is null").select(F.col("fp").alias(mark), F.col("group_fp").alias(group)).distinct()
    if orphans.isEmpty():
        return named
    loose = docs.where(F.col(id_col).isNull()).withColumn(mark, fingerprints(docs, text_col, width, seed, rule.words))
    loose = lookup(loose, cut(orphans), [mark])
    # A minimum by aggregate: combined map-side, so a large group is gathered nowhere.
    loose = loose.groupBy(group).agg(F.min_by(F.struct(*own), F.struct(mark, row_hash)).alias(row)).select(f"{row}.*")
    return named.union(loose)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
