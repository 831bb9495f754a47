"""Best matches of names by the full name score, found through bounds.

The score is 0.6 of the matching-blocks ratio and 0.4 of the word share. Both sides are dealt
to chunks of bounded size; a task gets one chunk of either side, so the left side travels once
per right chunk and the other way round. In a task, three upper bounds come before the ratio:

1. Characters, pairs of neighbouring characters and words in common, for blocks of names at
   once, as products of count matrices. The product of two counts is no less than what both
   have in common, so rare marks may share a column.
2. The longest common subsequence, bit-parallel, for many pairs at once: matching blocks are
   one.
3. The word share itself.

With ``k`` best wanted, a pair whose bound is under the k-th best score so far is left out, so
few pairs meet the ratio, whatever they share. Results are those of comparing every pair.
"""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackledger.lineage import cut

FULL_WEIGHT, TOKEN_WEIGHT = 0.6, 0.4
#: Names per chunk: bounds what a task holds.
LEFT_CHUNK, RIGHT_CHUNK = 4096, 32768
LEFT_BLOCK, RIGHT_BLOCK = 512, 4096
#: Columns of the count matrices for characters, neighbours and words.
COLUMNS = (256, 768, 256)
#: Rounding of the bounds: single precision in blocks, double precision after.
LOOSE, SLACK = 1e-5, 1e-9
WORD_BITS = 64
WIDEST = 256


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def marks(name: str) -> tuple[list, list, list]:
    """Characters and neighbours with their occurrence numbers, and distinct words."""
    seen: Counter = Counter()
    chars, twos = [], []
    for bag, items in ((chars, name), (twos, map(str.__add__, name, name[1:]))):
        for x in items:
            seen[x] += 1
            bag.append((x, seen[x]))
    return chars, twos, sorted(set(name.split()))


class Names:
    """Marks of the names of a chunk, made once."""

    def __init__(self, names: list[str]):
        self.names = names
        self.marks = [marks(n) for n in names]
        self.size = np.array([len(n) for n in names], np.int64)
        self.words = np.array([len(m[2]) for m in self.marks], np.int64)

    def matrix(self, kind: int, columns: dict, a: int = 0, b: int | None = None) -> np.ndarray:
        """Counts per column of the names ``a`` to ``b``; marks without a column meet nothing."""
        part = self.marks[a:b]
        out = np.zeros((len(part), COLUMNS[kind]), np.float32)
        for row, m in enumerate(part):
            np.add.at(out[row], [columns[x] for x in m[kind] if x in columns], 1)
        return out


def numbered(side: Names, kind: int) -> dict:
    """A column per mark of the side: the commonest have one of their own, the others share the rest."""
    often = Counter(x for m in side.marks for x in m[kind])
    own = COLUMNS[kind] * 3 // 4
    rest = COLUMNS[kind] - own
    return {x: i if i < own else own + i % rest for i, (x, _) in enumerate(sorted(often.items(), key=lambda p: (-p[1], p[0])))}


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one long integer as bit vector."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Subsequences:
    """Longest common subsequences of left names with others, by 64-bit vectors in lockstep."""

    def __init__(self, left: Names):
        self.left = left
        # 0: no character of the left side
        self.codes = {c: i for i, c in enumerate(sorted({c for n in left.names for c in n}), 1)}

    def table(self, a: int, b: int) -> np.ndarray:
        """Per left name and character the places that hold it; names over 64 characters have none."""
        names = self.left.names[a:b]
        out = np.zeros((len(names), len(self.codes) + 1), np.uint64)
        for row, n in enumerate(names):
            if len(n) <= WORD_BITS:
                for i, c in enumerate(n):
                    out[row, self.codes[c]] |= np.uint64(1 << i)
        return out

    def spelled(self, right: Names) -> np.ndarray:
        """Character codes of right names, 0 padded; those over ``WIDEST`` characters are cut."""
        width = min(int(right.size.max(initial=0)), WIDEST)
        out = np.zeros((len(right.names), width), np.int32)
        for row, n in enumerate(right.names):
            got = [self.codes.get(c, 0) for c in n[:width]]
            out[row, : len(got)] = got
        return out

    def lengths(self, table: np.ndarray, at: int, right: Names, spelled: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Per pair of a row of ``table``, whose first name is the left name ``at``, and a right name."""
        v = np.full(len(i), np.iinfo(np.uint64).max, np.uint64)
        for x in range(min(spelled.shape[1], int(right.size[j].max(initial=0)))):
            u = v & table[i, spelled[j, x]]
            v = (v + u) | (v - u)
        out = np.bitwise_count(~v).astype(np.int64)
        for p in np.flatnonzero((self.left.size[at + i] > WORD_BITS) | (right.size[j] > WIDEST)):
            out[p] = common_subsequence(self.left.names[at + i[p]], right.names[j[p]])
        return out


class Best:
    """Pairs found so far; with ``k``, the best of each left name, by score and place of the right one."""

    def __init__(self, n: int, k: int | None, threshold: float):
        self.k = k
        self.held: list[list[tuple[float, int]]] = [[] for _ in range(n)]
        self.floor = np.full(n, threshold)

    def add(self, i: int, j: int, score: float) -> None:
        held = self.held[i]
        held.append((-score, j))
        if self.k and len(held) >= self.k:
            held.sort()
            del held[self.k :]
            self.floor[i] = max(self.floor[i], -held[-1][0])


def best_pairs(left: list[str], right: list[str], k: int | None, threshold: float, counts: Counter | None = None) -> list[tuple[int, int, float]]:
    """(left place, right place, score) of all pairs from ``threshold`` up, or of the ``k`` best of
    them per left name, the earlier right name first among equals. ``counts`` tells what each bound let through."""
    a = Names(left)
    columns = [numbered(a, kind) for kind in range(3)]
    ways = Subsequences(a)
    best = Best(len(left), k, threshold)
    counts = Counter() if counts is None else counts
    starts = range(0, len(left), LEFT_BLOCK)
    lefts = [([a.matrix(kind, columns[kind], s, s + LEFT_BLOCK) for kind in range(3)], ways.table(s, s + LEFT_BLOCK)) for s in starts]
    for s in range(0, len(right), RIGHT_BLOCK):
        b = Names(right[s : s + RIGHT_BLOCK])
        blocks = [b.matrix(kind, columns[kind]).T.copy() for kind in range(3)]
        spelled = ways.spelled(b)
        for at, (mine, table) in zip(starts, lefts, strict=True):
            size, words = a.size[at : at + LEFT_BLOCK, None], a.words[at : at + LEFT_BLOCK, None]
            chars, twos, shared = (m @ o for m, o in zip(mine, blocks, strict=True))
            total = size + b.size
            # m matching characters in c blocks hold m - c neighbours; every gap between blocks costs a character.
            matching = np.minimum(np.minimum(chars, np.minimum(size, b.size)), np.floor((total + 1 + twos) / 3))
            share = np.minimum(shared, np.minimum(words, b.words)) / np.maximum(words, b.words)
            bound = FULL_WEIGHT * 2 * matching / total + TOKEN_WEIGHT * share
            i, j = np.nonzero(bound >= best.floor[at : at + LEFT_BLOCK, None] - LOOSE)
            counts["pairs"] += bound.size
            counts["counted"] += len(i)
            for p in range(0, len(i), 1 << 18):
                x, y = i[p : p + (1 << 18)], j[p : p + (1 << 18)]
                length = ways.lengths(table, at, b, spelled, x, y)
                ratio_bound = FULL_WEIGHT * 2 * length / total[x, y]
                refine(a, b, at + x, y, ratio_bound, share[x, y], best, s, counts)
    return [(i, j, -negative) for i, held in enumerate(best.held) for negative, j in held]


def refine(a: Names, b: Names, i: np.ndarray, j: np.ndarray, ratio_bound: np.ndarray, share: np.ndarray, best: Best, start: int, counts: Counter) -> None:
    """Pairs that the counts let through: subsequence, word share, ratio; per left name the most promising first."""
    bound = ratio_bound + TOKEN_WEIGHT * share
    near = np.flatnonzero(bound >= best.floor[i] - LOOSE)
    counts["subsequence"] += len(near)
    for p in near[np.lexsort((j[near], -bound[near], i[near]))].tolist():
        x, y = int(i[p]), int(j[p])
        if bound[p] < best.floor[x] - LOOSE:
            continue
        mine, other = a.marks[x][2], b.marks[y][2]
        exact = len(set(mine) & set(other)) / max(len(mine), len(other))
        if ratio_bound[p] + TOKEN_WEIGHT * exact < best.floor[x] - SLACK:
            continue
        counts["ratio"] += 1
        score = FULL_WEIGHT * ratio(a.names[x], b.names[y]) + TOKEN_WEIGHT * exact
        if score >= best.floor[x]:
            best.add(x, start + y, score)


def chunks(rows: DataFrame, size: int) -> int:
    return max(1, math.ceil(rows.count() / size))


def matched(
    left: DataFrame, right: DataFrame, *, k: int | None, threshold: float, left_chunk: int = LEFT_CHUNK, right_chunk: int = RIGHT_CHUNK
) -> DataFrame:
    """``(a, b, score)``: for each distinct non-empty name ``a`` of ``left(a)`` the names ``b`` of ``right(b, b_id)``
    that score ``threshold`` or more, the ``k`` best of them per task if ``k`` is given: at most ``k`` times
    the right chunks per name, the best ``k`` of all among them. Ties go to the smaller ``b_id``.

    Names are normalised and distinct on their side; both frames are read twice.
    """
    if threshold <= 0:
        raise ValueError("threshold must be over 0")
    rows, columns = chunks(left, left_chunk), chunks(right, right_chunk)
    mine = left.select("a", F.pmod(F.xxhash64("a"), F.lit(rows)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"))
    other = right.select("b", "b_id", F.pmod(F.xxhash64("b"), F.lit(columns)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("b_id")
        names, others = x["a"].tolist(), y["b"].tolist()
        found = best_pairs(names, others, k, threshold) if names and others else []
        return pd.DataFrame([(names[i], others[j], score) for i, j, score in found], columns=["a", "b", "score"])

    return mine.groupBy("r", "c").cogroup(other.groupBy("r", "c")).applyInPandas(compare, "a string, b string, score double")


def lowest_ids(names: DataFrame, k: int) -> DataFrame:
    """``(name, id, r)``: the ``k`` smallest ids per name of ``names(id, name)``; the limit is applied before the shuffle."""
    by_id = Window.partitionBy("name").orderBy("id")
    return names.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k)


def top_scores(left: DataFrame, right: DataFrame, k: int, threshold: float, **chunk_sizes: int) -> DataFrame:
    """``(left_id, right_id, score)``: for each row of ``left(left_id, name)`` its ``k`` best of ``right(id, name)``
    from ``threshold`` up, ties to the smaller id. Names are normalised; null and empty ones match nothing.

    Names are compared once, however many rows share them.
    """
    lows = cut(lowest_ids(right.where("name is not null and name <> ''"), k))
    names = cut(left.where("name is not null and name <> ''").select(F.col("name").alias("a")).distinct())
    pairs = matched(names, lows.where("r = 1").select(F.col("name").alias("b"), F.col("id").alias("b_id")), k=k, threshold=threshold, **chunk_sizes)
    found = pairs.join(lows.select(F.col("name").alias("b"), F.col("id").alias("right_id")), "b")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "right_id")
    best = cut(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select(F.col("a").alias("name"), "right_id", "score"))
    return left.join(best, "name").select("left_id", "right_id", "score")
