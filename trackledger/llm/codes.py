"""Product codes of vectors: k-means per part of the vector, with kd-tree search.

Vectors become integers, floor(1024 x), and are cut into consecutive parts. Every part position
has a codebook. In each round a kd-tree per codebook is broadcast (its size is set by ``parts``
and ``entries``, not by the table), tasks search the nearest entry of every part by branch and
bound, and emit integer sums per entry; Spark adds them up, and the driver divides. A last
search yields codes and errors.

All arithmetic is on integers: 64-bit ones where squared distances are sure to fit, Python's
where they may not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm.common import cut, lookup

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LEAF = 8
BLOCK = 4096
LONG_MAX = 2**63 - 1
LIMB = 60
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("total", pa.int64())])


def fits(limit: int, size: int) -> bool:
    """Squared distances of vectors of ``size`` components within +-``limit`` fit 64 bits."""
    return size * (2 * limit) ** 2 <= LONG_MAX


def to_integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x) of all components; Python integers where 64 bits don't do."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if x.size == 0 or np.abs(y).max() < 2**53:
        return y.astype(np.int64)
    # A double of 2**53 or more is whole, and may pass the range of doubles when scaled.
    exact = [int(v) * scale if abs(v) >= 2**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


@dataclass
class KdTree:
    """Entries of one codebook by halving the widest component; leaves hold up to ``leaf`` of them.

    Nodes stand in arrays, children after their parent; ``low`` and ``high`` bound a node's entries.
    """

    entries: np.ndarray
    child: np.ndarray  # (node, 2), -1 below leaves
    low: np.ndarray
    high: np.ndarray
    members: np.ndarray  # (node, leaf) indices of entries, ascending, -1 padded

    @classmethod
    def build(cls, entries: np.ndarray, leaf: int = LEAF) -> KdTree:
        child, low, high, members = [], [], [], []
        todo = [(np.arange(len(entries)), -1, 0)]
        while todo:
            held, parent, side = todo.pop(0)
            at = len(child)
            if parent >= 0:
                child[parent][side] = at
            inside = entries[held]
            low.append(inside.min(axis=0))
            high.append(inside.max(axis=0))
            child.append([-1, -1])
            members.append(np.full(leaf, -1))
            if len(held) <= leaf:
                members[at][: len(held)] = held
                continue
            axis = int(np.argmax(high[at] - low[at]))
            order = held[np.argsort(inside[:, axis], kind="stable")]
            half = len(order) // 2
            todo += [(np.sort(order[:half]), at, 0), (np.sort(order[half:]), at, 1)]
        return cls(entries, np.array(child), np.array(low), np.array(high), np.array(members))

    def bound(self, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared distance of each point to the box of its node: no entry below is nearer."""
        off = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        return (off * off).sum(axis=1)

    def try_leaf(self, q: np.ndarray, node: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Compares each point with the entries of its leaf; equal distances keep the lower index."""
        for held in self.members[node].T:
            real = held >= 0
            off = q - self.entries[np.maximum(held, 0)]
            d = (off * off).sum(axis=1)
            better = real & ((d < best) | ((d == best) & (held < index)))
            best[better], index[better] = d[better], held[better]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry per point, the lower index among equals.

        Every point first walks down to the leaf on its side, for a distance to beat. Then all
        points descend again together: a node whose bound is over the best distance is left out,
        one whose bound equals it is visited, since it may hold an equally near lower index.
        """
        n = len(q)
        best = np.full(n, LONG_MAX, np.int64) if q.dtype != object else np.array([float("inf")] * n, object)
        index = np.full(n, len(self.entries), np.int64)
        at = np.zeros(n, np.int64)
        while True:
            walk = np.flatnonzero(self.child[at, 0] >= 0)
            if not len(walk):
                break
            pair = self.child[at[walk]]
            left, right = self.bound(q[walk], pair[:, 0]), self.bound(q[walk], pair[:, 1])
            at[walk] = np.where(left <= right, pair[:, 0], pair[:, 1])
        first = at.copy()
        self.try_leaf(q, first, best, index)
        row, node = np.arange(n), np.zeros(n, np.int64)
        leaves, leaf_rows, bounds = [], [], []
        while len(row):
            bound = self.bound(q[row], node)
            near = bound <= best[row]
            row, node, bound = row[near], node[near], bound[near]
            end = self.child[node, 0] < 0
            leaf_rows.append(row[end])
            leaves.append(node[end])
            bounds.append(bound[end])
            row, node = np.repeat(row[~end], 2), self.child[node[~end]].ravel()
        row, node, bound = np.concatenate(leaf_rows), np.concatenate(leaves), np.concatenate(bounds)
        # Leaves of a point by rising bound, one per turn, as long as the bound may still win.
        fresh_leaf = node != first[row]
        row, node, bound = row[fresh_leaf], node[fresh_leaf], bound[fresh_leaf]
        order = np.lexsort((bound, row)) if bound.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], bound[i])), int)
        row, node, bound = row[order], node[order], bound[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        for t in range(int(turn.max(initial=-1)) + 1):
            now = np.flatnonzero(turn == t)
            now = now[bound[now] <= best[row[now]]]
            r = row[now]
            b, i = best[r], index[r]
            self.try_leaf(q[r], node[now], b, i)
            best[r], index[r] = b, i
        return index, best


class Coder:
    """Searches all parts of vectors in the trees of their codebooks."""

    def __init__(self, books: list[np.ndarray]):
        self.trees = [KdTree.build(b) for b in books]
        self.ends = np.cumsum([0] + [b.shape[1] for b in books])
        self.limit = max(int(np.abs(b).max(initial=0)) for b in books)

    def assign(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its components, entry per vector, squared distance)."""
        width = int(np.diff(self.ends).max())
        limit = max(self.limit, int(np.abs(x).max(initial=0)))
        exact = fits(limit, width)
        for part, tree in enumerate(self.trees):
            q = x[:, self.ends[part] : self.ends[part + 1]]
            if not exact:
                q = q.astype(object)
            yield part, q, *(tree if exact else KdTree.build(tree.entries.astype(object))).nearest(q)


def complete(vec: str) -> Column:
    """Vectors that are not null and hold only finite numbers."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as integers; ``vec`` is the last column."""
    for batch in batches:
        for a in range(0, len(batch), BLOCK):
            part = batch.slice(a, BLOCK)
            values = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            yield part, to_integers(values.reshape(len(part), -1))


def limbs(value: int) -> list[int]:
    """The integer in base 2**LIMB, lowest first; only the last limb may be negative."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def sums_of(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    """Per task and component of an entry: how many parts chose it, and their sum by limbs."""
    count: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, int], np.ndarray] = {}
    for _, x in blocks_of(batches):
        for part, q, index, _ in coder.assign(x):
            order = np.argsort(index, kind="stable")
            entries, starts = np.unique(index[order], return_index=True)
            added = np.add.reduceat(q[order], starts, axis=0)  # of one block: it fits where its numbers do
            for entry, n, t in zip(entries.tolist(), np.diff(starts, append=len(index)).tolist(), added.astype(object), strict=True):
                count[part, entry] = count.get((part, entry), 0) + n
                total[part, entry] = total.get((part, entry), 0) + t
    rows = [(p, e, i, j, count[p, e], v) for (p, e), t in total.items() for i, whole in enumerate(t) for j, v in enumerate(limbs(int(whole)))]
    yield pa.record_batch([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_SUMS)], schema=_SUMS)


def fit(vectors: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Codebooks of ``vectors(vid, vec)``, all of one length; at most ``entries`` vectors reach the driver."""
    first = vectors.orderBy(F.col("vid").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    books = np.split(to_integers(np.array([r["vec"] for r in first], np.float64)), parts, axis=1)
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(Coder(books))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return sums_of(batches, sent.value)

        found = vectors.select("vec").mapInArrow(run, "part int, entry int, place int, limb int, n long, total long")
        added = found.groupBy("part", "entry", "place", "limb").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        count: dict[tuple[int, int, int], int] = {}
        total: dict[tuple[int, int, int], int] = {}
        # A few rows per component of the codebooks, whatever the table.
        for r in added.collect():
            key = r["part"], r["entry"], r["place"]
            count[key] = max(count.get(key, 0), r["n"])  # every part has a lowest limb, not every part has others
            total[key] = total.get(key, 0) + (int(r["total"]) << (LIMB * r["limb"]))
        books = [b.astype(object) for b in books]
        for (part, entry, place), value in total.items():
            books[part][entry, place] = value // count[part, entry, place]
        books = [b.astype(np.int64) if np.abs(b).max() < 2**62 else b for b in books]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per vector that is kept: id, ``code``, ``error``, ``label_error``, ``codebooks_sha256``.

    Rows whose vector is null or holds null or non-finite components go. The codebooks begin with
    the vectors of the smallest ids (those with equal ids by their components, those without id
    last); with fewer than ``entries`` vectors they are as short. Ties go to the lower index, an
    entry that no part chose stays as it is. ``code`` has two hex digits per part. ``label_error``
    adds up ``error`` over rows of an equal label; rows without a label count as one label.

    Parts have one size: the length of the first vector, by that order, whose length is a positive
    multiple of ``parts`` holds, and vectors of other lengths go. Repeated rows are vectors of
    their own. No vector left, an empty table: no row. Errors are exact; one that passes 64 bits
    stands as the largest long. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be within 1 and 256")
    types = dict(vectors.dtypes)
    base = vectors.select(F.col(id_col).alias("vid"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    kept = base.where(complete("vec") & (F.size("vec") > 0) & (F.size("vec") % parts == 0))
    first = kept.select("vid", "vec").orderBy(F.col("vid").asc_nulls_last(), "vec").first()
    if first is None:
        empty = f"`{id_col}` {types[id_col]}, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    kept = kept.where(F.size("vec") == len(first["vec"]))
    books = fit(kept.select("vid", "vec"), parts, entries, rounds)
    sent = vectors.sparkSession.sparkContext.broadcast(Coder(books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks_of(batches):
            code, error = np.full(len(part), "", object), np.zeros(len(part), object)
            for _, _, index, d in sent.value.assign(x):
                code = code + np.array([f"{i:02x}" for i in index.tolist()], object)
                error = error + d.astype(object)
            errors = pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())
            yield pa.record_batch([part.column(0), part.column(1), pa.array(code, pa.string()), errors], names=["vid", "label", "code", "error"])

    coded = cut(kept.mapInArrow(encode, f"vid {types[id_col]}, label {types[label_col]}, code string, error long"))
    named = coded.select("*", F.col("label").isNull().alias("unlabelled"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    sums = cut(named.groupBy("unlabelled", "name").agg(total.alias("label_error")))
    return lookup(named, sums, ["unlabelled", "name"]).select(
        F.col("vid").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
