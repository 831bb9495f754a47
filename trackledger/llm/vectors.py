"""Embedding near-duplicates with navigable small-world graphs per shard.

1. Equal vectors of one label become one numbered point with a multiplicity; the points of a
   label are dealt to shards of about ``shard_rows`` (by hash of their number), so a label
   that holds a third of all rows is split.
2. A shard's layered graph is built once, levels by hash, points added in growing waves, each
   wave searched against the graph so far and against itself, neighbours chosen with the
   diversity rule. Its arrays are written as a row, together with the beam that an audit of
   planted queries asks for: turned copies of its points at cosines just over the threshold,
   so the audit has links to find whatever the data hold. The beam doubles until mean recall
   and its lower bound pass; a beam as wide as the shard is brute force.
3. A task takes two tiles of ``TILE`` shards of a label and links their pairs. The points of
   each shard query the graph of the other, so every shard is queried by every point and a
   link counts once for both ends, whichever side found it. A beam search descends the layers;
   at the bottom the beam widens over all points met that link. A hash-chosen sample of the
   queries is compared with brute force too, each by its own recall, and may widen the beam.
4. Links are cosines in double precision. A task returns counts per point and spanning
   links; components come from alternating-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm.common import components, cut, lookup, spanning_labels

THRESHOLD = 0.93
SHARD_ROWS = 8192
DEGREE = 12
BEAM = 24
AUDIT_ROWS = 48
PLANTED_ROWS = 96
#: What the mean recall of an audit has to reach, and what it has to reach less two standard errors.
AUDIT_RECALL, AUDIT_BOUND = 0.99, 0.95
TILE = 4
QUERY_BLOCK = 512
#: How far under the floor a point may lie and still lead on.
HOP = 0.03


def scramble(ids: np.ndarray) -> np.ndarray:
    """Well-mixed uint64 per id; decides levels, order of insertion and audit samples."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Layer:
    """Neighbour lists (-1 padded) over the points that reach this level."""

    def __init__(self, n: int, degree: int):
        self.degree = degree
        self.next = np.full((n, degree), -1, np.int32)


class SmallWorld:
    """Layered graph over unit vectors."""

    @classmethod
    def restored(cls, points: np.ndarray, entry: int, neighbours: list[np.ndarray]) -> SmallWorld:
        """A graph that was built before, for searches."""
        self = cls.__new__(cls)
        self.points, self.entry, self.layers = points, entry, []
        for held in neighbours:
            layer = Layer(0, held.shape[1])
            layer.next = held
            self.layers.append(layer)
        return self

    def __init__(self, points: np.ndarray, marks: np.ndarray, degree: int = DEGREE, build_beam: int = 32):
        self.points, self.degree = points, degree
        n = len(points)
        spread = np.log(np.maximum(1, (marks >> np.uint64(11)).astype(np.float64)) / 2.0**53)
        self.level = np.minimum((-spread / np.log(degree)).astype(np.int64), 8) if n else np.zeros(0, np.int64)
        order = np.lexsort((marks, -self.level))
        self.entry = int(order[0]) if n else -1
        self.layers = [Layer(n, 2 * degree if k == 0 else degree) for k in range(int(self.level.max(initial=0)) + 1)]
        done = 1
        while done < n:
            wave = order[done : done + max(1, min(done, 512))]
            self.add(wave, build_beam)
            done += len(wave)

    def add(self, wave: np.ndarray, beam: int) -> None:
        q = self.points[wave]
        start = np.full((len(wave), 1), self.entry, np.int32)
        for k in range(len(self.layers) - 1, -1, -1):
            ids, sims = self.search_layer(q, start, k, beam)
            start = ids[:, : max(1, beam // 4)]
            here = np.flatnonzero(self.level[wave] >= k)
            if not len(here):
                continue
            own = wave[here]
            mates = q[here] @ q[here].T
            np.fill_diagonal(mates, -2.0)
            take = min(self.degree, len(own))
            near = np.argpartition(-mates, take - 1, axis=1)[:, :take]
            near_sims = np.take_along_axis(mates, near, 1)
            cand = np.concatenate((ids[here], own[near].astype(np.int32)), axis=1)
            cand_sims = np.concatenate((sims[here], near_sims), axis=1)
            cand = np.where(cand_sims > -1.5, cand, -1)
            chosen = self.diverse(cand, cand_sims, self.degree)
            layer = self.layers[k]
            layer.next[own, : self.degree] = chosen
            self.link_back(layer, own, chosen)

    def diverse(self, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Per row up to ``keep`` candidates, none closer to a chosen one than to the row's point;
        left-over room goes to the nearest of the rest."""
        order = np.argsort(-np.where(cand >= 0, sims, -3.0), axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        rows, width = cand.shape
        vec = self.points[np.maximum(cand, 0)]
        between = np.einsum("rad,rbd->rab", vec, vec)
        valid = cand >= 0
        chosen = np.zeros((rows, width), bool)
        count = np.zeros(rows, np.int64)
        for j in range(width):
            clash = ((between[:, j, :] > sims[:, j : j + 1]) & chosen).any(axis=1)
            ok = valid[:, j] & ~clash & (count < keep)
            chosen[:, j] = ok
            count += ok
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        pick = np.argsort(rank, axis=1)[:, :keep]
        out = np.take_along_axis(np.where(valid, cand, -1), pick, 1)
        if out.shape[1] < keep:
            out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
        return out

    def link_back(self, layer: Layer, own: np.ndarray, chosen: np.ndarray) -> None:
        """Reverse links; a list that overflows is chosen anew by the diversity rule."""
        src = np.repeat(own, chosen.shape[1])
        dst = chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, n = np.unique(dst, return_index=True, return_counts=True)
        for a in range(0, len(targets), 256):
            t = targets[a : a + 256]
            width = int(n[a : a + 256].max())
            new = np.full((len(t), width), -1, np.int32)
            for i, (f, c) in enumerate(zip(first[a : a + 256], n[a : a + 256], strict=True)):
                new[i, :c] = src[f : f + c]
            both = np.concatenate((layer.next[t], new), axis=1)
            both = np.sort(both, axis=1)[:, ::-1].copy()
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.einsum("rad,rd->ra", self.points[np.maximum(both, 0)], self.points[t])
            used = (both >= 0).sum(axis=1)
            easy = used <= layer.degree
            if easy.any():
                packed = np.take_along_axis(both[easy], np.argsort(both[easy] < 0, axis=1, kind="stable"), 1)
                layer.next[t[easy]] = packed[:, : layer.degree]
            if not easy.all():
                hard = ~easy
                layer.next[t[hard]] = self.diverse(both[hard], sims[hard], layer.degree)

    def search_layer(self, q: np.ndarray, start: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best points met per query as (ids, cosines), best first."""
        nxt = self.layers[k].next
        rows = len(q)
        n = len(self.points)
        beam = min(beam, n)
        seen = np.zeros((rows, (n + 7) // 8), np.uint8)
        ids = np.full((rows, beam), -1, np.int32)
        sims = np.full((rows, beam), -2.0)
        open_ = np.zeros((rows, beam), bool)

        def visit(at: np.ndarray, new: np.ndarray) -> np.ndarray:
            """Marks the points as seen; -1 for those seen before or twice in a row."""
            new = np.sort(new, axis=1)[:, ::-1].copy()
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            safe = np.maximum(new, 0)
            bit = (1 << (safe & 7)).astype(np.uint8)
            known = (seen[at[:, None], safe >> 3] & bit) != 0
            new[known] = -1
            r, c = np.nonzero(new >= 0)
            np.bitwise_or.at(seen, (at[r], safe[r, c] >> 3), bit[r, c])
            return new

        def push(at: np.ndarray, new: np.ndarray) -> None:
            nonlocal ids, sims, open_
            s = np.where(new >= 0, np.einsum("rad,rd->ra", self.points[np.maximum(new, 0)], q[at]), -2.0)
            all_ids = np.concatenate((ids[at], new), axis=1)
            all_sims = np.concatenate((sims[at], s), axis=1)
            all_open = np.concatenate((open_[at], new >= 0), axis=1)
            width = ids.shape[1]
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            got = order.shape[1]
            ids[at, :got] = np.take_along_axis(all_ids, order, 1)
            sims[at, :got] = np.take_along_axis(all_sims, order, 1)
            open_[at, :got] = np.take_along_axis(all_open, order, 1)

        at = np.arange(rows)
        push(at, visit(at, start.astype(np.int32)))
        while True:
            at = np.flatnonzero(open_.any(axis=1))
            if not len(at):
                break
            best = np.argmax(open_[at], axis=1)  # rows are sorted: the first open one is the best
            open_[at, best] = False
            new = visit(at, nxt[ids[at, best]])
            some = (new >= 0).any(axis=1)
            if some.any():
                push(at[some], new[some])
        return ids, sims

    def search(self, q: np.ndarray, beam: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query row, point) of the points met whose cosine reaches ``floor``.

        The beam search ends beside the query; from there the beam widens over all points
        that reach the floor, or nearly so, until their neighbours bring no further ones.
        """
        start = np.full((len(q), 1), self.entry, np.int32)
        for k in range(len(self.layers) - 1, 0, -1):
            ids, _ = self.search_layer(q, start, k, 4)
            start = ids[:, :2]
        ids, sims = self.search_layer(q, start, 0, beam)
        n = len(self.points)
        seen = np.zeros(len(q) * n, bool)
        row, col = np.nonzero(ids >= 0)
        point, sim = ids[row, col].astype(np.int64), sims[row, col]
        seen[row * n + point] = True
        rows, points = [], []
        nxt = self.layers[0].next
        while len(row):
            hit = sim >= floor
            rows.append(row[hit])
            points.append(point[hit])
            near = sim >= floor - HOP
            row, point = row[near], point[near]
            key = np.repeat(row * n, nxt.shape[1]) + nxt[point].ravel()
            key = key[(nxt[point] >= 0).ravel()]
            key = key[~seen[key]]
            seen[key] = True
            key = np.unique(key)
            row, point = key // n, key % n
            sim = np.concatenate(
                [np.zeros(0)]
                + [
                    np.einsum("rd,rd->r", q[row[a : a + 65536]], self.points[point[a : a + 65536]])
                    for a in range(0, len(row), 65536)
                ]
            )
        return (np.concatenate(rows), np.concatenate(points)) if rows else (np.zeros(0, int), np.zeros(0, int))


def links_of(index: SmallWorld, q: np.ndarray, beam: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(query row, point) of all links found."""
    rows, found = [], []
    for a in range(0, len(q), QUERY_BLOCK):
        part = q[a : a + QUERY_BLOCK]
        if beam >= len(index.points):
            r, c = np.nonzero(part @ index.points.T >= floor)
            rows.append(r + a)
            found.append(c)
            continue
        r, c = index.search(part, beam, floor)
        rows.append(r + a)
        found.append(c)
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, int), np.zeros(0, int))


def audited_beam(
    index: SmallWorld, audit: np.ndarray, floor: float, recall: float, beam: int = BEAM, own: np.ndarray | None = None
) -> int:
    """The smallest beam of the doubling series at which the audit's queries find ``recall`` of their links.

    Recalls count per query, so a dense group cannot hide what sparse ones miss; queries
    without links are left out. ``own`` names the point that each query is itself, if any.
    """
    truth = audit @ index.points.T >= floor
    lanes = np.arange(len(audit))
    if own is not None:
        truth[lanes, own] = False
    links = truth.sum(axis=1)
    asked = links > 0
    while beam < len(index.points) and asked.any():
        row, hit = links_of(index, audit, beam, floor)
        found = np.bincount(row[truth[row, hit]], minlength=len(audit))
        each = found[asked] / links[asked]
        if each.mean() >= recall and each.mean() - 2 * each.std() / np.sqrt(len(each)) >= AUDIT_BOUND:
            return beam
        beam *= 2
    return min(beam, len(index.points))


def planted(points: np.ndarray, marks: np.ndarray, floor: float, n: int = PLANTED_ROWS) -> np.ndarray:
    """``n`` points by hash, each turned away in a direction by hash to a cosine between the floor and
    a fifth of the way up to 1: queries that have a link to find, most of them a lone and far one."""
    chosen = np.argsort(marks, kind="stable")[:n]
    x = points[chosen]
    rng = np.random.default_rng(marks[chosen])
    aside = rng.normal(size=x.shape)
    aside -= np.einsum("rd,rd->r", aside, x)[:, None] * x
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-9)
    cosine = (floor + 1e-6 + (1 - floor) * 0.2 * rng.random(len(x)))[:, None]
    return unit_rows(cosine * x + np.sqrt(1 - cosine**2) * aside)


class Shard:
    """Points of one shard with the graph over them and the beam its audit asks for."""

    def __init__(self, pid: np.ndarray, weight: np.ndarray, vec: np.ndarray, index: SmallWorld, beam: int):
        self.pid, self.weight, self.vec, self.index, self.beam = pid, weight, vec, index, beam
        self.audit = np.argsort(scramble(pid + 1))[:AUDIT_ROWS]

    @classmethod
    def build(cls, points: pd.DataFrame, floor: float) -> Shard:
        points = points.sort_values("pid")
        pid, weight = points["pid"].to_numpy(), points["n"].to_numpy()
        vec = unit_rows(np.stack(points["vec"].to_numpy()).astype(np.float64))
        index = SmallWorld(vec, scramble(pid))
        return cls(pid, weight, vec, index, audited_beam(index, planted(vec, scramble(pid + 2), floor), floor, AUDIT_RECALL))

    def to_bytes(self) -> bytes:
        out = BytesIO()
        layers = {f"layer{i}": x.next for i, x in enumerate(self.index.layers)}
        np.savez(out, pid=self.pid, weight=self.weight, vec=self.vec, entry=self.index.entry, beam=self.beam, **layers)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        held = np.load(BytesIO(data))
        layers = [held[f"layer{i}"] for i in range(sum(n.startswith("layer") for n in held.files))]
        vec = held["vec"]
        return cls(held["pid"], held["weight"], vec, SmallWorld.restored(vec, int(held["entry"]), layers), int(held["beam"]))

    def asks(self, other: Shard, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(own point, other's point) of all links found, block by block."""
        same = self is other
        beam = audited_beam(other.index, self.vec[self.audit], floor, AUDIT_RECALL, other.beam, own=self.audit if same else None)
        for a in range(0, len(self.vec), QUERY_BLOCK):
            row, hit = links_of(other.index, self.vec[a : a + QUERY_BLOCK], beam, floor)
            row += a
            # The floor of the search meets the exact test once more, in double precision.
            exact = np.einsum("rd,rd->r", self.vec[row], other.vec[hit]) >= floor
            if same:
                exact &= row != hit
            yield row[exact], hit[exact]


def link_shards(left: Shard, right: Shard, floor: float) -> pd.DataFrame:
    """Link counts of all points and spanning links between two shards, or within one.

    What was found stands in one matrix of bits, so a link is known to both ends and counts once.
    """
    found = np.zeros((len(left.pid), len(right.pid)), bool)
    for row, hit in left.asks(right, floor):
        found[row, hit] = True
        if left is right:
            found[hit, row] = True
    if left is not right:
        for row, hit in right.asks(left, floor):
            found[hit, row] = True
    n, total = len(left.pid), len(left.pid) + (0 if left is right else len(right.pid))
    name = left.pid if left is right else np.concatenate((left.pid, right.pid))
    count = np.zeros(total, np.int64)
    label = np.arange(total)
    for a in range(0, n, QUERY_BLOCK):
        row, hit = np.nonzero(found[a : a + QUERY_BLOCK])
        row += a
        np.add.at(count, row, right.weight[hit])
        if left is not right:
            hit = hit + n
            np.add.at(count, hit, left.weight[row])
        label = spanning_labels(total, np.concatenate((row, np.arange(total))), np.concatenate((hit, label)))
    at, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(total))
    return pd.DataFrame(
        {
            "src": np.concatenate((name[at], name[moved])),
            "dst": np.concatenate((np.full(len(at), -1), name[label[moved]])),
            "links": np.concatenate((count[at], np.zeros(len(moved), np.int64))),
            "edge": np.concatenate((np.zeros(len(at), bool), np.ones(len(moved), bool))),
        }
    )


def link_tiles(rows: pd.DataFrame, floor: float) -> pd.DataFrame:
    """Links of all pairs of shards whose tiles are ``low`` and ``high``, each pair once."""
    low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
    shards = {int(s): Shard.from_bytes(g) for s, g in zip(rows["shard"], rows["graph"], strict=True)}
    pairs = [(a, b) for a in shards for b in shards if a <= b and a // TILE == low and b // TILE == high]
    found = [link_shards(shards[a], shards[b], floor) for a, b in sorted(pairs)]
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"src": [], "dst": [], "links": [], "edge": []})


def usable(vec: str) -> Column:
    """Vectors that can link: not null or empty, all components finite, some of them not zero."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without a label, link with nothing; vectors of different lengths do not link. Repeated
    rows are vectors of their own and link with each other; ``component_id`` is the smallest
    id, so copies under one id share it. A row with a null id takes part, and has a null
    ``component_id`` when it reaches no id. An empty table stays empty.
    """
    base = vectors.select(
        F.col(id_col).alias("vid"),
        # Adding zero turns minus zero into zero, so that equal vectors have equal bits.
        F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"),
        F.col(label_col).alias("label"),
    )
    ok = usable("vec") & F.col("label").isNotNull()
    good = base.where(ok)
    # Equal vectors of a label are one point; its number is its place in the checkpointed table.
    points = cut(good.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("n"), F.min("vid").alias("low_id")))
    points = cut(points.select(F.monotonically_increasing_id().alias("pid"), "*", F.size("vec").alias("dim")))
    sizes = points.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"))
    shards = F.ceil(F.col("rows") / F.lit(shard_rows)).cast("int")
    own = F.pmod(F.xxhash64("pid", F.lit(1)), F.col("shards").cast("long")).cast("int")
    dealt = points.join(sizes, ["label", "dim"]).withColumn("shards", shards).select(
        F.concat_ws("/", F.col("label").cast("string"), F.col("dim").cast("string")).alias("label"), own.alias("shard"), "shards", "pid", "n", "vec"
    )

    def build(shard: pd.DataFrame) -> pd.DataFrame:
        first = shard.iloc[0]
        return pd.DataFrame({"label": [first["label"]], "shard": [first["shard"]], "shards": [first["shards"]], "graph": [Shard.build(shard, threshold).to_bytes()]})

    def link(tiles: pd.DataFrame) -> pd.DataFrame:
        return link_tiles(tiles, threshold)

    graphs = cut(dealt.groupBy("label", "shard").applyInPandas(build, "label string, shard int, shards int, graph binary"))
    tile = F.floor(F.col("shard") / TILE).cast("int")
    last = F.floor((F.col("shards") - 1) / TILE).cast("int")
    tiled = graphs.select("label", "shard", "graph", tile.alias("tile"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    tiled = tiled.select("label", "shard", "graph", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    found = cut(tiled.groupBy("label", "low", "high").applyInPandas(link, "src long, dst long, links long, edge boolean"))
    counts = found.where("not edge").groupBy("src").agg(F.sum("links").alias("others"))
    joined = components(found.where("edge").select("src", "dst"))
    state = cut(
        points.select("pid", "label", "vec", "n", "low_id")
        .join(counts, F.col("pid") == F.col("src"), "left")
        .join(joined, F.col("pid") == F.col("node"), "left")
        .select(
            "label", "vec", "low_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "pid").alias("component"),
        )
    )
    lowest = state.groupBy("component").agg(F.min("low_id").alias("component_id"))
    state = cut(lookup(state, cut(lowest), ["component"]).select("label", "vec", "n_links", "component_id"))
    linked = lookup(good, state, ["label", "vec"]).select("vid", "n_links", "component_id")
    # Rows that cannot link never meet the join.
    alone = base.where(~ok).select("vid", F.lit(0).cast("long"), "vid")
    return linked.union(alone).select(
        F.col("vid").alias(id_col),
        F.col("n_links").cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vid") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
