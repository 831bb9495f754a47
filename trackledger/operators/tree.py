"""Project tree: closure, ancestors, roll-up of phases, merged geometry.

Trees are adjacency lists ``(project_id, superior_id)`` of any depth. Links to superiors double in
length from round to round, each written before the next, until none is left; a cycle raises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackledger.functions import domain as D
from trackledger.lineage import cut


def links(nodes: DataFrame, stop: str | None = None) -> DataFrame:
    """``(node_id, up)``: every node with its superior; null for roots, for nodes whose superior is
    not in the table, and below a node where the boolean column ``stop`` holds."""
    halt = F.coalesce(F.col(stop), F.lit(False)) if stop else F.lit(False)
    open_ = nodes.where(~halt).select(F.col("project_id").alias("superior_id"), F.col("project_id").alias("up"))
    return nodes.select(F.col("project_id").alias("node_id"), "superior_id").join(open_, "superior_id", "left").select("node_id", "up")


def leapt(up: DataFrame) -> DataFrame:
    """Links of twice the length: from every node to what its link's end links to."""
    return up.join(up.select(F.col("node_id").alias("up"), F.col("up").alias("next")), "up", "left").select("node_id", F.col("next").alias("up"))


def closure(nodes: DataFrame, stop: str | None = None) -> DataFrame:
    """``(root_id, node_id, depth)``: every node with all its descendants, itself at depth 0.

    With ``stop``, a boolean column of ``nodes``, rows below a node where it holds are left
    out; the node itself stays. A cycle raises ``ValueError``: one of its nodes meets itself.
    Links double in length, so the rounds grow as the logarithm of the depth.
    """
    up = cut(links(nodes, stop))
    found = up.select(F.col("node_id").alias("root_id"), "node_id", F.lit(0).alias("depth"))
    length = 1
    while not up.where("up is not null").isEmpty():
        # Who reaches x within a length also reaches, by the link from x, what its end reaches within that length.
        beyond = found.select(F.col("root_id"), F.col("node_id").alias("up"), F.col("depth").alias("d")).join(up.where("up is not null"), "up")
        found = cut(found.union(beyond.select("root_id", "node_id", (F.col("d") + length).alias("depth"))))
        if not found.where("root_id = node_id and depth > 0").isEmpty():
            raise ValueError("the tree is cyclic")
        up, length = cut(leapt(up)), 2 * length
    return found


def folded(nodes: DataFrame, values: DataFrame, stop: str | None = None) -> DataFrame:
    """``(node_id, lo, hi, n)``: least, greatest and number of ``values(node_id, ord)`` within the
    subtree of every node, itself included; below nodes where ``stop`` holds nothing is passed on.

    A round adds to each node what the nodes exactly 1, 2, 4, ... levels below have gathered from
    their nearer levels, so every descendant counts once; a table of nodes is all that is held,
    and the rounds grow as the logarithm of the depth. A cycle raises ``ValueError``.
    """
    state = cut(
        links(nodes, stop).join(values, "node_id", "left").select("node_id", "up", F.col("ord").alias("lo"), F.col("ord").alias("hi"), F.when(F.col("ord").isNotNull(), 1).otherwise(0).cast("long").alias("n"))
    )
    length, total = 1, state.count()
    while not state.where("up is not null").isEmpty():
        if length > total:
            raise ValueError("the tree is cyclic")
        passed = state.where("up is not null").groupBy(F.col("up").alias("node_id")).agg(F.min("lo").alias("plo"), F.max("hi").alias("phi"), F.sum("n").alias("pn"))
        state = cut(
            state.join(passed, "node_id", "left").join(leapt(state.select("node_id", "up")).withColumnRenamed("up", "next"), "node_id").select(
                "node_id", F.col("next").alias("up"), F.least("lo", "plo").alias("lo"), F.greatest("hi", "phi").alias("hi"), (F.col("n") + F.coalesce("pn", F.lit(0))).alias("n")
            )
        )
        length *= 2
    return state.select("node_id", "lo", "hi", "n")


def ancestors(nodes: DataFrame) -> DataFrame:
    """``(node_id, ancestor_id, distance)``, the node itself at distance 0."""
    return closure(nodes).select("node_id", F.col("root_id").alias("ancestor_id"), F.col("depth").alias("distance"))


def rollup(nodes: DataFrame, leaf_phases: DataFrame) -> DataFrame:
    """Aggregated phases of every project.

    ``nodes(project_id, superior_id, pin)``, ``leaf_phases(project_id, phase)`` with rows for
    known phases only. A leaf shows its own phase. An inner node spans the known leaves
    below it; a pin on an inner node stands for its whole subtree and suppresses its span; a
    pin on a leaf is that leaf's own override. Observations of inner nodes are ignored.
    """
    parents = nodes.where("superior_id is not null").select(F.col("superior_id").alias("project_id")).distinct().withColumn("inner", F.lit(True))
    marked = nodes.join(parents, "project_id", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    marked = marked.withColumn("held", F.col("inner") & F.col("pin").isNotNull())
    state = marked.join(leaf_phases, "project_id", "left").select(
        F.col("project_id").alias("node_id"),
        D.phase_order(F.when(F.col("held"), F.col("pin")).when(~F.col("inner"), F.coalesce("pin", "phase"))).alias("ord"),
    )
    spans = folded(marked, state, stop="held").select(F.col("node_id").alias("project_id"), "lo", "hi", F.col("n").alias("n_phases"))
    rows = marked.join(spans, "project_id")
    spanning = F.col("inner") & ~F.col("held") & (F.col("n_phases") > 0)
    return rows.select(
        "project_id",
        F.col("inner").alias("is_superior"),
        (F.col("n_phases") > 0).alias("is_known"),
        F.col("n_phases"),
        F.when(spanning, D.phase_name(F.col("lo"))).alias("span_low"),
        F.when(spanning, D.phase_name(F.col("hi"))).alias("span_high"),
        F.coalesce(D.phase_name(F.col("hi")), F.lit("NICHT_GESTARTET")).alias("display_phase"),
    )


def children_of(nodes: DataFrame, rolled: DataFrame) -> DataFrame:
    """Aggregation payload per direct child of every superior project."""
    child = nodes.where("superior_id is not null").select("superior_id", "project_id", "name")
    return child.join(rolled, "project_id")


def leaf_features(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """``(project_id, node_id, pos, feature)``: the features of all leaves below every superior
    project, a row each; ``features(project_id, features array<string>)``."""
    parents = nodes.where("superior_id is not null").select(F.col("superior_id").alias("project_id")).distinct()
    leaves = nodes.join(parents, "project_id", "left_anti").select(F.col("project_id").alias("node_id"))
    rows = closure(nodes).where("depth > 0").join(leaves, "node_id").join(features.withColumnRenamed("project_id", "node_id"), "node_id")
    return rows.select(F.col("root_id").alias("project_id"), "node_id", F.posexplode("features").alias("pos", "feature"))


def merged_features(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """Per superior project the features of its leaves as one list; none gives null.

    Lists keep the order of leaf ids. A list is one cell: for subtrees of any size take ``leaf_features``.
    """
    long = leaf_features(nodes, features).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "pos", "feature"))).alias("all"))
    inner = nodes.where("superior_id is not null").select(F.col("superior_id").alias("project_id")).distinct().join(nodes.select("project_id"), "project_id")
    return inner.join(long, "project_id", "left").select("project_id", F.transform("all", lambda x: x["feature"]).alias("features"))
