"""Connected components and the checkpoint folder."""

import random

import pytest

from trackledger import lineage
from trackledger.llm import common


def slow_components(edges):
    at = {}
    for a, b in edges:
        at.setdefault(a, a), at.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "path": [(i, i + 1) for i in range(40)],
        "star": [(7, i) for i in range(60) if i != 7] + [(100, 101), (101, 100)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "loops": [(3, 3), (5, 5)],
    }[kind]
    df = spark.createDataFrame(edges + [(None, 4), (4, None)], "src long, dst long")
    got = {r["node"]: r["component"] for r in common.components(df).collect()}
    assert got == slow_components([(a, b) for a, b in edges if a != b])


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_cluster_without_a_named_folder_is_an_error(monkeypatch):
    class Nothing:
        def isDefined(self):
            return False

    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.ensure_checkpoint_dir(Session())
