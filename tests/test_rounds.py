"""Walks that handle each edge once: rows that joins give out, over all jobs of a call."""

import random

from pyspark.sql import functions as F

from weftline.operators import graph, reachability


def joined_rows(spark, run):
    """What ``run`` returns, and the rows that all joins of its plans gave out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out, total = store.executionsCount(), run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for i in range(before, store.executionsCount()):
        execution = store.executionsList().apply(i).executionId()
        metrics, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for n in range(nodes.size()):
            own = nodes.apply(n).metrics()
            for m in range(own.size() if "Join" in nodes.apply(n).name() else 0):
                if own.apply(m).name() == "number of output rows":
                    said = metrics.get(own.apply(m).accumulatorId())
                    total += int(said.get().replace(",", "")) if said.isDefined() else 0
    return out, total


def test_layers_meet_each_edge_once(spark):
    wide, deep = 30, 12
    pairs = [(f"n{d:02}_{i}", f"n{d + 1:02}_{j}") for d in range(deep) for i in range(wide) for j in range(wide)]
    edges = spark.createDataFrame(pairs, "source string, target string")
    got, joined = joined_rows(spark, lambda: {r["node"]: r["layer"] for r in graph.layers(edges).collect()})
    assert got == {f"n{d:02}_{i}": d for d in range(deep + 1) for i in range(wide)}
    assert joined < 2 * len(pairs)  # every edge in every round is ten times the edges and more


def test_layers_of_nodes_that_share_a_hash(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")], "source string, target string")
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert {r["node"]: r["layer"] for r in graph.layers(edges).collect()} == {"a": 0, "x": 0, "b": 1, "c": 2}


def test_open_pairs_share_the_way_down(spark):
    rng, wide, deep = random.Random(5), 40, 4
    pairs = sorted({(f"n{d}_{i:02}", f"n{d + 1}_{rng.randrange(wide):02}") for d in range(deep) for i in range(wide) for _ in range(3)})
    after, reached = {}, {f"n0_{i:02}": {f"n0_{i:02}"} for i in range(wide)}
    for s, t in pairs:
        after.setdefault(s, set()).add(t)
    for _ in range(deep):
        reached = {s: seen | {t for n in seen for t in after.get(n, ())} for s, seen in reached.items()}
    index = reachability.build(spark.createDataFrame(pairs, "source string, target string"), 1)
    asked = [(s, f"n{deep}_{i:02}") for s in reached for i in range(wide)]
    got, joined = joined_rows(spark, lambda: {(r["source"], r["target"]): r["reaches"] for r in index.reaches(spark.createDataFrame(asked, "source string, target string")).collect()})
    assert got == {(s, t): t in reached[s] for s, t in asked}
    assert joined < 15 * len(asked)  # a walk of its own for each pair makes several times as many
