"""Walks against plain Python on random graphs, and golden cases by hand."""

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, paths, scope


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def python_reach(pairs, seed, hops):
    seen, frontier = {seed: 0}, {seed}
    for d in range(1, hops + 1):
        frontier = {t for s, t in pairs if s in frontier} - set(seen)
        seen |= dict.fromkeys(frontier, d)
    return seen


@pytest.mark.parametrize("n", [1, 2])
def test_reach_on_random_cyclic_graphs(spark, n):
    rng = random.Random(n)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)})
    pairs = [(s, t) for s, t in pairs if s != t]
    e = frame(spark, pairs)
    down = {r[0]: r[1] for r in graph.descendants(e, "n0", 16).collect()}
    assert down == python_reach(pairs, "n0", 16)
    up = {r[0]: r[1] for r in graph.ancestors(e, "n0", 16).collect()}
    assert up == python_reach([(t, s) for s, t in pairs], "n0", 16)


def layered(spark, pairs):
    return {r[0]: r[1] for r in graph.layers(frame(spark, pairs)).collect()}


def test_layers_by_hand(spark):
    assert layered(spark, [("raw", "clean"), ("clean", "gold")]) == {"raw": 0, "clean": 1, "gold": 2}
    assert layered(spark, [("a", "b"), ("b", "d"), ("a", "d")])["d"] == 2
    assert set(layered(spark, [("a", "b"), ("b", "a")])) == {"a", "b"}
    got = layered(spark, [("raw", "JobA"), ("JobA", "mid"), ("mid", "JobA"), ("mid", "JobB"), ("JobB", "deep")])
    assert got["raw"] == 0 < got["mid"] < got["deep"]


def python_components(pairs):
    nodes = {x for p in pairs for x in p}
    reached = {n: set(python_reach(pairs, n, len(nodes))) for n in nodes}
    return {n: min(m for m in nodes if m in reached[n] and n in reached[m]) for n in nodes if any(m != n and m in reached[n] and n in reached[m] for m in nodes)}


def python_layers(pairs):
    """Edges inside a component that do not lead away from its smallest node fall; then the longest paths."""
    own = python_components(pairs)
    inner = [(s, t) for s, t in pairs if s in own and own.get(t) == own[s]]
    away = {}
    for first in set(own.values()):
        away |= {n: d for n, d in python_reach(inner, first, len(own)).items()}
    kept = [(s, t) for s, t in pairs if (s, t) not in inner or away[s] < away[t]]
    layer = {x: 0 for p in pairs for x in p}
    for _ in layer:
        for s, t in kept:
            layer[t] = max(layer[t], layer[s] + 1)
    return layer


@pytest.mark.parametrize("n", [3, 4])
def test_components_and_layers_of_random_cyclic_graphs(spark, n, monkeypatch):
    monkeypatch.setattr(graph, "LONG", 8)
    rng = random.Random(n)
    pairs = sorted({(f"n{rng.randrange(24):02}", f"n{rng.randrange(24):02}") for _ in range(32)})
    pairs = [(s, t) for s, t in pairs if s != t]
    want = python_components(pairs)
    assert want
    assert {r[0]: r[1] for r in graph.strong_components(frame(spark, pairs)).select("node", "component").collect()} == want
    assert layered(spark, pairs) == python_layers(pairs)


def test_a_ring_is_cut_at_its_smallest_node(spark, monkeypatch):
    monkeypatch.setattr(graph, "LONG", 8)
    ring = [(f"r{k:02}", f"r{(k + 1) % 20:02}") for k in range(20)]
    assert layered(spark, [("a", "r05"), *ring]) == {"a": 0, **{f"r{k:02}": max(k, k - 4 if k >= 5 else 0) for k in range(20)}}
    assert graph.strong_components(frame(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_hubs_meet_in_blocks(spark):
    reads = spark.createDataFrame([("h", f"s{k}") for k in range(40)] + [("e", "s1")], "entity string, source string")
    writes = spark.createDataFrame([("h", f"t{k}") for k in range(5)] + [("e", "t9"), ("f", "t1")], "entity string, target string")
    want = {("h", f"s{k}", f"t{j}") for k in range(40) for j in range(5)} | {("e", "s1", "t9")}
    for block in (7, 1000):
        got = [tuple(r) for r in graph.met(reads, writes, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_status_counts_entity_edges(spark):
    e = frame(spark, [("raw", "entity:JOB:1"), ("entity:JOB:1", "gold")])
    n = spark.createDataFrame([("raw",), ("gold",), ("lonely",)], "node string")
    assert {r["node"]: r["lineage_status"] for r in graph.degrees(n, e).collect()} == {"raw": "root", "gold": "leaf", "lonely": "orphan"}


def test_cone_passes_entities_for_free_and_shows_their_neighbours(spark):
    e = frame(spark, [("a", "entity:JOB:1"), ("entity:JOB:1", "b"), ("x", "entity:JOB:1"), ("b", "c"), ("c", "d")])
    assert {r[0] for r in graph.cone(e, "b", 1).collect()} == {"a", "x", "b", "c", "entity:JOB:1"}


def test_read_after_write_is_drawn_straight(spark):
    rows = [("main.b.raw", "main.s.t", "JOB", "1"), ("main.s.t", "main.g.u", "JOB", "1"), ("main.g.u", "main.g.w", None, None)]
    df = spark.createDataFrame(rows, "source_table_full_name string, target_table_full_name string, entity_type string, entity_id string").withColumn("event_time", F.lit("2026-06-01").cast("timestamp"))
    got = {tuple(r) for r in scope.routed(scope.records(df)).collect()}
    job = "entity:JOB:1"
    assert got == {("main.b.raw", job), (job, "main.s.t"), (job, "main.g.u"), ("main.s.t", "main.g.u"), ("main.g.u", "main.g.w")}


META = [("main", "bronze", "customers", "MANAGED"), ("main", "bronze", "raw_orders", "MANAGED"), ("main", "silver", "customers", "MANAGED")]


def test_scope_spans_schemas_and_makes_stubs(spark):
    tables = spark.createDataFrame(META, "table_catalog string, table_schema string, table_name string, table_type string")
    df = spark.createDataFrame([("main.bronze.raw_orders", "main.silver.customers", "TABLE", "TABLE")], "source_table_full_name string, target_table_full_name string, source_type string, target_type string").withColumn("event_time", F.lit("2026-06-01").cast("timestamp"))
    rows = scope.records(df)
    nodes, edges = scope.scope_graph(rows, tables, "main")
    assert {r["node"] for r in nodes.collect()} == {"main.bronze.customers", "main.bronze.raw_orders", "main.silver.customers"}
    nodes, _ = scope.scope_graph(rows, tables, "main", "bronze")
    stub = nodes.filter("external").first()
    assert (stub["node"], stub["lineage_status"]) == ("main.silver.customers", "leaf")
    with pytest.raises(ValueError, match="choose a schema"):
        scope.scope_graph(rows, tables, "main", node_cap=2)
    scope.scope_graph(rows, tables, "main", "bronze", node_cap=1)


def hops_of(spark, pairs):
    rows = [(f"col:t::{a}", "t", a, f"col:t::{b}", "t", b, f"e{k}", "x", "projection") for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src_node_id string, src_fqn string, src_col string, dst_node_id string, dst_fqn string, dst_col string, edge_id string, expr string, transform_category string")


def test_paths_on_a_random_graph(spark):
    rng = random.Random(3)
    pairs = sorted({(f"c{rng.randrange(12)}", f"c{rng.randrange(12)}") for _ in range(60)})
    h = hops_of(spark, pairs)
    found = []

    def walk(path):
        if path[-1] == "c5" and len(path) > 1:
            found.append(tuple(path))
        elif len(path) <= 5:
            for a, b in pairs:
                if a == path[-1] and b not in path:
                    walk([*path, b])

    walk(["c0"])
    assert found
    got = sorted(tuple(x.rpartition("::")[2] for x in r["nodes"]) for r in paths.simple_paths(h, "col:t::c0", "col:t::c5", 5, None).collect())
    assert got == sorted(found)
    steps = paths.shortest_path(h, "col:t::c0", "col:t::c5", 6).orderBy("step").collect()
    assert len(steps) == min(map(len, found)) - 1
    assert all(a["dst_node_id"] == b["src_node_id"] for a, b in pairwise(steps))
    best = paths.simple_paths(h, "col:t::c0", "col:t::c5", 5, 2).orderBy("path").collect()
    assert [r["length"] for r in best] == sorted(len(p) - 1 for p in found)[:2]


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths_of_many_pairs(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"c{rng.randrange(40)}", f"c{rng.randrange(40)}") for _ in range(70)}) + [("c1", "c2"), ("c1", "c2")]
    h = hops_of(spark, pairs)
    asked = [(f"col:t::c{a}", f"col:t::c{b}") for a in range(0, 40, 3) for b in range(0, 40, 7)] + [("col:t::c1", "col:t::c2"), ("col:t::nothing", "col:t::c1")]
    got = {}
    for r in paths.shortest_paths(h, spark.createDataFrame(asked, "source string, target string"), 5).collect():
        got.setdefault((r["source"], r["target"]), {})[r["step"]] = (r["src_node_id"], r["dst_node_id"], r["edge_id"])
    edges = [(f"col:t::{a}", f"col:t::{b}", f"e{k}") for k, (a, b) in enumerate(pairs) if a != b]
    want = {}
    for s, t in set(asked):
        away = python_reach([(a, b) for a, b, _ in edges], s, 5)
        if s == t or t not in away:
            continue
        path, node = {}, t
        for d in range(away[t], 0, -1):
            e, a = min((e, a) for a, b, e in edges if b == node and away.get(a) == d - 1)
            path[d] = (a, node, e)
            node = a
        want[s, t] = path
    assert got == want and len({len(p) for p in want.values()}) > 2


def test_paths_to_itself_and_to_nowhere(spark):
    h = hops_of(spark, [("a", "b")])
    assert paths.shortest_path(h, "col:t::a", "col:t::a").count() == 0
    assert [r["nodes"] for r in paths.simple_paths(h, "col:t::a", "col:t::a").collect()] == [["col:t::a"]]
    assert paths.shortest_path(h, "col:t::b", "col:t::a").count() == 0
    levels, _ = paths.backtrack(h, "col:t::nothing")
    assert levels.count() == 0
