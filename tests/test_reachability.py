"""The interval index against plain Python on random graphs, with and without cycles, and its lists and numbers by themselves."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import reachability
from weftline.plans import catalogue


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def closure(pairs):
    after = {}
    for s, t in pairs:
        after.setdefault(s, set()).add(t)
        after.setdefault(t, set())
    out = {}
    for n in after:
        seen, todo = {n}, [n]
        while todo:
            new = after[todo.pop()] - seen
            seen |= new
            todo += new
        out[n] = seen
    return out


def random_graph(seed, cyclic):
    rng = random.Random(seed)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
    return sorted({(f"n{s:02}", f"n{t:02}") for s, t in pairs if s != t and (cyclic or s < t)})


@pytest.mark.parametrize(("seed", "cyclic", "most", "block"), [(1, False, 32, 1000), (2, False, 1, 2), (3, True, 2, 3)])
def test_index_on_random_graphs(spark, seed, cyclic, most, block):
    pairs = random_graph(seed, cyclic)
    want = closure(pairs)
    index = reachability.build(frame(spark, [*pairs, *pairs[:3], (None, "n01"), ("n02", None), ("n03", "n03")]), most, block)
    assert index.cyclic == cyclic
    nodes = sorted(want)
    asked = [(s, t) for s in [*nodes, "out"] for t in [*nodes, "out"]]
    got = {(r["source"], r["target"]): r["reaches"] for r in index.reaches(frame(spark, [*asked, asked[0], (None, "n01")])).collect()}
    assert got == {(s, t): s == t or t in want.get(s, ()) for s, t in asked}
    for n in nodes[:: len(nodes) // 3]:
        assert sorted(r[0] for r in index.descendants(n).collect()) == sorted(want[n])
        assert sorted(r[0] for r in index.ancestors(n).collect()) == [m for m in nodes if n in want[m]]
    lists = index.labels.groupBy("comp", "exact").count()
    assert lists.filter("count > %d" % most).count() == 0


def test_numbers_make_subtrees_intervals(spark):
    """A tree needs one exact interval a node and leaves nothing open."""
    index = reachability.build(frame(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("b", "e"), ("c", "f")]), 1, 1)
    pre = {r["comp"]: r["pre"] for r in index.numbers.collect()}
    assert sorted(pre.values()) == list(range(6))
    labels = {r["comp"]: (r["lo"], r["hi"], r["exact"]) for r in index.labels.collect()}
    assert len(labels) == index.labels.count()
    for n, size in {"a": 6, "b": 3, "c": 2, "d": 1, "e": 1, "f": 1}.items():
        assert labels[n] == (pre[n], pre[n] + size - 1, True)


def test_empty_index(spark):
    index = reachability.build(frame(spark, []))
    assert index.descendants("a").count() == index.ancestors("a").count() == 0
    assert [r["reaches"] for r in index.reaches(frame(spark, [("a", "b")])).collect()] == [False]


def test_lists_are_bounded_and_cover(spark):
    rows = spark.createDataFrame([("k", lo, lo + w, True) for lo, w in ((0, 5), (6, 0), (10, 1), (20, 0), (21, 3), (22, 1), (40, 0))] + [("k", 60, 70, False)], "comp string, lo long, hi long, exact boolean")
    got = {(r["lo"], r["hi"], r["exact"]) for r in reachability.united(rows, ["comp"], 2).collect()}
    assert got == {(0, 6, True), (20, 24, True), (10, 40, False), (60, 70, False)} or got == {(0, 6, True), (20, 24, True), (10, 11, False), (40, 70, False)}


@pytest.mark.parametrize(("seed", "cyclic"), [(4, False), (5, True)])
def test_pairs_asked_once_need_no_index(spark, seed, cyclic, monkeypatch):
    pairs = random_graph(seed, cyclic)
    want, asked = closure(pairs), [(s, t) for s in [*closure(pairs), "out"] for t in [*closure(pairs), "out"]]
    monkeypatch.setattr(reachability, "build", lambda *_: 1 / 0)
    for bits in (64, 3):
        monkeypatch.setattr(reachability, "BITS", bits)
        got = reachability.reaching(frame(spark, [*pairs, *pairs[:3], (None, "n01"), ("n03", "n03")]), frame(spark, [*asked, asked[0], (None, "n01")]))
        assert sorted(map(tuple, got.collect())) == sorted((s, t, s == t or t in want.get(s, ())) for s, t in asked)


def test_pairs_whose_nodes_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = reachability.reaching(frame(spark, [("a", "b"), ("b", "c"), ("x", "c")]), frame(spark, [("a", "c"), ("a", "x"), ("c", "a"), ("out", "c"), ("out", "out")]))
    assert {(s, t): r for s, t, r in got.collect()} == {("a", "c"): True, ("a", "x"): False, ("c", "a"): False, ("out", "c"): False, ("out", "out"): True}
    assert reachability.reaching(frame(spark, []), frame(spark, [("a", "b"), ("a", "a")])).filter("reaches").collect() == [("a", "a", True)]


def test_reaching_pairs_builds_no_index(spark, sf, monkeypatch):
    monkeypatch.setattr(reachability, "build", lambda *_: 1 / 0)
    rows = catalogue._records(spark, sf)
    want = closure({(s, t) for s, t in rows.select("source", "target").collect() if s and t and s != t})
    got = list(map(tuple, catalogue.reaching_pairs(spark, sf).collect()))
    assert len({(s, t) for s, t, _ in got}) == len(got) > 100 and all(r == (s == t or t in want.get(s, ())) for s, t, r in got)
