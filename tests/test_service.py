"""Memo, translation of expressions, extraction report."""

import threading

from weftline.operators import hops, report
from weftline.plans.api import Memo
from weftline.sources import metadata


def test_twenty_callers_make_one_computation(spark):
    memo, made, got = Memo(), [], []
    gate = threading.Event()

    def make():
        made.append(1)
        gate.wait(5)
        return spark.range(3)

    callers = [threading.Thread(target=lambda: got.append(memo.get("k", make))) for _ in range(20)]
    for c in callers:
        c.start()
    gate.set()
    for c in callers:
        c.join(120)
    assert len(made) == 1 and len(got) == 20
    assert [m["cached"] for _, m in got].count(False) == 1
    assert all(df.count() == 3 for df, _ in got[:3])
    assert not memo.under_way and not memo.waiting


def test_a_failure_lets_the_next_caller_try(spark):
    memo = Memo()
    calls = []

    def make():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("no")
        return spark.range(1)

    try:
        memo.get("k", make)
    except RuntimeError:
        pass
    assert memo.get("k", make)[0].count() == 1 and len(calls) == 2 and not memo.under_way


def test_the_least_recently_used_goes_first(spark):
    memo = Memo(max_bytes=1)
    for k in ("a", "b"):
        memo.get(k, lambda: spark.range(100))
    assert list(memo.kept) == ["b"]  # the newest stays, even if it alone is too large
    size = memo.kept["b"][2]
    memo = Memo(max_bytes=2 * size + size // 2)
    for k in ("a", "b"):
        memo.get(k, lambda: spark.range(100))
    assert memo.get("a", lambda: spark.range(1))[1]["cached"]
    memo.get("c", lambda: spark.range(100))
    assert list(memo.kept) == ["a", "c"]
    memo.get("a", lambda: spark.range(7), fresh=True)
    assert memo.kept["a"][0].count() == 7 and list(memo.kept) == ["c", "a"]
    memo.get("none", lambda: spark.range(0))
    assert "none" not in memo.kept and memo.invalidate("c") == 1 and memo.evict("a")


def test_translation_in_batches_with_retries(spark, tmp_path):
    log = tmp_path / "calls"
    rows = [(f"e{k}", f"x{k % 9}", "pyspark", None) for k in range(30)] + [("s", "y", "sql", "y"), ("n", None, "pyspark", None), ("bad", "boom", "pyspark", None)]
    h = spark.createDataFrame(rows, "edge_id string, expr string, expr_lang string, expr_sql string").coalesce(1)
    cache = spark.createDataFrame([], "expr_sha string, pyspark_expr string, sql_expr string")
    path = str(log)

    def setup():
        failed = []

        def model(batch):
            with open(path, "a") as f:  # noqa: PTH123  a worker's own note
                f.write(f"{len(batch)}\n")
            if "boom" in batch or not failed:
                failed.append(1)
                raise RuntimeError("busy")
            return [None if e == "x3" else e.upper() for e in batch]

        return model

    full, cache = hops.translated(h, cache, setup, batch=1, attempts=2)
    got = {r["edge_id"]: r["expr_sql"] for r in full.collect()}
    assert got == {**{f"e{k}": None if k % 9 == 3 else f"X{k % 9}" for k in range(30)}, "s": "y", "n": None, "bad": None}
    calls = len(log.read_text().split())
    cache = spark.createDataFrame(cache.filter("pyspark_expr != 'x5'").collect(), cache.schema)
    again, _ = hops.translated(h.filter("expr not in ('boom', 'x3')"), cache, setup, batch=8)
    assert {r["expr_sql"] for r in again.filter("expr = 'x5'").collect()} == {"X5"}
    assert len(log.read_text().split()) == calls + 2  # the one that the cache lacked, after one failure
    _, whole = hops.translated(h.filter("expr not in ('boom', 'x3')"), cache.unionByName(spark.createDataFrame([(r["expr_sha"], "x5", "X5") for r in hops.pending_expressions(h, cache).filter("pyspark_expr = 'x5'").collect()], cache.schema)), setup)
    assert whole.count() == 8 and len(log.read_text().split()) == calls + 2


def test_extraction_report(spark):
    rows = [("git", None, None, 2), ("git", "empty", None, 1), ("file", None, "no", None), ("file", "empty", "no", 4)]
    got = {(r["item"], r["name"]): r["value"] for r in metadata.extraction_report(spark.createDataFrame(rows, "source_kind string, skip_reason string, error string, seconds int")).collect()}
    assert got == {("artifacts_extracted", None): 1, ("artifacts_skipped", None): 2, ("artifacts_failed", None): 2, ("by_source_kind", "git"): 1, ("skip_reasons", "empty"): 2, ("errors", "no"): 2, ("timings", "git"): 3, ("timings", "file"): 4}


def test_client_sheet_collapses_entities(spark):
    e = spark.createDataFrame([("c.s.a", "entity:JOB:1"), ("c.s.b", "entity:JOB:1"), ("entity:JOB:1", "c.t.x"), ("d.s.q", "d.s.r")], "source string, target string")
    assert [tuple(r) for r in report.client_lineage_sheet(e, "c", "s").collect()] == [("c.s.a", "c.t.x"), ("c.s.b", "c.t.x")]
