"""Ids, code, store, service functions and streams."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.operators import cost, hops, report
from weftline.plans import api
from weftline.plans.store import Store
from weftline.sources import code, metadata
from weftline.streaming import ingest

CASES = [
    ("cat.schema.mytable", None, "TABLE", "cat.schema.mytable", "TABLE"),
    ("cat.schema.myview", None, "VIEW", "cat.schema.myview", "VIEW"),
    ("c.s.mv", None, "MATERIALIZED_VIEW", "c.s.mv", "MATERIALIZED_VIEW"),
    ("c.s.st", None, "STREAMING_TABLE", "c.s.st", "STREAMING_TABLE"),
    ("c.s.t", None, None, "c.s.t", "TABLE"),
    (None, "/Volumes/mycatalog/myschema/myvol/data.csv", None, "mycatalog.myschema.myvol", "VOLUME"),
    (None, "dbfs:/Volumes/mycatalog/myschema/myvol/_tmp_write", None, "mycatalog.myschema.myvol", "VOLUME"),
    (None, "/Volumes/onlyone", None, "volume:/Volumes/onlyone", "VOLUME"),
    (None, "s3://my-bucket/prefix/file.parquet", None, "path:s3://my-bucket", "PATH"),
    (None, "abfss://container@account.dfs.core.windows.net/data/", None, "path:abfss://container@account.dfs.core.windows.net", "PATH"),
    (None, "/some/very/long/path/" + "a" * 100, None, "path:" + ("/some/very/long/path/" + "a" * 100)[:80], "PATH"),
    (None, None, None, None, None),
    ("c.s.t", "s3://bucket/thing", "TABLE", "c.s.t", "TABLE"),
]


def test_refs(spark):
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "k int, t string, p string, kind string")
    got = df.select("k", refs.ref_id(F.col("t"), F.col("p")), refs.ref_type(F.col("t"), F.col("p"), F.col("kind"))).orderBy("k").collect()
    assert [(r[1], r[2]) for r in got] == [c[3:] for c in CASES]


def test_cost_attach(spark):
    e = spark.createDataFrame([("PIPELINE", "pid-1", 0.01), ("JOB", "job-1", None)], "entity_type string, entity_id string, cost_usd double")
    c = spark.createDataFrame([("PIPELINE", "pid-1", 9.99)], "entity_type string, entity_id string, cost_usd double")
    assert {r["entity_id"]: r["cost_usd"] for r in cost.with_cost(e, c).collect()} == {"pid-1": 9.99, "job-1": None}
    assert all(r["cost_usd"] is None for r in cost.with_cost(e, c.limit(0)).collect())


def test_identifiers():
    for kind in ("JOB", "PIPELINE", "NOTEBOOK", "DASHBOARD_V3"):
        with pytest.raises(ValueError, match="not an id"):
            api.checked_entity(kind, "1; DROP TABLE x --")
    assert api.checked_entity("JOB", "12345") == "12345"
    assert api.step_of(0) == (0, "Validating Table") and api.step_of(41) == (4, "Dependency Parsing") and api.step_of(100)[0] == 7
    assert api.checked_table("a.b.c") == "a.b.c"
    for bad in ("a.b", "a.b.c.d", "a.b.c;"):
        with pytest.raises(ValueError, match="three parts"):
            api.checked_table(bad)


def test_diagnostics(spark):
    ok = spark.range(1)
    assert not metadata.diagnostics(spark, {"access": None}, {"billing": ok}).first()["ok"]
    assert metadata.diagnostics(spark, {"access": ok}, {"billing": None}).first()["ok"]


NOTEBOOK = """# Notebook source
# DBTITLE 1,Load
# MAGIC %sql
# MAGIC CREATE TABLE main.gold.t AS
# MAGIC SELECT o.amount * 2 AS twice FROM main.sales.orders o

# COMMAND ----------

# MAGIC %md
# MAGIC # words

# COMMAND ----------

df = spark.table("main.a.b").select(F.col("x").alias("y"))
df.write.saveAsTable("main.a.c")
"""


def test_cells():
    got = code.cells_of(NOTEBOOK, "python")
    assert [lang for lang, _ in got] == ["sql", "python"]
    assert "SELECT o.amount * 2" in got[0][1] and "MAGIC" not in got[0][1] and "DBTITLE" not in got[0][1]
    assert code.cells_of('{"cells": [{"cell_type": "sql", "source": ["SELECT ", "1"]}]}', None) == [("sql", "SELECT 1")]
    assert code.cells_of("select 1", "sql") == [("sql", "select 1")]


SQL_CASES = [
    ("CREATE TABLE a.b.t AS SELECT x.id, y.n AS name FROM a.b.x x JOIN a.b.y y ON x.id = y.id", {("id", "a.b.t", "a.b.x", "id"), ("name", "a.b.t", "a.b.y", "n")}),
    ("CREATE TABLE a.b.t AS SELECT p FROM a.b.x; CREATE TABLE a.b.u AS SELECT q FROM a.b.t", {("p", "a.b.t", "a.b.x", "p"), ("q", "a.b.u", "a.b.t", "q")}),
    ("USE CATALOG m; INSERT OVERWRITE s.t SELECT coalesce(v, 0) AS v FROM s.x", {("v", "m.s.t", "m.s.x", "v")}),
    ("CREATE OR REPLACE VIEW a.b.v AS WITH c AS (SELECT k, sum(x) AS y FROM a.b.x GROUP BY k) SELECT c.y AS total FROM c", {("total", "a.b.v", "a.b.x", "x")}),
    ("CREATE OR REFRESH STREAMING TABLE a.b.s AS SELECT id FROM STREAM(a.b.x)", {("id", "a.b.s", "a.b.x", "id")}),
    ("CREATE OR REFRESH MATERIALIZED VIEW a.b.m AS SELECT count(*) AS n, max(d) AS last FROM a.b.x", {("last", "a.b.m", "a.b.x", "d")}),
    ("INSERT INTO a.b.t SELECT extract(year FROM x.d) AS yr FROM a.b.x, a.b.z", {("yr", "a.b.t", "a.b.x", "d")}),
]


@pytest.mark.parametrize("sql,want", SQL_CASES)
def test_sql_mappings(spark, sql, want):
    found, _, warnings = code.sql_mappings(spark, "A", sql)
    assert {(m[1], m[2], m[3], m[4]) for m in found} == want and not warnings


def test_merge_and_bad_sql(spark):
    found, reads, _ = code.sql_mappings(spark, "A", "MERGE INTO a.b.t USING a.b.s ON t.id = s.id WHEN MATCHED THEN DELETE")
    assert not found and reads == [("A", "a.b.s")]
    assert code.sql_mappings(spark, "A", "SELECT a FROM b WHERE (")[2]


def test_python_mappings():
    text = """
CAT = "main"
o = spark.table(f"{CAT}.s.orders").alias("o")
c = dlt.read("main.s.cust").alias("c")
j = o.join(c, "id").withColumn("total", F.col("o.qty") * F.col("o.price"))
out = j.select(F.col("c.name").alias("customer"), "total").withColumnRenamed("customer", "who")
out.write.mode("overwrite").saveAsTable("main.g.sales")
"""
    found, reads = code.python_mappings("A", text)
    assert {(m[1], m[3], m[4]) for m in found} == {("who", "main.s.cust", "name"), ("total", "main.s.orders", "qty"), ("total", "main.s.orders", "price")}
    assert {r[1] for r in reads} == {"main.s.orders", "main.s.cust"}
    assert code.python_mappings("A", "def (") == ([], [])


def test_build_serve_and_clear(spark):
    store = Store(spark, "lineage_test")
    store.ensure()
    artifacts = spark.createDataFrame([("ext_1", "/n/one", "python", NOTEBOOK), ("ext_2", "/n/two.sql", "sql", "INSERT INTO main.a.d SELECT y + 1 AS z FROM main.a.c")], "extraction_id string, source_path string, language string, raw_source string")
    first = api.build(store, artifacts, "run1", "2026-01-01 00:00:00")
    assert first["artifacts"] == 2 and first["hops"] == 3
    assert api.build(store, artifacts, "run1", "2026-01-01 00:00:00") == first  # a repeated run leaves nothing twice
    assert api.build(store, artifacts, "run2", "2026-01-02 00:00:00")["artifacts"] == 0
    steps = api.find_paths(store, "col:main.a.b::x", "col:main.a.d::z", run="run1", now="2026-01-01 01:00:00").orderBy("step").collect()
    assert [r["node"] for r in steps] == ["col:main.a.b::x", "col:main.a.c::y", "col:main.a.d::z"]
    assert store.read("lineage_sublineage_cache").count() == 1
    again = api.find_paths(store, "col:main.a.b::x", "col:main.a.d::z", run="run1", now="2026-01-01 01:30:00")
    assert again.orderBy("step").collect() == steps and store.read("lineage_sublineage_cache").count() == 1  # answered from the cache
    assert api.find_paths(store, "col:main.a.b::x", "col:main.a.d::z", run="run1", mode="k", now="2026-01-01 01:30:00").count() == 3
    assert store.read("lineage_sublineage_cache").count() == 2
    back = api.backtrack(store, "col:main.a.d::z", run="run1")
    assert {(r["node"], r["depth"]) for r in back["levels"].collect()} == {("col:main.a.d::z", 0), ("col:main.a.c::y", 1), ("col:main.a.b::x", 2)}
    assert "error" in api.backtrack(store, "col:no::thing", run="run1")
    assert api.kpi_subgraph(store, "main.a.d", "run1", "2026-01-01 01:00:00").count() >= 4
    assert api.build_unless_fresh(store, artifacts, "main.a.d", "run3", "2026-01-01 02:00:00")["status"] == "fresh"
    store.clear("table", "main.a.c")
    assert {r["dst_fqn"] for r in store.read("lineage_edge_endpoints").collect()} == {"main.gold.t"}
    store.clear("all")
    assert store.read("lineage_nodes").isEmpty()


def test_runs_are_swapped_and_others_stay(spark):
    store = Store(spark, "lineage_swap")
    store.ensure()
    node = "node_id string, table_fqn string"
    for run in ("r1", "r2", "it's"):
        store.replace_run("lineage_nodes", spark.createDataFrame([(f"{run}-a", "main.a"), (f"{run}-b", "main.b")], node), run)
    left = lambda: {(r["pipeline_run_id"], r["node_id"]) for r in store.read("lineage_nodes").collect()}
    assert len(left()) == 6
    store.replace_run("lineage_nodes", spark.createDataFrame([("new", "main.a")], node), "r1")
    assert left() == {("r1", "new"), ("r2", "r2-a"), ("r2", "r2-b"), ("it's", "it's-a"), ("it's", "it's-b")}
    with pytest.raises(Exception, match="broken"):  # a write that fails leaves what was there
        store.replace_run("lineage_nodes", spark.createDataFrame([("x", "main.a")], node).withColumn("label", F.raise_error(F.lit("broken"))), "r1")
    assert ("r1", "new") in left()
    store.replace_run("lineage_nodes", spark.createDataFrame([], node), "it's")
    store.keep_only("lineage_nodes", F.col("table_fqn") == "main.b")
    assert left() == {("r2", "r2-b")}
    with pytest.raises(ValueError):
        store.keep_only("lineage_notebook_path_cache", F.lit(True))


def test_service_latency(spark):
    rows = [(i, f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}", None if i == 99 else float(i % 7)) for i in range(100)]
    requests = spark.createDataFrame(rows, "id long, t string, ms double").withColumn("t", F.col("t").cast("timestamp"))
    got = report.service_latency(requests, "t", "id", "ms", last=50).first()
    v = sorted(r[2] for r in rows[50:99])
    assert tuple(got) == (v[24], v[46], v[48], 49, 50)
    assert report.service_latency(requests, "t", "id", "ms").first()["rate_per_min"] == 60
    assert tuple(report.service_latency(requests.limit(0), "t", "id", "ms").first()) == (0.0, 0.0, 0.0, 0, 0)


def test_version_hash_and_changes(spark):
    h = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "b"), ("r2", "a"), ("r3", "c")], "pipeline_run_id string, edge_id string")
    v = {r[0]: r[1] for r in hops.version_hash(h).collect()}
    assert v["r1"] == v["r2"] != v["r3"]


def test_memo_keeps_only_full_results(spark):
    now = [0.0]
    memo = api.Memo(10, lambda: now[0])
    df, meta = memo.get("a:1", lambda: spark.range(3))
    assert not meta["cached"] and memo.get("a:1", lambda: spark.range(9))[1]["cached"]
    memo.get("a:2", lambda: spark.range(0))
    assert [k for k, _ in memo.snapshot()] == ["a:1"]
    now[0] = 11
    assert memo.get("a:1", lambda: spark.range(9))[0].count() == 9
    assert memo.invalidate("a:") == 1 and not memo.evict("a:1")


def test_sheets(spark):
    nodes = spark.createDataFrame([("c.s.raw", "root"), ("c.s.lonely", "orphan"), ("entity:PIPELINE:p1", None)], "node string, lineage_status string")
    edges = spark.createDataFrame([("c.s.raw", "entity:PIPELINE:p1")], "source string, target string")
    assert report.summary(nodes, edges).first().asDict() == {"tables": 2, "orphans": 1, "entities": 1, "edges": 1}
    real = spark.createDataFrame([("c.s.raw", "c.s.clean", "PIPELINE", "p1")], "source string, target string, entity_type string, entity_id string")
    names = spark.createDataFrame([("PIPELINE", "p1", "Clean & Ingest")], "entity_type string, entity_id string, name string")
    assert tuple(report.lineage_sheet(real, names).first()) == ("c.s.raw", "c.s.clean", "Clean & Ingest")
    assert {r["schema"] for r in report.schema_maps(nodes, edges).collect()} == {"c.s"}


def test_sources_of_runs(spark):
    runs = spark.sql("SELECT 7L AS run_id, array(named_struct('task_key', 'a', 'notebook_path', '/n', 'python_file', null, 'sql_file', null, 'git_url', 'g'), named_struct('task_key', 'b', 'notebook_path', null, 'python_file', null, 'sql_file', '/q.sql', 'git_url', null)) AS tasks")
    assert {(r["task_key"], r["source_kind"], r["language"]) for r in metadata.task_sources(runs).collect()} == {("a", "git_notebook", "python"), ("b", "workspace_sql", "sql")}
    wanted = spark.createDataFrame([("c.s.v",), ("c.s.f",), ("c.s.t",)], "full_name string")
    tables = spark.createDataFrame([("c", "s", "v", "VIEW"), ("c", "s", "f", "FOREIGN"), ("c", "s", "t", "MANAGED")], "table_catalog string, table_schema string, table_name string, table_type string")
    ddl = spark.createDataFrame([("c.s.v", "CREATE VIEW c.s.v AS SELECT 1")], "full_name string, ddl string")
    assert {(r[0], r[2]) for r in metadata.definitions(wanted, tables, ddl).collect()} == {("c.s.v", None), ("c.s.f", "external_source")}
    history = spark.createDataFrame([("INSERT INTO c.s.t SELECT 1", "FINISHED", "INSERT", "2026-01-01 10:00:00"), ("SELECT * FROM c.s.t", "FINISHED", "SELECT", "2026-01-01 11:00:00")], "statement_text string, execution_status string, statement_type string, start_time string").withColumn("start_time", F.col("start_time").cast("timestamp"))
    assert [r["statement_text"] for r in metadata.producing_queries(history, wanted, as_of="2026-01-01 12:00:00", hours=1).filter("full_name = 'c.s.t'").collect()] == ["INSERT INTO c.s.t SELECT 1"]
    audit = spark.sql("SELECT map('notebookId', '1', 'path', '/a') AS request_params, date'2026-01-01' AS event_date, timestamp'2026-01-01 01:00:00' AS event_time UNION ALL SELECT map('notebookId', '1', 'path', '/b'), date'2026-01-01', timestamp'2026-01-01 02:00:00'")
    ids = spark.createDataFrame([("1",), ("2",)], "notebook_id string")
    cache = spark.sql("SELECT '2' AS notebook_id, '/two' AS nb_path, timestamp'2025-01-01' AS resolved_at")
    both, new = metadata.cached_paths(audit, ids, cache, as_of="2026-01-02 00:00:00", days=30)
    assert {tuple(r) for r in both.collect()} == {("1", "/b"), ("2", "/two")} and new.count() == 1


def test_a_producer_is_found_behind_any_number_of_later_statements(spark):
    texts = [("INSERT INTO c.s.t SELECT 1", 0), ("INSERT INTO c.s.t SELECT 2", 1), ("INSERT INTO c.s.u SELECT 1", 2)] + [(f"INSERT INTO c.s.u SELECT a + {i} FROM c.s.t", 10 + i) for i in range(90)]
    history = spark.createDataFrame([(s, "FINISHED", "INSERT", m) for s, m in texts], "statement_text string, execution_status string, statement_type string, m int").withColumn("start_time", F.expr("timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m)"))
    wanted = spark.createDataFrame([("c.s.t",), ("c.s.u",), ("c.s.v",)], "full_name string")
    found = code.producers(spark, metadata.producing_queries(history, wanted, as_of="2026-01-01 12:00:00", hours=24), wanted)
    assert {tuple(r) for r in found.collect()} == {("c.s.t", 91, "INSERT INTO c.s.t SELECT 2", None), ("c.s.u", 1, "INSERT INTO c.s.u SELECT a + 89 FROM c.s.t", None), ("c.s.v", None, None, "no_producing_query")}


def test_stream_of_events(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.createDataFrame([("a.b.x", "a.b.y", None, "JOB", "1", "u"), ("a.b.x", "a.b.y", None, "JOB", "1", "u"), ("a.b.y", "a.b.z", None, None, None, "u")], "source_table_full_name string, target_table_full_name string, source_path string, entity_type string, entity_id string, created_by string").withColumn("event_time", F.lit("2026-01-01").cast("timestamp"))
    rows.write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        ingest.start_edge_upsert(ingest.lineage_stream(spark, src, rows.schema), out, state).awaitTermination()
    assert {(r["source"], r["target"], r["events"]) for r in ingest.read_edges(spark, out).collect()} == {("a.b.x", "a.b.y", 1), ("a.b.y", "a.b.z", 1)}


def test_derived_views_use_every_row(spark, sf):
    from weftline.sources.derived import view

    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert {view(spark, sf, v).count() for v in ("v_lineage", "v_usage", "v_run_hops")} == {n}
    assert view(spark, sf, "v_tables").count() == spark.read.parquet(f"{sf}/part.parquet").count() > 170
    assert view(spark, sf, "v_lineage").select("target_table_full_name").distinct().count() > 160
