"""The engine's entry points: what a service in front of it would call."""

from __future__ import annotations

import re
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.operators import cost as costs
from weftline.operators import graph, hops, paths, scope
from weftline.plans.durable import saved, size_of
from weftline.plans.store import Store
from weftline.sources import code

_PART, _TABLE = re.compile(r"^[A-Za-z0-9_]{1,255}$"), re.compile(r"^[A-Za-z0-9_]{1,255}(\.[A-Za-z0-9_]{1,255}){2}$")
# What ids of each kind of entity look like; the last is for all other kinds.
_ENTITY = {
    "JOB": re.compile(r"^[0-9]{1,32}$"),
    "PIPELINE": re.compile(r"^[a-fA-F0-9-]{8,64}$"),
    "NOTEBOOK": re.compile(r"^[A-Za-z0-9_./@ +-]{1,512}$"),
    "": re.compile(r"^[A-Za-z0-9_./@ +-]{1,256}$"),
}
# The steps of a build and the progress in per cent up to which each lasts.
STEPS = (
    ("Validating Table", 5),
    ("Initializing Job", 10),
    ("Schema Discovery", 25),
    ("SQL Extraction", 40),
    ("Dependency Parsing", 55),
    ("Graph Construction", 70),
    ("Edge Materialization", 90),
    ("Cache Update", 100),
)


#: Nodes of a graph that the graph cache keeps as one text.
GRAPH_ROWS = 50_000


def checked_identifier(text: str) -> str:
    if not _PART.match(text or ""):
        raise ValueError(f"not an identifier: {text!r}")
    return text


def checked_table(text: str) -> str:
    if not _TABLE.match(text or ""):
        raise ValueError(f"not a name of three parts: {text!r}")
    return text


def checked_entity(kind: str, ident: str) -> str:
    ident = (ident or "").strip()
    if not _ENTITY.get(kind.upper(), _ENTITY[""]).match(ident):
        raise ValueError(f"not an id of {kind}: {ident!r}")
    return ident


class Memo:
    """Results by key for a while: DataFrames that were written once. Empty, failed and truncated results are not kept.

    Callers that ask for one key at one time wait for one computation. Results are kept up to ``max_bytes`` of their files; beyond it those go that were used least recently."""

    def __init__(self, seconds: float = 8 * 3600, clock: Callable[[], float] = time.time, max_bytes: int = 8 << 30):
        self.seconds, self.clock, self.max_bytes = seconds, clock, max_bytes
        self.kept: OrderedDict[str, tuple[DataFrame, float, int]] = OrderedDict()
        self.lock = threading.Lock()
        self.under_way: dict[str, threading.Lock] = {}
        self.waiting: dict[str, int] = {}

    def get(self, key: str, make: Callable[[], DataFrame], *, fresh: bool = False, keep: Callable[[DataFrame], bool] | None = None) -> tuple[DataFrame, dict]:
        """The result and its metadata: whether it was kept, since when, until when. ``fresh`` makes it anew and keeps it."""
        held = None if fresh else self._held(key)
        if held is None:
            with self.lock:
                turn = self.under_way.setdefault(key, threading.Lock())
                self.waiting[key] = self.waiting.get(key, 0) + 1
            try:
                with turn:
                    held = None if fresh else self._held(key)  # another caller may have made it meanwhile
                    if held is None:
                        return self._made(key, make, keep)
            finally:
                with self.lock:
                    self.waiting[key] -= 1
                    if not self.waiting[key]:
                        del self.waiting[key], self.under_way[key]
        return held[0], {"cached": True, "cached_at": held[1], "expires_at": held[1] + self.seconds}

    def _held(self, key: str) -> tuple[DataFrame, float, int] | None:
        with self.lock:
            held = self.kept.get(key)
            if held is None or self.clock() - held[1] >= self.seconds:
                return None
            self.kept.move_to_end(key)
            return held

    def _made(self, key: str, make: Callable[[], DataFrame], keep: Callable[[DataFrame], bool] | None) -> tuple[DataFrame, dict]:
        df = saved(make(), "memo")
        now = self.clock()
        if not df.isEmpty() and (keep is None or keep(df)):
            size = size_of(df)
            with self.lock:
                self.kept.pop(key, None)
                self.kept[key] = (df, now, size)
                while len(self.kept) > 1 and sum(n for _, _, n in self.kept.values()) > self.max_bytes:
                    self.kept.popitem(last=False)
        return df, {"cached": False, "cached_at": now, "expires_at": now + self.seconds}

    def invalidate(self, prefix: str = "") -> int:
        with self.lock:
            gone = [k for k in self.kept if k.startswith(prefix)]
            for k in gone:
                del self.kept[k]
        return len(gone)

    def evict(self, key: str) -> bool:
        with self.lock:
            return self.kept.pop(key, None) is not None

    def snapshot(self) -> list[tuple[str, float]]:
        """(key, seconds left), the oldest first."""
        now = self.clock()
        with self.lock:
            return sorted(((k, max(0.0, self.seconds - (now - at))) for k, (_, at, _) in self.kept.items()), key=lambda x: (x[1], x[0]))


class Lineage:
    """Table and column lineage over source tables given as DataFrames."""

    def __init__(self, lineage: DataFrame, *, tables: DataFrame | None = None, column_lineage: DataFrame | None = None, cost: DataFrame | None = None, as_of: str | None = None, days: int = 365, memo: Memo | None = None):
        self.rows = scope.records(lineage, as_of=as_of, days=days if as_of else None)
        self.tables, self.columns, self.cost, self.as_of, self.days = tables, column_lineage, cost, as_of, days
        self.memo = memo or Memo()

    def scope(self, catalog: str, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a catalog or schema."""
        checked_identifier(catalog)
        return scope.scope_graph(self.rows, self.tables, catalog, schema and checked_identifier(schema))

    def trace(self, table: str, max_hops: int = graph.MAX_HOPS, node_cap: int | None = graph.NODE_CAP) -> dict[str, object]:
        """nodes, edges, entities (with cost) and truncated of a table's directional cone."""
        rows, truncated = scope.trace_rows(self.rows, checked_table(table), max_hops, node_cap)
        rows = saved(rows, "traced")
        edges = saved(scope.routed(rows), "edges")
        kinds = rows.select(F.col("source").alias("node"), F.col("source_kind").alias("kind")).unionByName(rows.select(F.col("target").alias("node"), F.col("target_kind").alias("kind"))).filter("node is not null").groupBy("node").agg(F.max("kind").alias("kind"))
        nodes = kinds.join(graph.degrees(kinds, edges), "node").withColumn("name", refs.display_name(F.col("node")))
        entities = scope.rollup(rows)
        return {"nodes": nodes, "edges": edges, "entities": costs.with_cost(entities, self.cost) if self.cost is not None else entities, "truncated": truncated}

    def cone(self, table: str, depth: int = 0, mode: str = "full") -> DataFrame:
        """Edges of a view of the nodes around a table."""
        edges = saved(scope.routed(self.rows), "edges")
        return graph.view(graph.induced(edges, graph.cone(edges, table, depth)), mode)

    def schema_columns(self, catalog: str, schema: str) -> DataFrame:
        return paths.column_edges(self.columns, checked_identifier(catalog), checked_identifier(schema), as_of=self.as_of, days=self.days)

    def column_trace(self, table: str, column: str) -> DataFrame:
        return paths.column_trace(self.columns, checked_table(table), column)


def build(store: Store, artifacts: DataFrame, run: str, now: str, *, catalog: str | None = None, schema: str | None = None, force: bool = False, columns: DataFrame | None = None) -> dict[str, int]:
    """Write a run of the store from artifacts (extraction_id, source_path, language, raw_source): code, versions, graph, hops. Returns counts; artifacts that
    have not changed since they were last recorded are left out unless forced. ``columns`` (table_fqn, column_name, ordinal_position) settles stars and bare names."""
    spark: SparkSession = store.spark
    at = F.lit(now).cast("timestamp")
    versions = saved(hops.changed(artifacts, store.read("lineage_code_versions").filter(F.col("pipeline_run_id") != run), force), "versions")
    wanted = saved(artifacts.join(versions.filter("is_new").select("extraction_id"), "extraction_id", "left_semi"), "wanted")
    store.replace_run("lineage_raw_code", wanted.withColumn("extracted_at", at).withColumn("content_sha256", F.sha2("raw_source", 256)), run)
    store.replace_run("lineage_code_versions", versions.select("extraction_id", F.col("token").alias("content_sha256"), F.col("is_new").alias("is_new_version"), at.alias("recorded_at")), run)
    mappings, reads = code.lineage_of(spark, wanted, catalog, schema, columns)
    mappings, reads = saved(mappings, "mappings"), saved(reads, "reads")
    nodes, edges = hops.graph_of(mappings, reads)
    nodes, edges = saved(nodes, "nodes"), saved(edges, "edges")
    store.replace_run("lineage_nodes", nodes.withColumn("created_at", at), run)
    store.replace_run("lineage_edges", edges.withColumn("created_at", at), run)
    served, _ = hops.enriched(hops.edge_endpoints(nodes, edges, store.read("lineage_raw_code", run)), store.read("lineage_pyspark_to_sql_cache"))
    store.replace_run("lineage_edge_endpoints", served.withColumn("materialized_at", at), run)
    counts = mappings.groupBy(F.col("artifact_id").alias("extraction_id")).agg(F.count(F.lit(1)).cast("int").alias("mapping_count")).withColumn("parsed_at", at)
    store.replace_run("lineage_parse_metrics", counts, run)
    return {"artifacts": wanted.count(), "nodes": nodes.count(), "edges": edges.count(), "hops": store.read("lineage_edge_endpoints", run).count()}


def build_unless_fresh(store: Store, artifacts: DataFrame, table: str, run: str, now: str, *, force: bool = False, **options: str | None) -> dict[str, object]:
    """``build``, unless the table's hops are fresh and nothing forces it."""
    state = hops.freshness(store.read("lineage_edge_endpoints"), table, now).first()
    if not force and state["exists"] and not state["is_stale"]:
        return {"status": "fresh", "age": state["age"]}
    return {"status": "built"} | build(store, artifacts, run, now, force=force, **options)


def step_of(percent: float) -> tuple[int, str]:
    """Number and name of the step that a build is in."""
    number = next((k for k, (_, upto) in enumerate(STEPS) if percent <= upto), len(STEPS) - 1)
    return number, STEPS[number][0]


def find_paths(store: Store, source: str, target: str, *, run: str | None = None, mode: str = "shortest", max_depth: int = paths.MAX_DEPTH, max_paths: int = paths.MAX_PATHS, now: str | None = None) -> DataFrame:
    """(path, step, node, edge_id, expression) of paths between columns of a run (the latest by default); ``mode`` is shortest, all or k.

    With ``now`` the shortest and the k paths, which are bounded, are kept in the path cache under the hash of the run's edges, and a question asked before is
    answered from it without a walk."""
    if mode not in ("shortest", "all", "k"):
        raise ValueError("mode is shortest, all or k")
    every = store.read("lineage_edge_endpoints")
    run = run or hops.latest_run(every).first()["pipeline_run_id"]
    own = every.filter(F.col("pipeline_run_id") == run)  # a partition of the store's table, which is not copied
    kept_as = None if mode == "all" else now
    if kept_as is not None:
        version = hops.version_hash(own).first()["version_hash"]
        key = f"steps|{source}|{target}|{mode}|{max_depth}|{max_paths}|{version}"
        kept = store.read("lineage_sublineage_cache", run).filter(F.col("cache_key") == key).select("paths_json").limit(1)
        known = saved(kept.select(F.inline(F.from_json("paths_json", "array<struct<path int, step int, node string, edge_id string, expression string>>"))), "known")
        if not known.isEmpty():
            return known
    if mode == "shortest":
        steps = paths.shortest_path(own, source, target, max_depth)
        one = steps.agg(F.sort_array(F.collect_list(F.struct("step", "dst_node_id", "edge_id"))).alias("s")).filter(F.size("s") > 0)  # a path has max_depth steps at most
        found = one.select(F.lit(1).alias("path"), F.concat(F.array(F.lit(source)), F.transform("s", lambda x: x["dst_node_id"])).alias("nodes"), F.transform("s", lambda x: x["edge_id"]).alias("edges"))
    else:
        found = paths.simple_paths(own, source, target, max_depth, max_paths if mode == "k" else None)
    shown = saved(paths.rendered(found, own), "paths")
    if kept_as is not None and not shown.isEmpty():
        sums = shown.agg(F.countDistinct("path").cast("int").alias("path_count"), F.max("step").alias("hop_count"), F.to_json(F.sort_array(F.collect_list(F.struct(*shown.columns)))).alias("paths_json"))
        store.append("lineage_sublineage_cache", sums.withColumns({"cache_key": F.lit(key), "src_node_id": F.lit(source), "dst_node_id": F.lit(target), "mode": F.lit(mode), "version_hash": F.lit(version), "computed_at": F.lit(kept_as).cast("timestamp")}), run)
    return shown


def backtrack(store: Store, target: str, *, run: str | None = None, max_depth: int = paths.MAX_DEPTH, include: Sequence[str] | None = None, exclude_tables: Sequence[str] = ()) -> dict[str, object]:
    """Levels and edges upstream of a column, with the run; for a column that the run lacks an error and some of the columns that it has."""
    every = store.read("lineage_edge_endpoints")
    run = run or hops.latest_run(every).first()["pipeline_run_id"]
    own = every.filter(F.col("pipeline_run_id") == run)
    levels, edges = paths.backtrack(own, target, max_depth, include, exclude_tables)
    if levels.isEmpty():
        sample = own.select("dst_node_id").distinct().orderBy("dst_node_id").limit(20)
        return {"run": run, "error": f"unknown column {target}", "sample": [r[0] for r in sample.collect()]}
    return {"run": run, "levels": levels, "edges": edges}


def kpi_subgraph(store: Store, table: str, run: str, now: str, max_hops: int = 6) -> DataFrame:
    """Nodes around a table (as it is read, and its columns), whichever way edges point, and their record in the graph cache.

    The record is one JSON text; of over ``GRAPH_ROWS`` nodes, which no display shows, there is none, and the nodes are returned all the same."""
    nodes, edges = store.read("lineage_nodes", run), store.read("lineage_edges", run)
    seeds = nodes.filter((F.col("node_id") == f"tbl:{table}") | (F.col("table_fqn") == table)).select(F.col("node_id").alias("node"))
    ball = saved(graph.undirected_ball(edges.select(F.col("src_id").alias("source"), F.col("dst_id").alias("target")), seeds, max_hops), "ball")
    if ball.count() > GRAPH_ROWS:
        return ball
    about = ball.agg(F.to_json(F.sort_array(F.collect_list(F.struct("depth", "node")))).alias("graph_json"))  # a display's graph
    store.append("lineage_graph_cache", about.withColumns({"cache_key": F.lit(f"undirected:{table}:{max_hops}"), "kpi_table_fqn": F.lit(table), "version_hash": F.sha2("graph_json", 256), "materialized_at": F.lit(now).cast("timestamp")}), run)
    return ball
