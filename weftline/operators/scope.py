"""Table lineage graphs from lineage records: of a scope, and of traced rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.operators import graph
from weftline.plans.durable import saved

# Types of a lineage record's columns that a source may lack.
OPTIONAL = ("source_type", "target_type", "source_path", "target_path", "entity_type", "entity_id", "created_by")


def records(lineage: DataFrame, *, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Lineage records with node ids: source, source_kind, target, target_kind, entity, and what they came from.

    With ``as_of`` and ``days`` only records in the window; internal tables never."""
    rows = lineage
    for c in OPTIONAL:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    s, t = F.col("source_table_full_name"), F.col("target_table_full_name")
    rows = rows.filter(refs.not_internal_lineage(s, t))
    if as_of is not None and days is not None:
        rows = rows.filter(refs.in_window(F.col("event_time"), F.lit(as_of), days))
    return rows.select(
        "*",
        refs.ref_id(s, F.col("source_path")).alias("source"), refs.ref_type(s, F.col("source_path"), F.col("source_type")).alias("source_kind"),
        refs.ref_id(t, F.col("target_path")).alias("target"), refs.ref_type(t, F.col("target_path"), F.col("target_type")).alias("target_kind"),
        refs.entity_key(F.col("entity_type"), F.col("entity_id")).alias("entity"),
    )


def scoped(rows: DataFrame, catalog: str, schema: str | None = None) -> DataFrame:
    return rows.filter(refs.in_scope(F.col("source_table_full_name"), F.col("target_table_full_name"), F.col("source_path"), F.col("target_path"), catalog, schema))


def rollup(rows: DataFrame) -> DataFrame:
    """One row per entity: its type and id, numbers of distinct sources and targets, the last run, and the owner of the latest record that names one."""
    named = rows.filter("entity is not null")
    latest = F.max(F.when(F.col("created_by").isNotNull(), F.struct("event_time", "created_by")))
    return named.groupBy("entity", "entity_type", "entity_id").agg(
        F.countDistinct("source").alias("n_sources"), F.countDistinct("target").alias("n_targets"), F.max("event_time").alias("last_run"), latest.getField("created_by").alias("owner")
    )


def ends(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, source) and (entity, target), distinct."""
    named = rows.filter("entity is not null")
    return named.filter("source is not null").select("entity", "source").distinct(), named.filter("target is not null").select("entity", "target").distinct()


def routed(rows: DataFrame) -> DataFrame:
    """Edges of traced rows: source to entity to target; what an entity both writes and reads points straight at what it made from it, which
    keeps false cycles out; records without an entity are direct."""
    rows = saved(rows.select("source", "target", "entity"), "triples")
    named = rows.filter("entity is not null")
    # what an entity reads and what it writes are told apart in one grouping, which also drops repeats
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("r"), F.lit(0).alias("w")), F.struct(F.col("target").alias("node"), F.lit(0).alias("r"), F.lit(1).alias("w"))))
    at = named.select("entity", ends.alias("e")).select("entity", "e.*").filter("node is not null").groupBy("entity", "node").agg(F.max("r").alias("r"), F.max("w").alias("w"))
    at = saved(at, "ends")
    ended = at.select(F.when(F.col("w") == 1, F.col("entity")).otherwise(F.col("node")).alias("source"), F.when(F.col("w") == 1, F.col("node")).otherwise(F.col("entity")).alias("target"))
    own = at.filter("r = 1 and w = 1").select("entity", F.col("node").alias("source"))
    straight = named.filter("target is not null").join(own, ["entity", "source"], "left_semi").select("source", "target")
    direct = rows.filter("entity is null and source is not null and target is not null").select("source", "target")
    plain = straight.unionByName(direct)
    if rows.filter(graph.is_entity(F.col("source")) | graph.is_entity(F.col("target"))).isEmpty():
        return ended.unionByName(plain.distinct())
    return ended.unionByName(plain).distinct()  # a node is named as an entity: an edge may come from both parts


def scope_graph(rows: DataFrame, tables: DataFrame, catalog: str, schema: str | None = None, node_cap: int = graph.NODE_CAP) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a catalog or schema.

    ``rows`` are ``records``; ``tables`` has table_catalog, table_schema, table_name, table_type. Entities that touch a local table come with all their
    records, from anywhere; what lies outside is a stub. A catalog with over ``node_cap`` tables is refused, a schema is not."""
    local = tables.filter(F.col("table_catalog") == catalog).filter(refs.schema_filter(F.col("table_schema"), schema)).filter(refs.not_internal(F.col("table_name")))
    local = saved(local.select(F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("node"), F.coalesce("table_type", F.lit("TABLE")).alias("kind")).distinct(), "local")
    if schema is None and local.count() > node_cap:
        raise ValueError(f"catalog {catalog} has more than {node_cap} tables; choose a schema")
    here = local.select("node")
    five = ["source", "target", "entity", "source_kind", "target_kind"]
    near = saved(scoped(rows, catalog, schema).select(*five).distinct(), "near")
    touching = [near.filter("entity is not null").join(here.withColumnRenamed("node", end), end, "left_semi").select("entity") for end in ("source", "target")]
    entities = saved(touching[0].unionByName(touching[1]).distinct(), "entities")
    whole = saved(rows.filter("entity is not null").join(entities, "entity", "left_semi").select(*five).distinct(), "whole")
    loose = near.filter("entity is null and source is not null and target is not null").select("source", "target", "source_kind", "target_kind").distinct()
    side = [loose.join(here.withColumnRenamed("node", end), end, "left_semi") for end in ("source", "target")]
    loose = side[0].unionByName(side[1]).distinct()

    reads, writes = ends(whole)
    bare = loose.select("source", "target").distinct()
    covered = graph.moved(bare, reads, writes)
    direct = bare.join(covered, ["source", "target"], "left_anti")
    kept = reads.join(writes.select("entity", F.col("target").alias("source")), ["entity", "source"], "left_anti")
    again = whole.filter("source is not null and target is not null").join(writes.select("entity", F.col("target").alias("source")), ["entity", "source"], "left_semi").select("source", "target")
    edges = kept.select("source", F.col("entity").alias("target")).unionByName(writes.select(F.col("entity").alias("source"), "target")).unionByName(direct).unionByName(again).distinct()
    edges = saved(edges, "edges")

    kinds = [df.select(F.col(end).alias("node"), F.col(f"{end}_kind").alias("kind")) for df in (whole, loose) for end in ("source", "target")]
    outside = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3]).filter("node is not null").groupBy("node").agg(F.max("kind").alias("kind")).join(here, "node", "left_anti")
    stubs = outside.select("node", F.coalesce("kind", F.lit("EXTERNAL_LINEAGE")).alias("kind"), F.lit(True).alias("external"))
    nodes = local.withColumn("external", F.lit(False)).unionByName(stubs)
    counted = nodes.join(graph.degrees(nodes, edges, ready=True), "node").withColumn("name", refs.display_name(F.col("node")))
    return counted.select("node", "name", "kind", "external", "upstream_count", "downstream_count", "lineage_status"), edges


def trace_rows(rows: DataFrame, seed: str, max_hops: int = graph.MAX_HOPS, node_cap: int | None = graph.NODE_CAP) -> tuple[DataFrame, bool]:
    """The distinct records that a table's directional cone is made of, and whether the walk stopped at ``node_cap`` nodes.

    Upstream a hop goes from targets to sources, downstream the other way; each hop is a semi-join of the frontier."""
    pairs = saved(graph.prepared(rows), "pairs")
    truncated = False
    taken = []
    for along, end in ((graph.reversed_edges(pairs), "target"), (pairs, "source")):
        seen = frontier = graph.cut(graph.seed_of(rows, seed))
        for _ in range(max_hops):
            step = along.join(frontier.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node")).distinct()
            frontier, found = graph.hop(step.join(seen, "node", "left_anti"))
            if not found:
                break
            if node_cap is not None and seen.count() >= node_cap:
                truncated = True
                break
            seen = seen.unionByName(frontier)
        taken.append(rows.join(seen.withColumnRenamed("node", end), end, "left_semi"))
    both = taken[0].unionByName(taken[1])
    order = F.struct("event_time", "created_by", "source_kind", "target_kind", "entity_type", "entity_id")
    keys = ["source", "target", "entity"]
    latest = both.groupBy(*keys).agg(F.max(order).alias("r"))
    return latest.select(*keys, "r.event_time", "r.created_by", "r.source_kind", "r.target_kind", "r.entity_type", "r.entity_id"), truncated


def real_edges(rows: DataFrame, catalog: str, schema: str | None = None) -> DataFrame:
    """Distinct (source, target, entity_type, entity_id) of a scope between named tables, without self-loops."""
    near = scoped(rows, catalog, schema).filter("source_table_full_name is not null and target_table_full_name is not null and source_table_full_name != target_table_full_name")
    return near.select(F.col("source_table_full_name").alias("source"), F.col("target_table_full_name").alias("target"), "entity_type", "entity_id").distinct()


def read_after_write(rows: DataFrame) -> DataFrame:
    """(entity, node): what an entity both reads and writes."""
    reads, writes = ends(rows)
    return reads.withColumnRenamed("source", "node").join(writes.withColumnRenamed("target", "node"), ["entity", "node"]).select("entity", "node")
