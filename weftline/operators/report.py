"""The sheets of a lineage workbook, as DataFrames, and small service statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import is_entity
from weftline.plans.durable import saved


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: tables, orphans, entities, edges. ``nodes`` has node and lineage_status (null for entities)."""
    a = nodes.agg(F.count_if(~is_entity(F.col("node"))).alias("tables"), F.count_if(F.col("lineage_status") == "orphan").alias("orphans"), F.count_if(is_entity(F.col("node"))).alias("entities")).withColumn("_", F.lit(1))
    return a.join(edges.select("source", "target").distinct().agg(F.count(F.lit(1)).alias("edges")).withColumn("_", F.lit(1)), "_").drop("_")


def schema_of(node: F.Column) -> F.Column:
    parts = F.split(node, "[.]")
    return F.when(F.size(parts) >= 3, F.concat_ws(".", parts[0], parts[1])).otherwise("(other)")


def by_schema(nodes: DataFrame) -> DataFrame:
    """(schema, tables, orphans), the largest first."""
    t = nodes.filter(~is_entity(F.col("node")))
    return t.groupBy(schema_of(F.col("node")).alias("schema")).agg(F.count(F.lit(1)).alias("tables"), F.count_if(F.col("lineage_status") == "orphan").alias("orphans")).orderBy(F.desc("tables"), "schema")


def tables_sheet(nodes: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Thirteen columns a table, by full name."""
    from weftline.sources.metadata import full_name

    about = tables.select(full_name().alias("node"), "table_owner", "comment", "created", "last_altered")
    n = columns.groupBy(full_name().alias("node")).agg(F.count(F.lit(1)).alias("column_count"))
    parts = F.split("node", "[.]")
    out = nodes.filter(~is_entity(F.col("node"))).join(about, "node", "left").join(n, "node", "left").na.fill(0, ["column_count"])
    return out.select(
        F.col("node").alias("full_name"), parts[0].alias("catalog"), F.get(parts, F.lit(1)).alias("schema"), F.substring_index("node", ".", -1).alias("table_name"), F.col("kind").alias("table_type"), F.col("table_owner").alias("owner"),
        "comment", "column_count", "upstream_count", "downstream_count", "lineage_status", F.col("created").alias("created_at"), F.col("last_altered").alias("updated_at"),
    ).orderBy("full_name")


def lineage_sheet(real_edges: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target, via): real table pairs with the entity that moved the data."""
    label = F.coalesce("name", F.when(F.col("entity_type").isNotNull(), F.concat_ws(" ", "entity_type", "entity_id")), F.lit("direct"))
    return real_edges.join(names.select("entity_type", "entity_id", "name"), ["entity_type", "entity_id"], "left").select("source", "target", label.alias("via")).distinct().orderBy("source", "target", "via")


def client_lineage_sheet(edges: DataFrame, catalog: str, schema: str | None = None) -> DataFrame:
    """(source, target): the Lineage sheet of a client without the server's records: entities are collapsed, so each of their sources stands with each of their targets; pairs that touch the scope."""
    from weftline.operators.graph import table_view

    prefix = f"{catalog}.{schema}." if schema else f"{catalog}."
    return table_view(edges, prefix).orderBy("source", "target")


def pipelines_sheet(entities: DataFrame, names: DataFrame, cost: DataFrame) -> DataFrame:
    """(entity_type, name, entity_id, last_run, owner, cost_usd)."""
    keys = ["entity_type", "entity_id"]
    out = entities.select(*keys, "last_run", "owner").join(names.select(*keys, "name"), keys, "left").join(cost.select(*keys, "cost_usd"), keys, "left")
    return out.select("entity_type", F.coalesce("name", "entity_id").alias("name"), "entity_id", "last_run", "owner", "cost_usd").orderBy("entity_type", "name", "entity_id")


def column_sheet(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_table_full_name").alias("source_table"), F.col("source_column_name").alias("source_column"), F.col("target_table_full_name").alias("target_table"), F.col("target_column_name").alias("target_column")).distinct().orderBy("source_table", "source_column", "target_table", "target_column")


def schema_maps(nodes: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """(schema, node): the map of each of the largest schemas with edges: its tables, their neighbours, and the neighbours of entities among them."""
    own = nodes.filter(~is_entity(F.col("node"))).select(schema_of(F.col("node")).alias("schema"), "node")
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("near")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("near"))).distinct()
    both = saved(both, "both")
    linked = saved(own.join(both.select("node").distinct(), "node", "left_semi"), "linked")
    size = linked.groupBy("schema").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "schema").limit(limit)
    # a node's schemas are bits of words, so that a neighbour of many tables of a schema is one row and an entity meets its neighbours once, not once a schema
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "schema")) - 1  # at most ``limit`` rows
    ranked = saved(size.select("schema", F.floor(place / 63).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 63).cast("int")).alias("bits")), "ranked")
    merged = lambda df: df.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
    known = merged(linked.join(ranked, "schema").select("node", "word", "bits"))
    near = saved(merged(known.join(both, "node").select(F.col("near").alias("node"), "word", "bits")), "near")
    through = near.filter(is_entity(F.col("node"))).join(both, "node").select(F.col("near").alias("node"), "word", "bits")
    shown = merged(known.unionByName(near).unionByName(through))
    return shown.join(ranked.withColumnRenamed("bits", "bit"), "word").filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("schema", "node")


def workbook(nodes: DataFrame, edges: DataFrame, *, tables: DataFrame, columns: DataFrame, real_edges: DataFrame, entities: DataFrame, names: DataFrame, cost: DataFrame, column_edges: DataFrame) -> dict[str, DataFrame]:
    """All sheets by name."""
    return {
        "Summary": summary(nodes, edges), "By schema": by_schema(nodes), "Tables": tables_sheet(nodes, tables, columns), "Lineage": lineage_sheet(real_edges, names),
        "Pipelines": pipelines_sheet(entities, names, cost), "Column Lineage": column_sheet(column_edges), "Maps": schema_maps(nodes, edges),
    }


def write_workbook(sheets: dict[str, DataFrame], folder: str) -> None:
    """Each sheet as CSV with a header under the folder, so that any spreadsheet opens it."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name.lower().replace(' ', '_')}")


def percentiles(values: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(share, value): nearest rank, the value at floor(n * share) of the sorted values. Exact: sorted ranges are counted first, so that no task sorts all rows."""
    v = values.select(F.col(column).alias("value")).filter("value is not null")
    counts = v.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    bounds = F.floor(F.log2(F.abs("value") + 1) * F.signum("value") * 64)  # in order of the values
    binned = counts.withColumn("bin", bounds)
    before = binned.groupBy("bin").agg(F.sum("n").alias("in_bin"))
    total = Window.partitionBy(F.lit(1))
    before = before.withColumn("below", F.sum("in_bin").over(total.orderBy("bin")) - F.col("in_bin")).withColumn("all", F.sum("in_bin").over(total))
    ranks = before.select("bin", "below", "in_bin", "all", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("rank", F.least(F.floor(F.col("all") * F.col("share")), F.col("all") - 1)).filter("rank >= below and rank < below + in_bin")
    upto = F.sum("n").over(Window.partitionBy("share").orderBy("value"))
    found = binned.join(F.broadcast(ranks), "bin").withColumn("upto", F.col("below") + upto).filter("rank < upto and rank >= upto - n")  # ranks: one row a share
    return found.select("share", "value")


def service_latency(requests: DataFrame, at: str, ident: str, value: str, *, now: str | None = None, last: int = 1000, seconds: int = 60) -> DataFrame:
    """One row about the ``last`` newest requests (ties by ``ident``): p50, p95, p99 of their values by nearest rank, sample_count, and rate_per_min, how many of them began less
    than ``seconds`` before ``now`` (the newest request's time, if it is not given). Requests without a value count for the rate alone; without requests all are 0."""
    newest = requests.select(at, ident, value).orderBy(F.desc(at), F.desc(ident)).limit(last)
    end = F.max(at).over(Window.partitionBy(F.lit(1))) if now is None else F.lit(now).cast("timestamp")  # at most ``last`` rows
    timed = newest.select(value, (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))).alias("age"))
    one = timed.agg(F.array_sort(F.collect_list(value)).alias("v"), F.count_if(F.col("age") < seconds * 1_000_000).alias("rate_per_min"))
    rank = lambda share: F.coalesce(F.get("v", F.floor(F.size("v") * F.lit(share)).cast("int")), F.lit(0.0))
    return one.select(rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.size("v").cast("long").alias("sample_count"), "rate_per_min")


def inventory(entries: DataFrame, now: float, ttl: float, limit: int = 15) -> DataFrame:
    """The largest cache entries (key, size, stored_at) with the seconds that they have left."""
    return entries.withColumn("ttl_remaining", F.greatest(F.lit(0.0), F.lit(ttl) - (F.lit(now) - F.col("stored_at")))).orderBy(F.desc("size"), "key").limit(limit)


def parse_metrics(parsed: DataFrame) -> DataFrame:
    """Counts per artifact of arrays of mappings, table references and warnings."""
    return parsed.select("artifact_id", "language", "statements_parsed", "statements_skipped", F.size("column_mappings").alias("mapping_count"), F.size("table_references").alias("table_ref_count"), F.concat_ws("; ", "warnings").alias("warnings"))
