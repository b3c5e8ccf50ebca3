"""Incremental ingestion of lineage events (beyond the lineage queries themselves).

New event files become rows of an event table and keep a table of distinct edges up to date, with exactly-once effect through the
stream's checkpoint and batch numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from weftline.operators import scope


def lineage_stream(spark: SparkSession, folder: str, schema: object, *, late: str = "7 days", files_per_batch: int = 64) -> DataFrame:
    """Records of newly arriving event files; repeats of an event within the allowed lateness are dropped and their state expires with the watermark."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    rows = scope.records(events)
    key = ["source", "target", "entity", "event_time"]
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark(key)


def run_windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, entity_type, events): activity per window of event time, final once the watermark has passed it."""
    counted = events.withWatermark("event_time", late).groupBy(F.window("event_time", every), F.coalesce("entity_type", F.lit("NONE")).alias("entity_type")).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("window.start").alias("start"), "entity_type", "events")


def start_edge_upsert(records: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep ``target`` (Parquet, one folder per batch) as the edges first seen in each batch; ``read_edges`` merges them."""

    def merge(batch: DataFrame, number: int) -> None:
        edges = batch.filter("source is not null and target is not null").groupBy("source", "target").agg(F.max("event_time").alias("last_seen"), F.count(F.lit(1)).alias("events"))
        edges.write.mode("overwrite").parquet(f"{target}/batch={number}")  # a batch that is repeated replaces itself

    return records.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def read_edges(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).groupBy("source", "target").agg(F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"))
