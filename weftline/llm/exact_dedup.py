"""Exact deduplication as a stateful stream.

Rows arrive as (digest, document id, locator). A streaming aggregation without a watermark keeps, per digest, the
smallest document id with its locator and the number of rows, in RocksDB on the executors' disks, checkpointed to
the shared folder; state never expires. Spark combines the rows of a digest before they are shuffled, so a digest
that a third of all rows share costs its task no more than one row per input partition. Digests that are hit more
than once are then checked on the full bytes of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import keyed, named_keys, new_folder, same_keys, saved, squeezed
from weftline.llm.linking import small

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # many small stores: no preallocated log files, and commits upload changes only
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
FILES_PER_BATCH = 256


def digest(text: Column) -> Column:
    return F.sha2(squeezed(text.cast("string")), 256)


def with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_sha256", digest(F.col("text")))


def arrival_log(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, locator) of every row, written once; the locator numbers the rows of the log."""
    return saved(with_digest(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "text_sha256", F.monotonically_increasing_id().alias("locator")), "arrivals")


def first_seen(arrivals: DataFrame) -> DataFrame:
    """The keyed state of a (streaming or static) table of arrivals: per digest the first row by doc_id (nulls last, then locator) and the count."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator")
    return arrivals.groupBy("text_sha256").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))


def stream_states(spark: SparkSession, source: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Run the stream over the files in ``source`` until none is left; returns the last state of each digest."""
    schema = spark.read.parquet(source).schema
    updates, state = new_folder(spark, "updates"), new_folder(spark, "state")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

        query = first_seen(arrivals).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept_schema = first_seen(spark.read.schema(schema).parquet(source)).schema
    try:
        found = spark.read.schema(kept_schema).parquet(updates)
    except Exception as e:  # an empty source runs no batch and so writes no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], kept_schema)
    # a digest's count only grows and its first row only moves forward, so these are the last values
    return found.groupBy("text_sha256").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator.

    Texts are equal when they are identical after each run of ASCII white space became one space; a null text counts
    as empty, and all empty texts are one group. The row with the smallest doc_id stays; null doc_ids come last, and
    among repeated rows with one doc_id exactly one stays. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    log = arrival_log(docs)
    states = stream_states(spark, log.inputFiles()[0].rpartition("/")[0] if log.inputFiles() else _empty(spark, log))
    groups = saved(states.filter("group_size > 1").select("text_sha256", "first", "group_size"), "groups")

    # full bytes of all hits, found by half of their digest; Spark combines equal texts before the shuffle
    hit = small(groups.select(F.xxhash64("text_sha256").alias("hit")))
    bytes_of = with_digest(docs.select("text")).join(hit, F.xxhash64("text_sha256") == F.col("hit"), "left_semi").select("text_sha256", squeezed(F.col("text")).alias("bytes"))
    differing = bytes_of.groupBy("text_sha256", "bytes").count().groupBy("text_sha256").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    clash = [r[0] for r in differing.limit(1).collect()]
    if clash:
        raise ValueError(f"two texts share the SHA-256 digest {clash[0]}")

    row = F.coalesce(F.col("first.locator"), F.col("locator"))
    return log.join(groups, "text_sha256", "left").select(
        "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (row == F.col("locator")).alias("kept"), "text_sha256", "locator",
    )


def _empty(spark: SparkSession, log: DataFrame) -> str:
    path = new_folder(spark, "none")
    spark.createDataFrame([], log.schema).write.parquet(path)
    return path


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns, which may have any names.

    Null texts are empty texts and one group; of rows with one doc_id and one text one stays. An empty table stays empty."""
    result = saved(exact_dedup(docs), "decided")
    gone = saved(result.filter("not kept").select("doc_id", "text_sha256").distinct(), "gone")
    twice = named_keys(gone)
    first = keyed(result.filter("kept").select("doc_id", "text_sha256"), F.col("doc_id"), F.col("text_sha256"))
    spare = named_keys(saved(first.join(twice, same_keys(first, twice), "left_semi").select("k0_", "k1_"), "spare"))
    own = keyed(docs, docs["doc_id"].cast("long"), digest(docs["text"]))
    gone = small(twice)
    kept = own.join(gone, same_keys(own, gone), "left_anti").select("row_.*")
    # ids that occur twice with one text: one of the repeated rows stays
    spare = small(spare)
    again = own.join(spare, same_keys(own, spare), "left_semi").groupBy("k0_", "k1_").agg(F.first("row_").alias("row_"))
    return kept.unionByName(again.select("row_.*"))
