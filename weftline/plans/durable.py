"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, where that is unset in local mode (tests on one machine), a temporary folder that is then set as the checkpoint folder.

    On a cluster a folder of one machine would lose rows, so there the setting is required."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans it
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def saved(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; with ``by`` in a folder for each value of these columns, of which filters read only what they ask for.

    The files survive lost executors, and the planner knows the table's true size when it chooses joins."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_with_count(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``saved`` and the number of rows, counted while they are written."""
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get.get("n", 0)


def size_of(df: DataFrame) -> int:
    """Bytes of the files that a saved table is read from."""
    spark, total = df.sparkSession, 0
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        total += p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return total
