"""Shared helpers: durable intermediate tables, text normalisation, word hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it: space and 0x09-0x0D.
WHITE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is unset in local mode
    (tests on one machine), a temporary folder that is then set as the checkpoint folder. On a cluster the setting is required."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has already ended; the folder's owner cleans it
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage with replicated files instead of executor-local blocks, so a lost executor costs
    nothing, and it gives the planner the table's true size for its choice of joins."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, *keys: Column) -> DataFrame:
    """``docs`` as one struct column ``row_`` beside its keys ``k0_``, ``k1_`` and so on, so that no name of an input column can clash in a join."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row_"), *(k.alias(f"k{i}_") for i, k in enumerate(keys)))


def named_keys(keys: DataFrame) -> DataFrame:
    """The columns of ``keys`` as ``g0_``, ``g1_`` and so on, to be joined to ``keyed`` rows."""
    return keys.toDF(*(f"g{i}_" for i in range(len(keys.columns))))


def same_keys(rows: DataFrame, keys: DataFrame) -> Column:
    """Whether the keys of ``keyed`` rows and of ``named_keys`` agree, nulls with nulls."""
    out = F.lit(True)
    for i in range(len(keys.columns)):
        out = out & rows[f"k{i}_"].eqNullSafe(keys[f"g{i}_"])
    return out


def squeezed(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


# --- vectorised hashing -------------------------------------------------------------------------

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64, for at least n positions."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_R, _RINV)):
            out = np.full(size, base, _U)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[k] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are not ASCII white space."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_IS_WHITE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``: a polynomial over the bytes, from one running sum."""
    power, inverse = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word (run of non-white characters) of a whole text, in order."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    start, end = word_spans(data)
    return span_hashes(data, start, end) if len(start) else np.zeros(0, _U)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = words[:m].copy()
    for k in range(1, n):
        out *= _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
        out += words[k : k + m]
    return mix(out)
