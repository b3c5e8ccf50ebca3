"""Building blocks for similarity joins: bounded groups, connected components, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import saved

#: Rows of (long) ids that may be broadcast; tables beyond it are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast if its counted rows fit; otherwise as it is, for a shuffled join. Meant for saved tables of a few longs."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def mapped_groups(rows: DataFrame, key: str, work: Callable[[pa.Table], list[tuple]], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each value of the long column ``key``.

    Like applyInPandas, but a task streams through its sorted partition and so pays no call into Spark per group. Groups
    must be bounded (see ``in_blocks``); ``work`` returns rows for ``schema``."""
    out_schema = rows.sparkSession.createDataFrame([], schema).schema
    names = out_schema.names
    types = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()] for f in out_schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(key).to_numpy()
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            if held and held[-1].column(key)[-1].as_py() != int(g[0]):
                cuts = np.concatenate([[0], cuts])
            out: list[tuple] = []
            before = 0
            for c in cuts.tolist():
                parts = [*held, b.slice(before, c - before)] if c > before else held
                held = []
                out += work(pa.Table.from_batches(parts))
                before = c
            held.append(b.slice(before))
            yield emit(out)
        if held:
            yield emit(work(pa.Table.from_batches(held)))

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def in_blocks(rows: DataFrame, key: str, ident: str, limit: int, sizes_of: DataFrame | None = None) -> DataFrame:
    """Split groups over ``limit`` rows so that every pair of rows of a group still meets.

    Adds ``g``, the new group, and ``block``. A group of n rows is dealt into b = ceil(n / limit) blocks, and each pair of blocks
    is a group of about 2 * limit rows; a row goes to b of them. Pairs inside one block are to be compared only in the
    group that has that block alone (``alone``). ``sizes_of`` is a lighter table with the same keys to count, if there is one."""
    sizes = saved((rows if sizes_of is None else sizes_of).groupBy(key).count().filter(F.col("count") > limit).select(F.col(key).alias("_k"), F.ceil(F.col("count") / limit).cast("int").alias("_b")), "sizes")
    b = F.coalesce("_b", F.lit(1))
    dealt = rows.join(small(sizes), F.col(key) == F.col("_k"), "left").withColumn("_n", b).withColumn("block", F.pmod(F.xxhash64(ident), "_n").cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumn("g", F.xxhash64(key, F.least("block", "_o"), F.greatest("block", "_o"))).withColumn("alone", (F.col("block") == F.col("_o")).cast("int")).drop("_k", "_b", "_n", "_o")


def pair_mask(block: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Which pairs of a group of ``in_blocks`` are its own: all in a group of one block, else those across its two blocks."""
    if alone.all():
        mask = np.ones((len(block), len(block)), bool)
        np.fill_diagonal(mask, False)
        return mask
    return block[:, None] != block[None, :]


def stars(ids: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """From a boolean matrix of links: an edge from each linked row to the smallest id of its component."""
    n = len(ids)
    label = ids.copy()
    while True:
        around = np.where(links, label[None, :], np.iinfo(np.int64).max).min(axis=1) if n else label
        new = np.minimum(label, around)
        if (new == label).all():
            break
        label = new
    return [(int(a), int(b)) for a, b in zip(ids, label, strict=True) if a != b]


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id in an edge (a, b).

    Alternating large and small stars; each round is a few aggregations and joins over the edges, written to the shared
    folder, until a round changes nothing. Nothing is collected but a count and a checksum."""
    now = saved(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        after = saved(linked.select("a", F.col("m").alias("b")).unionByName(linked.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        seen = mark(after)
        now = after
        if seen == before:
            break
        before = seen
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
