"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of a label are one class first, so large groups of copies never meet pairwise. The number of sign bits follows
the number of classes, and the number of tables follows from the bits and the target recall. Vectors that share a
bucket are compared exactly; buckets over a limit are split into blocks whose pairs all meet. Number of links is counted
inside the components, where all links lie by definition, again in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import saved
from weftline.llm.linking import connected_components, in_blocks, mapped_groups, pair_mask, stars

LEAST_COSINE, TARGET_RECALL, SEED = 0.93, 0.99999, 20240229
BUCKET_ROWS, BLOCK_ROWS = 32, 1024


def plan_tables(n: int, least: float, recall: float) -> tuple[int, int]:
    """(bits, tables): about BUCKET_ROWS vectors a bucket if they were spread evenly; enough tables that a pair at ``least`` is missed with probability 1 - recall at most."""
    bits = max(4, round(math.log2(max(1, n) / BUCKET_ROWS)))
    together = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _unit(table: pa.Table) -> np.ndarray:
    dims = table.column("dim")[0].as_py()
    x = _scaled(np.frombuffer(b"".join(table.column("vector").to_pylist()), "<f8").reshape(-1, dims))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over their largest component, so that squares neither overflow nor vanish."""
    return x / np.abs(x).max(axis=1)[:, None]


def embedding_dedup(vectors: DataFrame, *, least: float = LEAST_COSINE, recall: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors are compared only under equal, non-null labels and with equal dimensions. A vector that is null, empty or
    zero, or has a null or non-finite component, links with nothing: no links, its own component, kept. A row with a null vec_id links with nothing and is
    not kept. Repeated rows link with one another. Other columns are ignored; an empty table gives no rows.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").alias("label"))
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    usable = F.coalesce(whole, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # plus 0.0, -0.0 is 0.0: a grouping key has it so, and the bytes that rows are joined by must be the same
    rows = saved(v.withColumn("e", F.when(usable, F.transform("e", lambda x: x + F.lit(0.0)))), "vectors")
    good = rows.filter("e is not null")
    kinds = good.groupBy("label", "e").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    kind = good.schema["label"].dataType.simpleString()

    def pack(batches):  # noqa: ANN001, ANN202
        for b in batches:
            e = [np.array(x, "<f8") for x in b.column("e").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("copies"), pa.array([len(x) for x in e], pa.int32()), pa.array([x.tobytes() for x in e], pa.binary())], ["id", "label", "copies", "dim", "vector"])

    # an id that stands for two different vectors (a repeated vec_id) would mix them, so classes get ids of their own
    classes = saved(kinds.mapInArrow(pack, f"id long, label {kind}, copies long, dim int, vector binary").withColumn("cls", F.monotonically_increasing_id()), "classes")
    bits, tables = plan_tables(classes.count(), least, recall)

    def hash_tables(batches):  # noqa: ANN001, ANN202
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits, dtype=np.int64))
        for b in batches:
            dims = np.array(b.column("dim").to_pylist())
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, tables * bits))
                own = np.flatnonzero(dims == d)
                part = b.take(pa.array(own))
                x = _scaled(np.frombuffer(b"".join(part.column("vector").to_pylist()), "<f8").reshape(-1, d))
                sign = (x @ planes[d] > 0).reshape(len(own), tables, bits)
                codes = (sign * weights).sum(axis=2)
                rep = np.repeat(np.arange(len(own)), tables)
                wide = part.take(pa.array(rep))
                yield pa.RecordBatch.from_arrays([wide.column("cls"), wide.column("label"), wide.column("dim"), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(codes.ravel())], ["cls", "label", "dim", "t", "code"])

    keyed = classes.mapInArrow(hash_tables, f"cls long, label {kind}, dim int, t int, code long").select("cls", F.xxhash64("label", "dim", "t", "code").alias("bucket"))
    keyed = saved(keyed, "buckets")
    shared = keyed.groupBy("bucket").count().filter("count > 1").select("bucket")
    meeting = saved(keyed.join(shared, "bucket", "left_semi"), "meeting")
    payload = classes.select("cls", "dim", "vector")

    def links_of(table: pa.Table) -> list[tuple]:
        ids = table.column("cls").to_numpy()
        u = _unit(table)
        mask = pair_mask(table.column("block").to_numpy(), table.column("alone").to_numpy())
        return stars(ids, (u @ u.T >= least) & mask)

    found = mapped_groups(in_blocks(meeting, "bucket", "cls", BLOCK_ROWS).join(payload, "cls").select("g", "cls", "block", "alone", "dim", "vector"), "g", links_of, "a long, b long")
    component = saved(connected_components(found), "components")

    def count_of(table: pa.Table) -> list[tuple]:
        ids, copies = table.column("cls").to_numpy(), table.column("copies").to_numpy()
        u = _unit(table)
        mask = pair_mask(table.column("block").to_numpy(), table.column("alone").to_numpy())
        n = ((u @ u.T >= least) & mask) @ copies
        return list(zip(ids.tolist(), n.tolist(), strict=True))

    members = component.withColumnRenamed("id", "cls").join(classes.select("cls", "copies", "dim", "vector"), "cls")
    counted = mapped_groups(in_blocks(members, "component", "cls", BLOCK_ROWS).select("g", "cls", "copies", "block", "alone", "dim", "vector"), "g", count_of, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))

    # back to rows: the smallest vec_id of a component's classes
    named = classes.select("cls", "id", "copies").join(component.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least_id = named.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = saved(classes.select("cls", "label", "vector", "copies").join(named.select("cls", "component"), "cls").join(least_id, "component").join(counted, "cls", "left").select("label", "vector", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0).cast("long"))).alias("n_links")), "linked")

    def pack_rows(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([None if x is None else np.array(x, "<f8").tobytes() for x in b.column("e").to_pylist()], pa.binary())], ["vec_id", "label", "vector"])

    keyed_rows = rows.mapInArrow(pack_rows, f"vec_id long, label {kind}, vector binary").withColumn("k", F.xxhash64("label", "vector"))
    linked = linked.withColumn("k", F.xxhash64("label", "vector")).withColumnsRenamed({"label": "_label", "vector": "_vector"})
    joined = keyed_rows.join(linked, (keyed_rows["k"] == linked["k"]) & (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    own = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
