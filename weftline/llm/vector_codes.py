"""Vector codes by product quantisation, with Lloyd rounds that keep heaps of bounds.

Vectors become integers and lie in blocks, a few megabytes in one row. Beside each part stands its entry and a key: the slack
between the distance to the next-best entry and that to its own, plus the drift of the entry when it was measured. In a
round each block builds a heap per entry over these keys and pops only the parts whose key is no longer above the
entry's cumulative drift; these are measured against all entries again, the rest provably keep theirs. A round's table holds
the blocks' new state and the changes of the entries' sums, so that only sums of changed parts are added up.

Distances are exact integers; bounds are doubles with a margin on the safe side, so the codes are those of plain Lloyd rounds.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import saved
from weftline.llm.linking import small

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bytes of the vectors of one block, as 64-bit integers.
BLOCK_BYTES = 4 << 20


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as array<long>; null for a null vector and one with a null or non-finite component."""
    e = vector.cast("array<double>")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(e, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def bound_of(dim: int, spare_bits: int = 2) -> int:
    """The largest magnitude of components for which sums of ``dim`` products, times 2**spare_bits, fit a long."""
    return 1 << max(1, (62 - spare_bits - max(0, math.ceil(math.log2(max(1, dim))))) // 2)


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, bound: int) -> np.ndarray:
    """A list column as an integer matrix: short vectors are filled with zeros, components beyond the bound become the bound."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(lists), dim), np.int64)
    flat = np.asarray(lists.flatten(), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.clip(out, -bound, bound)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries: by doubles while every sum stays below 2**53, else by integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def measured(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties to the lower index) and its slack: distance of the next entry less that of its own, a little less than exact."""
    d = squared(x, entries)
    at = d.argmin(axis=1)
    own = d[np.arange(len(x)), at].astype(float)
    if len(entries) == 1:
        return at, np.full(len(x), np.inf)
    d[np.arange(len(x)), at] = np.iinfo(np.int64).max
    return at, np.sqrt(d.min(axis=1).astype(float)) * (1 - 1e-12) - np.sqrt(own) * (1 + 1e-12)


def violated(at: np.ndarray, key: np.ndarray, drift: np.ndarray) -> list[int]:
    """Positions of a block whose key does not exceed their entry's drift, popped from one heap per entry."""
    heaps: dict[int, list[tuple[float, int]]] = {}
    for i, (a, k) in enumerate(zip(at.tolist(), key.tolist(), strict=True)):
        heaps.setdefault(a, []).append((k, i))
    out = []
    for a, heap in heaps.items():
        heapq.heapify(heap)
        limit = float(drift[a]) * (1 + 1e-12) + 1e-9
        while heap and heap[0][0] <= limit:
            out.append(heapq.heappop(heap)[1])
    return out


def sums_of(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Per entry the sums of its rows' components, then their number."""
    out = np.zeros((n, x.shape[1] + 1), np.int64)
    np.add.at(out, at, np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1))
    return out


def assigned(blocks: DataFrame, books: np.ndarray, drift: np.ndarray, first: bool) -> DataFrame:
    """One assignment of all blocks to ``books`` (part, entry, component): new state, and per block the changes of the sums."""
    parts, n, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state, keys, moved = [], [], []
            for i in range(b.num_rows):
                x = np.frombuffer(b.column("data")[i].as_py(), "<i8").reshape(-1, parts, width)
                at = np.zeros((parts, len(x)), np.uint16) if first else np.frombuffer(b.column("at")[i].as_py(), "<u2").reshape(parts, -1).copy()
                key = np.zeros((parts, len(x))) if first else np.frombuffer(b.column("key")[i].as_py(), "<f8").reshape(parts, -1).copy()
                change = np.zeros((parts, n, width + 1), np.int64)
                for p in range(parts):
                    again = np.arange(len(x)) if first else np.array(violated(at[p], key[p], drift[p]), np.int64)
                    if len(again):
                        own = x[again, p]
                        new, slack = measured(own, books[p])
                        before = at[p, again].astype(np.int64)
                        other = np.ones(len(again), bool) if first else new != before
                        change[p] += sums_of(own[other], new[other], n)
                        if not first:
                            change[p] -= sums_of(own[other], before[other], n)
                        at[p, again], key[p, again] = new, slack + drift[p][new]
                state.append(at.tobytes())
                keys.append(key.tobytes())
                moved.append(change.tobytes() if change.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("ids"), b.column("labels"), b.column("data"), pa.array(state, pa.binary()), pa.array(keys, pa.binary()), pa.array(moved, pa.binary())], ["ids", "labels", "data", "at", "key", "moved"])

    kind = blocks.schema["labels"].dataType.simpleString()
    return saved(blocks.mapInArrow(run, f"ids array<bigint>, labels {kind}, data binary, at binary, key binary, moved binary"), "codes")


def total_change(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The changes of all blocks added up: in each task first, then by part and entry; the sums of a codebook have a fixed size."""
    parts, n, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, np.int64)
        for b in batches:
            for m in b.column("moved"):
                out += np.frombuffer(m.as_py(), "<i8").reshape(shape)
        flat = out.reshape(parts * n, width)
        some = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some].tolist(), pa.list_(pa.int64()))], ["entry", "sums"])

    cells = blocks.filter("moved is not null").select("moved").mapInArrow(run, "entry long, sums array<long>").select("entry", F.posexplode("sums").alias("k", "v"))
    out = np.zeros((parts * n, width), np.int64)
    for e, k, v in cells.groupBy("entry", "k").agg(F.sum("v").alias("v")).collect():
        out[e, k] = v
    return out.reshape(shape)


def vector_codes(vectors: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 of every row whose vector has only finite components.

    Vectors shorter than the longest, and a length that the parts do not divide, are filled with zeros; an empty vector is all zeros.
    Integer components beyond ``bound_of`` the length (over 10**8 at 64 components) become that bound, so that errors fit a long. Entries begin with
    the smallest vec_ids (null ids last, ties by vector); with fewer rows there are fewer entries. Repeated rows count each.
    An empty table gives no rows. Other columns, of any names, are ignored."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), integers(F.col("embedding"), scale).alias("e")).filter("e is not null")
    dim = rows.agg(F.max(F.size("e"))).first()[0] or 0
    width = max(1, math.ceil(dim / parts))
    bound = bound_of(width * parts)
    dim = width * parts
    kind = vectors.schema["label"].dataType.simpleString()
    begin = rows.orderBy(F.col("vec_id").asc_nulls_last(), "e").limit(entries).select("e").collect()
    if not begin:
        empty = vectors.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string")
        return empty
    books = matrix(pa.array([r[0] for r in begin], pa.list_(pa.int64())), dim, bound).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    per = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, per):
                b = whole.slice(at, per)
                one = pa.array([0, b.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(one, pa.concat_arrays([b.column(c)])) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([matrix(b.column("e"), dim, bound).tobytes()], pa.binary())], ["ids", "labels", "data"])

    blocks = saved(rows.mapInArrow(pack, f"ids array<bigint>, labels array<{kind}>, data binary"), "blocks")
    drift, sums = np.zeros(books.shape[:2]), np.zeros((parts, books.shape[1], width + 1), np.int64)
    for k in range(rounds):
        blocks = assigned(blocks, books, drift, k == 0)
        sums += total_change(blocks, sums.shape)
        used, before = sums[:, :, -1] > 0, books.copy()
        books[used] = sums[:, :, :-1][used] // sums[:, :, -1:][used]
        step = np.sqrt(((books - before).astype(float) ** 2).sum(axis=2)) * (1 + 1e-12)
        drift = drift + step + most_of_others(step)
    blocks = assigned(blocks, books, drift, rounds == 0)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b.column("data")[i].as_py(), "<i8").reshape(-1, parts, width)
                at = np.frombuffer(b.column("at")[i].as_py(), "<u2").reshape(parts, -1)
                error = sum(((x[:, p] - books[p][at[p]]) ** 2).sum(axis=1) for p in range(parts))
                codes = ["".join(f"{c:02x}" for c in row) for row in at.T.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, b.column("labels")[i].values, pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = blocks.select("ids", "labels", "data", "at").mapInArrow(unpack, f"vec_id long, label {kind}, code string, error long")
    return saved(coded, "coded").withColumn("codebooks_sha256", F.lit(digest))


def most_of_others(step: np.ndarray) -> np.ndarray:
    """For each entry of each part the largest step of any other entry."""
    if step.shape[1] == 1:
        return np.zeros_like(step)
    order = np.sort(step, axis=1)
    return np.where((step == order[:, -1:]) & (order[:, -2:-1] < order[:, -1:]), order[:, -2:-1], order[:, -1:])


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``vector_codes`` with label_error: the errors summed over equal labels, nulls together. Sums are made before anything is joined."""
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "sums")
    return coded.join(small(sums), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
