"""Which anchors of a corpus occur more than once: a distributed lookup over compact sorted blobs.

An anchor is a hash of a short piece of a document, chosen by content alone, so that equal passages choose equal anchors.
Tasks send anchors as sorted, compressed blobs by ranges of the hash, each range is
merged in one task, whose size is set by the bytes of all texts, and only the anchors that occur again are sent back to their documents. Plain rows
(a name and a document each) were measured too: they take three times the shuffle and over twice the disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import saved
from weftline.llm.linking import mapped_groups

#: Bits of an anchor and of a document's number in its batch, together one 64-bit word.
KEY_BITS, DOC_BITS = 44, 20
#: Bytes of text whose anchors make a range, and anchors that a task gathers before it sends them.
RANGE_BYTES, BATCH_ANCHORS = 12 << 20, 500_000


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte plane by byte plane, compressed."""
    steps = np.diff(values.astype("<u8"), prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def range_bits(text_bytes: int) -> int:
    """Bits of the hash that number a range, so that a range has the anchors of about RANGE_BYTES of text. A batch sends a blob for each range that it has anchors for, one an anchor at most."""
    return max(3, (max(1, text_bytes) // RANGE_BYTES).bit_length())


def repeated_anchors(texts: DataFrame, anchors: Callable[[str], np.ndarray], *, text_bytes: int, across_documents: bool) -> DataFrame:
    """(rk, anchors) for documents with anchors that occur again; ``anchors`` is a packed blob of KEY_BITS values.

    ``texts`` has rk (a long that stands for the row) and text. ``anchors`` gives a text's anchor hashes (64 bits; the top KEY_BITS serve). With ``across_documents`` an anchor must
    occur in two rows with different rk; otherwise two places of one text suffice."""
    bits = range_bits(text_bytes)
    low = np.uint64((1 << DOC_BITS) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        keys: list[np.ndarray] = []
        rks: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            values = np.concatenate([(k & ~low) | np.uint64(i) for i, k in enumerate(keys)])
            values = np.unique(values) if across_documents else np.sort(values)
            part = (values >> np.uint64(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            rows = [(int(part[a]), number, pack(values[a:z])) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            rows.append((-1, number, np.array(rks, "<i8").tobytes()))
            number, held = number + 1, 0
            keys.clear()
            rks.clear()
            p, b, x = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(b, pa.int64()), pa.array(x, pa.binary())], ["part", "batch", "blob"])

        for b in batches:
            for rk, text in zip(b.column("rk").to_pylist(), b.column("text"), strict=True):
                found = anchors(text.as_py() or "")
                if len(found):
                    keys.append(found)
                    rks.append(rk)
                    held += len(found)
                    if held >= BATCH_ANCHORS or len(rks) >= 1 << DOC_BITS:
                        yield flush()
        if keys:
            yield flush()

    sent = saved(texts.select("rk", "text").mapInArrow(send, "part long, batch long, blob binary"), "anchors")

    def merge(table: pa.Table) -> list[tuple]:
        lists = [unpack(x) for x in table.column("blob").to_pylist()]
        begin = np.cumsum([0, *(len(x) for x in lists)])
        values = np.concatenate(lists)
        key = values >> np.uint64(DOC_BITS)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        times = np.diff(np.append(np.flatnonzero(new), len(key)))
        again = np.zeros(len(values), bool)
        again[order] = (times > 1)[np.cumsum(new) - 1]
        batch = table.column("batch").to_pylist()
        picked = (x[again[a:z]] for x, a, z in zip(lists, begin[:-1].tolist(), begin[1:].tolist(), strict=True))
        return [(b, pack(x)) for b, x in zip(batch, picked, strict=True) if len(x)]

    answers = saved(mapped_groups(sent.filter("part >= 0"), "part", merge, "batch long, blob binary"), "answers")
    both = answers.select("batch", "blob", F.lit(0).alias("names")).unionByName(sent.filter("part = -1").select("batch", "blob", F.lit(1).alias("names")))

    def to_documents(table: pa.Table) -> list[tuple]:
        names, blobs = table.column("names").to_pylist(), table.column("blob").to_pylist()
        values = [unpack(x) for x, n in zip(blobs, names, strict=True) if not n]
        if not values:
            return []
        rks = np.frombuffer(next(x for x, n in zip(blobs, names, strict=True) if n), "<i8")
        v = np.concatenate(values)
        doc = (v & low).astype(np.int64)
        order = np.argsort(doc, kind="stable")
        doc, key = doc[order], (v >> np.uint64(DOC_BITS))[order]
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        return [(int(rks[doc[a]]), pack(np.unique(key[a:b]))) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    return mapped_groups(both, "batch", to_documents, "rk long, anchors binary")


def top_key(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def merged_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
