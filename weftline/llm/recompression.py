"""Substring deduplication by recompression.

A document is a sequence of word symbols. In each round every left symbol directly before a right one (a bit of its name decides the side) becomes one
new symbol, named by its parts; a run of one symbol stays a row of equal symbols. Names are thereby global without any table: equal word
sequences get equal interior symbols wherever they stand.
Whether two symbols are apart after r rounds depends on the 2**(r-1) words on either side alone; after three rounds, and with
symbols of at most six words, each window of 13 words has a border whose eight words around it lie in the window and are named alike in all its copies.
A first Spark round over all documents finds the shared high-level names, those of the eight words around borders that occur in two documents. A second one names
the windows around them from these and further symbols, finds the smallest doc_id of each, and removes words by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import mix, saved, word_hashes
from weftline.llm.linking import mapped_groups, small
from weftline.llm.repeats import merged_ranges, pack, range_bits, repeated_anchors, top_key, unpack

WINDOW = 13
#: Fixed by the window: rounds, words on either side of a border that decide about it, and the longest symbol.
ROUNDS, SIDE, LONGEST = 3, 4, 6
#: Windows that a task gathers before it sends them.
BATCH_WINDOWS = 400_000
#: Bytes of removals that may be broadcast to the texts; beyond it they are joined by shuffle.
BROADCAST_BYTES = 32 << 20
_U = np.uint64


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0xD6E8FEB86659FD93) + b)


def borders(words: np.ndarray) -> np.ndarray:
    """Positions where symbols begin after the rounds.

    A symbol never pairs with its equal, so a run stays a row of equal symbols, each of which begins one: what a run's own name would hide from windows
    that begin inside it."""
    name, at = words, np.arange(len(words))
    size = np.ones(len(words), np.int64)
    for r in range(ROUNDS):
        right = (name >> _U(8 + r)) & _U(1) == 1
        first = np.flatnonzero(~right[:-1] & right[1:] & (size[:-1] + size[1:] <= LONGEST))
        name, size = name.copy(), size.copy()
        name[first] = _pairs(name[first], name[first + 1])
        size[first] += size[first + 1]
        keep = np.ones(len(name), bool)
        keep[first + 1] = False
        name, at, size = name[keep], at[keep], size[keep]
    return at


def grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all runs of 8 and of 13 words, doubled up from shorter ones."""
    two = _pairs(words[:-1], words[1:])
    four = _pairs(two[:-2], two[2:])
    eight = _pairs(four[:-4], four[4:])
    n = len(words) - WINDOW + 1
    return eight, _pairs(_pairs(eight[:n], four[8 : 8 + n]), words[12 : 12 + n])


def _inner_borders(words: np.ndarray) -> np.ndarray:
    at = borders(words)
    return at[(at >= SIDE) & (at + SIDE <= len(words))]


def anchors(text: str) -> np.ndarray:
    """Names of the eight words around each border, for texts that have a window."""
    words = word_hashes(text)
    if len(words) < WINDOW:
        return words[:0]
    return grams(words)[0][_inner_borders(words) - SIDE]


def candidate_windows(text: str, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, name, second name) of the windows around borders whose eight words are ``known`` to occur in two documents; the second name is
    made of the first and last words by other factors, so that two names of 64 bits tell windows apart."""
    words = word_hashes(text)
    at = _inner_borders(words)
    eight, whole = grams(words)
    at = at[np.isin(top_key(eight[at - SIDE]), known)]
    open_ = np.zeros(len(words) + 1, np.int64)
    np.add.at(open_, np.clip(at + SIDE - WINDOW, 0, len(whole)), 1)
    np.add.at(open_, np.clip(at - SIDE + 1, 0, len(whole)), -1)
    start = np.flatnonzero(np.cumsum(open_)[: len(whole)] > 0)
    second = mix(eight[start + WINDOW - 8] * _U(0xC2B2AE3D27D4EB4F) ^ eight[start])
    return start, whole[start], second


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and rk, a hash of both, so that rows with one doc_id but different texts stay apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("rk", F.xxhash64("doc_id", "text"))


def within(found: DataFrame) -> DataFrame:
    """``found`` (saved, one row per document, with packed starts) marked for broadcast if its bytes are few enough, else as it is."""
    total = found.agg(F.coalesce(F.sum(2 * F.length("starts") + 64), F.lit(0))).first()[0]
    return F.broadcast(found) if total <= BROADCAST_BYTES else found


def bytes_of(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def earlier_copies(rows: DataFrame) -> DataFrame:
    """(same, first): digests of texts that several doc_ids have, and the smallest of these; ``rows`` has doc_id and same."""
    return saved(rows.filter("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("same", "first"), "copies")


def removals(rows: DataFrame) -> DataFrame:
    """(rk, starts, ends): the packed word ranges to remove, for the documents (doc_id, text, rk) that lose any.

    Of the windows of a batch with one name all but those of its smallest doc_id are lost whatever other batches have, so only the latter go on to
    the range of their name: a passage that a third of all documents share costs a range no more than a document a batch. A range answers each batch
    in one row, whatever documents it names, and a batch's answers, bounded by its windows, are sorted out into documents in one place."""
    size = bytes_of(rows)
    known = saved(repeated_anchors(rows, anchors, text_bytes=size, across_documents=True), "known")
    some = rows.join(small(known.select("rk")), "rk", "left_semi").join(known, "rk")
    bits = range_bits(size)
    names = ["part", "batch", "name", "second", "doc", "start"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal count, number
            sizes = [len(x[2]) for x in held]
            rk, doc = (np.repeat(np.array([x[k] for x in held], "<i8"), sizes) for k in (0, 1))
            start, name, second = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
            held.clear()
            count = 0
            order = np.lexsort((doc, second, name))
            name, second, rk, doc, start = (x[order] for x in (name, second, rk, doc, start.astype("<i4")))
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (second[1:] != second[:-1])])
            lost = doc > doc[new][np.cumsum(new) - 1]
            out = [(-1, number, None, None, *_packed(rk[lost], start[lost]))] if lost.any() else []
            name, second, rk, doc, start = (x[~lost] for x in (name, second, rk, doc, start))
            part = (name >> _U(64 - bits)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                out.append((int(part[a]), number, pack(name[a:z]), _column(second[a:z]), _column(np.stack([rk[a:z], doc[a:z]], 1)), _column(start[a:z])))
            number += 1
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

        for b in batches:
            for rk, doc, text, blob in zip(b.column("rk").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), b.column("anchors"), strict=True):
                start, name, second = candidate_windows(text.as_py(), unpack(blob.as_py()))
                if len(start):
                    held.append((rk, doc, start, name, second))
                    count += len(start)
                    if count >= BATCH_WINDOWS:
                        yield flush()
        if held:
            yield flush()

    sent = saved(some.select("rk", "doc_id", "text", "anchors").mapInArrow(send, "part long, batch long, name binary, second binary, doc binary, start binary"), "windows")

    def judge(table: pa.Table) -> list[tuple]:
        lists = [[f(x) for x in table.column(c).to_pylist()] for c, f in (("name", unpack), ("second", lambda x: _uncolumn(x, "<u8").ravel()), ("doc", lambda x: _uncolumn(x, "<i8")), ("start", lambda x: _uncolumn(x, "<i4").ravel()))]
        origin = np.repeat(table.column("batch").to_numpy(), [len(x) for x in lists[0]])
        name, second, row, start = (np.concatenate(x) for x in lists)
        order = np.lexsort((row[:, 1], second, name))
        name, second, row, start, origin = name[order], second[order], row[order], start[order], origin[order]
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (second[1:] != second[:-1])])
        lost = row[:, 1] > row[new, 1][np.cumsum(new) - 1]
        rk, start, origin = row[lost, 0], start[lost], origin[lost]
        order = np.argsort(origin, kind="stable")
        rk, start, origin = rk[order], start[order], origin[order]
        return [(int(origin[a]), *_packed(rk[a:z], start[a:z])) for a, z in _stretches(origin)]

    def unite(table: pa.Table) -> list[tuple]:
        rk, start = (np.concatenate([_uncolumn(x, kind).ravel() for x in table.column(c).to_pylist()]) for c, kind in (("rks", "<i8"), ("starts", "<i4")))
        order = np.lexsort((start, rk))
        rk, start = rk[order], start[order].astype(np.int64)
        out = []
        for a, z in _stretches(rk):
            lo, hi = merged_ranges(start[a:z], start[a:z] + WINDOW)
            out.append((int(rk[a]), pack(lo.astype(_U)), pack(hi.astype(_U))))
        return out

    judged = mapped_groups(sent.filter("part >= 0"), "part", judge, "batch long, rks binary, starts binary")
    answers = judged.unionByName(sent.filter("part = -1").select("batch", F.col("doc").alias("rks"), F.col("start").alias("starts")))
    # a row that repeats with its doc_id may stand in several batches, each with the same answer
    return mapped_groups(answers, "batch", unite, "rk long, starts binary, ends binary").dropDuplicates(["rk"])


def _stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of equal values."""
    cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])).tolist() if len(x) else []
    return list(zip(cut[:-1], cut[1:], strict=True))


def _packed(rk: np.ndarray, start: np.ndarray) -> tuple[bytes, bytes]:
    """Rows and starts, sorted and compressed."""
    order = np.lexsort((start, rk))
    return _column(rk[order].astype("<i8")), _column(start[order].astype("<i4"))


def _column(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes() + len(x).to_bytes(8, "little"))


def _uncolumn(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[-8:], "little")
    return np.ascontiguousarray(np.frombuffer(data[:-8], np.uint8).reshape(-1, n).T).view(kind)


def with_kept_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row.

    A word is removed if a window of 13 words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. Null texts have no words. A row with a null doc_id loses nothing and takes nothing from others; rows with one
    doc_id take nothing from each other. Texts of fewer than 13 words stay whole. Other columns are ignored; an empty table gives no rows.
    A text that repeats under a larger doc_id loses all its windows and is not looked at further.
    """
    rows = identified(docs).withColumn("same", F.md5("text"))
    copies = small(earlier_copies(rows.select("doc_id", "same")))
    marked = rows.join(copies, "same", "left").withColumn("whole", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    gone = saved(removals(marked.filter("doc_id is not null and not whole").select("doc_id", "text", "rk")), "removals")
    joined = marked.join(within(gone), "rk", "left").select("doc_id", "text", "whole", "starts", "ends")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, kept = [], [], []
            for text, whole, starts, ends in zip(b.column("text"), b.column("whole").to_pylist(), b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if whole and len(words) >= WINDOW:
                    words = []
                elif starts is not None and not whole:
                    left = [0, *unpack(ends).tolist()]
                    words = [w for lo, hi in zip(left, [*unpack(starts).tolist(), len(words)], strict=True) for w in words[lo:hi]]
                m.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept binary")
