"""Suffix-array deduplication of byte strings by induced sorting.

Every window of 400 bytes has a minimizer, the 240-byte piece with the smallest hash in it; equal windows have equal minimizers at equal
places. Only minimizers that occur at two places can lie in a repeated window. The bytes around each such place go to the shard of
its minimizer, where all of its occurrences meet; equal surroundings are counted by their hash first, and one of each is moved. A shard
sorts all suffixes of its bytes by induced sorting: suffixes are classified, the leftmost-smaller substrings are sorted and
named, the string of names is sorted recursively on pairs of names, and two linear passes induce the array. Permuted
common prefixes, computed on irreducible positions and carried forward over the rest, give the windows that occur at two places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import _power_table, mix, saved
from weftline.llm.linking import in_blocks, mapped_groups, small
from weftline.llm.recompression import bytes_of, within
from weftline.llm.repeats import merged_ranges, pack, repeated_anchors, top_key, unpack

WINDOW, GRAM = 400, 240
#: Surroundings that are compared in one task, bytes of a shard, and parts by the place of the window that the surroundings of a common minimizer are cut into.
BLOCK_ROWS, SHARD_BYTES, PARTS = 2048, 1 << 20, 4
CHUNK = 1 << 23
_U = np.uint64


# --- minimizers ---------------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, from running minima of blocks of w."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, _U)
    padded[:n] = x
    square = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def minimizers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the minimizers of all windows; the leftmost of equal hashes."""
    places, hashes = [], []
    span = WINDOW - GRAM + 1
    for at in range(0, max(1, len(data) - WINDOW + 1), CHUNK):
        part = data[at : at + CHUNK + WINDOW - 1]
        if len(part) < WINDOW:
            continue
        power, inverse = _power_table(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * power[: len(part)], out=total[1:])
        h = mix((total[GRAM:] - total[:-GRAM]) * inverse[: len(part) - GRAM + 1])
        low = _U((1 << 24) - 1)
        least = _sliding_min((h & ~low) | np.arange(len(h), dtype=_U), span)
        where = np.unique((least & low).astype(np.int64))
        places.append(where + at)
        hashes.append(h[where])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    where, first = np.unique(np.concatenate(places), return_index=True)
    return where, np.concatenate(hashes)[first]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def anchors(text: str) -> np.ndarray:
    return minimizers(_bytes(text))[1]


# --- suffix array of one shard ------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts one place later; the end counts as smallest."""
    n = len(s)
    change = np.flatnonzero(np.append(s[1:] != s[:-1], True))  # last place of each run
    nxt = np.append(s.astype(np.int64), -1)[change + 1]
    smaller = s[change] < nxt
    return np.repeat(smaller, np.diff(np.append(-1, change)))[:n]


def _induce(s: np.ndarray, small_type: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost-smaller suffixes ``lms``.

    Buckets are filled in waves: all suffixes that a run of finished entries induces are placed at once, in order."""
    n = len(s)
    sa = np.full(n, -1, np.int32)  # a shard is far below 2**31 bytes
    ends = np.cumsum(size)
    starts = ends - size
    # larger suffixes, from left to right
    head = starts.copy()
    lms_char = s[lms]
    order = np.argsort(lms_char, kind="stable")
    by_char = lms[order]
    lms_cut = np.searchsorted(lms_char[order], np.arange(len(size) + 1))

    def place(sources: np.ndarray) -> None:
        before = sources[sources > 0] - 1
        before = before[~small_type[before]]
        if len(before):
            c = s[before]
            o = np.argsort(c, kind="stable")
            c, before = c[o], before[o]
            times = np.bincount(c, minlength=len(size))
            rank = np.arange(len(c), dtype=np.int64) - np.repeat(np.cumsum(times) - times, times)
            sa[head[c] + rank] = before
            head[:] += times

    if not small_type[n - 1]:
        sa[head[s[n - 1]]] = n - 1  # the last suffix is induced by the end
        head[s[n - 1]] += 1
    for c in np.flatnonzero(size).tolist():
        done = starts[c]
        while done < head[c]:
            upto = head[c]
            place(sa[done:upto])
            done = upto
        place(by_char[lms_cut[c] : lms_cut[c + 1]])
    # smaller suffixes, from right to left
    tail = ends.copy()

    def place_back(sources: np.ndarray) -> None:
        before = sources[sources > 0] - 1
        before = before[small_type[before]]
        if len(before):
            c = s[before]
            o = np.argsort(c, kind="stable")
            c, before = c[o], before[o]
            times = np.bincount(c, minlength=len(size))
            rank = np.arange(len(c), dtype=np.int64) - np.repeat(np.cumsum(times) - times, times)
            sa[tail[c] - 1 - rank] = before
            tail[:] -= times

    for c in np.flatnonzero(size)[::-1].tolist():
        done = ends[c]
        while done > tail[c]:
            upto = tail[c]
            place_back(sa[upto:done][::-1])
            done = upto
        place_back(sa[starts[c] : head[c]][::-1])
    return sa


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a string of names, by names of pairs of names, recursively, until all differ; positions in groups of one are left out of later rounds."""
    n = len(names)
    rank = names.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    new = np.concatenate([[True], r[1:] != r[:-1]])
    first = np.flatnonzero(new)
    rank[order] = first[np.cumsum(new) - 1]
    step = 1
    unsure = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(unsure):
        after = np.where(unsure + step < n, rank[np.minimum(unsure + step, n - 1)] + 1, 0)
        key = rank[unsure] * (n + 1) + after
        o = np.argsort(key, kind="stable")
        k, u = key[o], unsure[o]
        group = rank[u]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(u))
        group_at = np.maximum.accumulate(np.where(fresh, at, 0))
        key_at = np.maximum.accumulate(np.where(new, at, 0))
        rank[u] = group + key_at - group_at
        alone = np.concatenate([new[1:], [True]]) & new
        unsure = u[~alone]
        step *= 2
    return rank


def _differ(s: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether the substrings from ``a`` and from ``b`` to their ``stop`` differ; all their symbols are compared. One that runs into the end differs from any other."""
    size = stop[a] - a
    out = (size != stop[b] - b) | (stop[a] > len(s)) | (stop[b] > len(s))
    live, k = np.flatnonzero(~out), 0
    while len(live):
        other = s[a[live] + k] != s[b[live] + k]
        out[live[other]] = True
        k += 1
        live = live[~other & (size[live] > k)]
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers by induced sorting; the end of the string sorts first."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.uint8 if int(s.max()) < 256 else np.int64)  # bytes are sorted by radix
    small_type = _types(s)
    size = np.bincount(s)
    lms = np.flatnonzero(small_type[1:] & ~small_type[:-1]) + 1
    if len(lms) > 1:
        rough = _induce(s, small_type, lms, size)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_substring = rough[is_lms[rough]]
        stop = np.zeros(n, np.int64)
        stop[lms] = np.append(lms[1:] + 1, n + 1)  # the last one runs into the end, which no other does
        name = np.zeros(n, np.int32)
        name[by_substring] = np.cumsum(np.concatenate([[False], _differ(s, by_substring[:-1], by_substring[1:], stop)]))
        del rough, is_lms, stop
        names = name[lms]
        lms = lms[np.argsort(_sort_names(names))] if names.max() + 1 < len(lms) else by_substring
    return _induce(s, small_type, lms, size)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position of zero-separated strings the length, up to the next separator, that it shares with the suffix before it in the array.

    A position whose predecessor in text agrees with its neighbour's, and is no separator, is reducible: it shares one less than the position before. Only
    the others are compared, eight bytes at a time."""
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    has = phi >= 0
    ahead = np.zeros(n, bool)
    i = np.flatnonzero(phi > 0)
    i = i[i > 0]
    ahead[i] = (s[i - 1] == s[phi[i] - 1]) & (s[i - 1] != 0)
    direct = np.flatnonzero(has & ~ahead)
    padded = np.concatenate([s.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1))
    length = np.zeros(len(direct), np.int64)
    live = np.arange(len(direct))
    while len(live):
        a = words[direct[live] + length[live]]
        same = (a == words[phi[direct[live]] + length[live]]) & (a != 0)
        run = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        length[live] += run
        live = live[run == 8]
    out = np.full(n, -1, np.int32)
    out[direct] = length + direct
    # carried forward: the value plus the position is the same until the next compared position
    mark = np.zeros(n, np.int32)
    stops = np.flatnonzero(~has | ~ahead)
    mark[stops] = stops
    np.maximum.accumulate(mark, out=mark)
    return np.where(has, np.maximum(out[mark] - np.arange(n, dtype=np.int32), 0), 0)


def repeated_windows(parts: list[np.ndarray], times: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each byte string the starts of its windows that occur at two places.

    ``times`` says at how many places a string as a whole occurs, ``place`` numbers the first (so that the same place in two overlapping
    strings counts once)."""
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size + 1) - size - 1
    s = np.zeros(int((size + 1).sum()), np.uint8)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), size + 1)
    # bytes move up by one to make room for the separator; UTF-8 has no byte 255
    for b, p in zip(begin.tolist(), parts, strict=True):
        s[b : b + len(p)] = p + np.uint8(1)
    sa = suffix_array(s)
    shared = permuted_prefixes(s, sa)
    inside = np.arange(len(s), dtype=np.int32) + WINDOW <= (begin + size).astype(np.int32)[owner]
    joined = (shared >= WINDOW) & inside
    joined_sa = joined[sa]
    group = np.cumsum(~joined_sa, dtype=np.int32)
    member = inside[sa]
    pos = sa[member]
    g = group[member]
    o = owner[pos]
    here = place[o] + pos - begin[o]
    lo = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    hi = np.full(int(group[-1]) + 1, np.iinfo(np.int64).min)
    many = np.zeros(int(group[-1]) + 1, bool)
    np.minimum.at(lo, g, here)
    np.maximum.at(hi, g, here)
    many[g[times[o] > 1]] = True
    good = np.zeros(len(s), bool)
    good[pos[(many | (lo != hi))[g]]] = True
    return [np.flatnonzero(good[b : b + n]) for b, n in zip(begin.tolist(), size.tolist(), strict=True)]


# --- the operator -------------------------------------------------------------------------------


def pieces_of(data: np.ndarray | bytes, at: int, size: int, crowded: bool) -> list[tuple[int, int, int]]:
    """(offset, length, hash of the bytes that bind it) of the pieces of the surroundings ``data[at:at + size]`` of a minimizer.

    One piece as a rule. Of a crowded minimizer the windows are told apart by where they begin: the windows of a piece share the bytes between the
    last begin and the first end, so that only surroundings with these bytes in common are compared."""
    import xxhash

    if not crowded or size <= WINDOW:
        return [(0, size, 0)]
    step = -(-(size - WINDOW + 1) // PARTS)
    out = []
    for first in range(0, size - WINDOW + 1, step):
        last = min(first + step, size - WINDOW + 1) - 1
        out.append((first, last + WINDOW - first, xxhash.xxh3_64_intdigest(data[at + last : at + first + WINDOW]) - (1 << 63)))
    return out


def repeated_bytes(texts: DataFrame) -> DataFrame:
    """(rk, starts, ends): the packed byte ranges to remove, for those of the distinct ``texts`` (rk, text) that lose bytes."""
    known = saved(repeated_anchors(texts, anchors, text_bytes=bytes_of(texts), across_documents=False), "known")
    some = texts.join(small(known.select("rk")), "rk", "left_semi").join(known, "rk")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for rk, text, blob in zip(b.column("rk").to_pylist(), b.column("text"), b.column("anchors"), strict=True):
                out: list[tuple] = []
                data = _bytes(text.as_py())
                at, h = minimizers(data)
                keep = np.isin(top_key(h), unpack(blob.as_py()))
                for p, key in zip(at[keep].tolist(), h[keep].view(np.int64).tolist(), strict=True):
                    lo, hi = max(0, p + GRAM - WINDOW), min(len(data), p + WINDOW)
                    if hi - lo >= WINDOW:
                        out.append((key, xxhash.xxh3_64_intdigest(data[lo:hi]) - (1 << 63), rk, lo, hi - lo))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "same", "rk", "at", "size"])

    regions = saved(some.select("rk", "text", "anchors").mapInArrow(around, "key long, same long, rk long, at long, size long"), "regions")
    merged = regions.groupBy("key", "same").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("rk", "at", "size")).alias("first"))
    merged = saved(merged.select("key", "same", "times", "first.rk", "first.at", "first.size"), "merged")
    company = saved(merged.groupBy("key").agg(F.count(F.lit(1)).alias("strings"), F.sum("times").alias("places")).filter("places > 1"), "company")
    # a minimizer with one distinct surrounding (equal by two independent hashes of 64 bits) needs no sorting: it is repeated as a whole
    alone = merged.join(company.filter("strings = 1").select("key"), "key", "left_semi").select("key", "same", F.lit(0).cast("long").alias("a"), F.col("size").alias("z"))
    mixed = saved(merged.join(company.filter("strings > 1").select("key", (F.col("strings") > BLOCK_ROWS).alias("crowded")), "key"), "mixed")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for rk, text, wanted in zip(b.column("rk").to_pylist(), b.column("text"), b.column("wanted"), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for w in wanted:
                    key, same, times, at, size, crowded = (x.as_py() for x in w.values())
                    for shift, length, bound in pieces_of(data, at, size, crowded):
                        out.append((key, same, bound, times, rk, at + shift, shift, data[at + shift : at + shift + length]))
                    if len(out) > 4000:
                        yield _region_batch(out)
                        out = []
            if out:
                yield _region_batch(out)

    # the bytes of one of each distinct surroundings; a document's are bounded by its length
    wanted = mixed.groupBy("rk").agg(F.collect_list(F.struct("key", "same", "times", "at", "size", "crowded")).alias("wanted"))
    holders = texts.join(small(saved(mixed.select("rk").distinct(), "holders")), "rk", "left_semi").select("rk", "text")
    parts = holders.join(wanted, "rk").mapInArrow(cut_out, "key long, same long, bound long, times long, rk long, at long, shift long, part binary")
    parts = saved(parts.withColumn("of", F.xxhash64("key", "bound")), "parts")
    blocked = in_blocks(parts, "of", "same", BLOCK_ROWS, sizes_of=parts.select("of"))
    total = in_blocks(parts.select("of", "same", F.length("part").alias("size")), "of", "same", BLOCK_ROWS).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, int(total // SHARD_BYTES))

    def sort_shard(table: pa.Table) -> list[tuple]:
        key, same, shift = (table.column(c).to_pylist() for c in ("key", "same", "shift"))
        strings = [np.frombuffer(x, np.uint8) for x in table.column("part").to_pylist()]
        # a place is a row and an offset in it: rows are numbered far apart
        _, number = np.unique(table.column("rk").to_numpy(), return_inverse=True)
        place = number.astype(np.int64) * (1 << 40) + table.column("at").to_numpy()
        found = repeated_windows(strings, table.column("times").to_numpy(), place)
        out = []
        for k, s, d, w in zip(key, same, shift, found, strict=True):
            a, z = merged_ranges(w + d, w + d + WINDOW)
            out += [(k, s, int(x), int(y)) for x, y in zip(a.tolist(), z.tolist(), strict=True)]
        return out

    sorted_ = mapped_groups(blocked.withColumn("shard", F.pmod("g", F.lit(shards))), "shard", sort_shard, "key long, same long, a long, z long")
    # surroundings have 560 bytes at most, so any two windows in one overlap: what pieces and blocks found is one range, joined once a place
    spans = saved(alone.unionByName(sorted_).groupBy("key", "same").agg(F.min("a").alias("a"), F.max("z").alias("z")), "spans")
    placed = regions.select("key", "same", "rk", "at").join(spans, ["key", "same"]).select("rk", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("z")).alias("z"))

    def unite(table: pa.Table) -> list[tuple]:
        a, z = merged_ranges(table.column("a").to_numpy(), table.column("z").to_numpy())
        return [(int(table.column("rk")[0].as_py()), pack(a.astype(_U)), pack(z.astype(_U)))]

    return mapped_groups(placed, "rk", unite, "rk long, starts binary, ends binary")


def _region_batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], ["key", "same", "bound", "times", "rk", "at", "shift", "part"])


def row_hash(text: Column) -> Column:
    """The long that stands for a text as long as no other text has it too."""
    return F.xxhash64(text)


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with rk, a long that stands for the text, and (_rk) of the texts that several rows have.

    Texts that share a hash are told apart by 60 bits of their SHA-256: where several digests meet in one hash, the digest gives the number."""
    digest = F.conv(F.substring(F.sha2("text", 256), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("rk", row_hash(F.col("text")))

    def copies(of: DataFrame) -> DataFrame:
        several = of.withColumn("digest", digest).groupBy("rk").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        return saved(several.filter("n > 1").select(F.col("rk").alias("_rk"), (F.col("lo") != F.col("hi")).alias("clash")), "copies")

    found = copies(rows)
    clash = found.filter("clash").select("_rk")
    if not clash.isEmpty():
        rows = rows.join(small(clash), F.col("rk") == F.col("_rk"), "left")
        rows = rows.withColumn("rk", F.when(F.col("_rk").isNull(), F.col("rk")).otherwise(F.xxhash64(digest))).drop("_rk")
        found = copies(rows)
    return rows, found.select("_rk")


def with_kept_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row.

    A byte is removed if a string of 400 bytes that covers it also starts at another place of any text, the same one included; overlaps
    count, and strings are judged on the input. Matches never cross texts. Null texts are empty. Rows with equal texts remove each other
    whole (from 400 bytes), and one of them stands for all when other texts are compared. A null doc_id takes part like any other. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, twice = told_apart(rows)
    several = small(twice)
    one = rows.join(several, F.col("rk") == F.col("_rk"), "left_anti").select("rk", "text")
    repeats = rows.join(several, F.col("rk") == F.col("_rk"), "left_semi").groupBy("rk").agg(F.first("text").alias("text"))
    gone = saved(repeated_bytes(one.unionByName(repeats).filter(F.octet_length("text") >= WINDOW)), "removals")
    gone = within(gone).withColumnRenamed("rk", "_gone")
    marked = rows.join(several, F.col("rk") == F.col("_rk"), "left").withColumn("whole", F.col("_rk").isNotNull())
    joined = marked.join(gone, F.col("rk") == F.col("_gone"), "left").select("doc_id", "text", "whole", "starts", "ends")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, spans, kept = [], [], [], []
            for text, whole, starts, ends in zip(b.column("text"), b.column("whole").to_pylist(), b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                n.append(len(data))
                a = z = np.zeros(0, np.int64)
                if whole and len(data) >= WINDOW:
                    a, z = np.array([0]), np.array([len(data)])
                elif starts is not None:
                    a, z = unpack(starts).astype(np.int64), unpack(ends).astype(np.int64)
                m.append(int((z - a).sum()))
                spans.append(len(a))
                kept.append(b"".join(data[lo:hi] for lo, hi in zip([0, *z.tolist()], [*a.tolist(), len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, m, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
