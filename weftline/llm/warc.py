"""Web archives of Zstandard frames: a leading skippable frame holds the dictionary, each record is one frame.

Writing: each task trains a dictionary on the first records of an archive, then compresses record by record. Spark's
text sink commits the files, so a lost or repeated task leaves neither halves nor doubles; what it puts after each row is an
empty skippable frame, which readers of the format pass over. Reading: each archive is walked frame by frame, one record
in memory at a time, and every header, length and digest is validated.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import new_folder, saved
from weftline.llm.linking import small

#: Fixed values of the format: magic numbers of a frame, of a dictionary frame and of the skippable range.
FRAME, DICTIONARY, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
#: An empty skippable frame; plain ASCII, so it can be a line separator.
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
REVISIT_BYTES = 100
#: A new archive begins beyond so many compressed bytes. The dictionary is trained on the first records of each archive: at most so many of them, so many bytes of each.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES = 32 << 20, 32 << 10, 200, 16 << 10
RECORD = "archive string, record_id string, record_type string, target_uri string, date string, page string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit(b""))


def _record_id(page: object, copy: int) -> str:
    return f"<urn:page:{'none' if page is None else page}:{copy}>"


def record_bytes(page: object, copy: int, url: str | None, body: bytes, digest: str, first: str | None) -> bytes:
    """One record: a response with its payload, or, if ``first`` names a record, a revisit of it that keeps the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if first else http + body
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [f"WARC-Type: {'revisit' if first else 'response'}", f"WARC-Record-ID: {_record_id(page, copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Refers-To: {first}", f"WARC-Profile: {PROFILE}"] if first else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A dictionary trained on a few records; too few to train on are the dictionary themselves."""
    cut = [s[:SAMPLE_BYTES] for s in samples]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, cut, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(cut)[:DICTIONARY_BYTES]


def archive_frames(records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES, sample_records: int = SAMPLE_RECORDS) -> Iterator[tuple[int, bytes]]:
    """(archive number, frame): for each archive the dictionary's frame, then a frame a record."""
    archive, size, held = 0, 0, []
    packer = None

    def begun() -> Iterator[tuple[int, bytes]]:
        nonlocal packer, size
        raw = dictionary_of(held)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
        packed = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(raw)
        frames = [struct.pack("<II", DICTIONARY, len(packed)) + packed, *map(packer.compress, held)]
        size = sum(map(len, frames))
        return ((archive, f) for f in frames)

    for r in records:
        if packer is None:
            held.append(r)
            if len(held) < sample_records and sum(map(len, held)) < sample_records * SAMPLE_BYTES:
                continue
            yield from begun()
        else:
            frame = packer.compress(r)
            size += len(frame)
            yield archive, frame
        if size >= archive_bytes:
            archive, size, held, packer = archive + 1, 0, [], None
    if held and packer is None:
        yield from begun()


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its headers alone; an error if it is cut off."""
    try:
        magic = struct.unpack_from("<I", data, at)[0]
        if magic in SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            if magic != FRAME:
                raise ValueError(f"no Zstandard frame at byte {at}")
            p = zstandard.frame_header_size(data[at : at + 18]) + at
            last = 0
            while not last:
                head = data[p] | data[p + 1] << 8 | data[p + 2] << 16
                last, kind, size = head & 1, head >> 1 & 3, head >> 3
                if kind == 3:
                    raise ValueError(f"a reserved block at byte {p}")
                p += 3 + (1 if kind == 1 else size)
            end = p + 4 * (data[at + 4] >> 2 & 1)
    except (IndexError, struct.error, zstandard.ZstdError) as e:
        raise ValueError(f"the frame at byte {at} is cut off") from e
    if end > len(data):
        raise ValueError(f"the frame at byte {at} is cut off")
    return end


def frames_of(data: memoryview) -> Iterator[bytes]:
    """Decoded records of an archive. The dictionary is that of a leading dictionary frame, itself packed or not; other skippable frames are passed over."""
    unpack, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        end = frame_end(data, at)
        magic = struct.unpack_from("<I", data, at)[0]
        if magic == DICTIONARY and at == 0:
            raw = bytes(data[8:end])
            if raw[:4] == struct.pack("<I", FRAME):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else unpack
        elif magic not in SKIPPABLE:
            obj = unpack.decompressobj()
            out = obj.decompress(data[at:end])
            if not obj.eof or obj.unused_data:
                raise ValueError(f"the frame at byte {at} holds no whole record")
            yield out
        at = end


def _headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#-'*+\-.0-9A-Z^-z|~]+", name):
            raise ValueError(f"a malformed header line: {line[:60]!r}")
        out[name.decode().lower()] = value.strip().decode("utf-8", "surrogateescape")
    return out


def _length(headers: dict[str, str], what: str) -> int:
    if not re.fullmatch("[0-9]+", headers.get("content-length", "")):
        raise ValueError(f"{what} without a length")
    return int(headers["content-length"])


def parse_record(data: bytes) -> tuple:
    """The columns of RECORD after the archive; an error where a header is missing or a length or digest differs from what is there."""
    head, end, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(VERSION) or not end:
        raise ValueError("a record does not begin with a WARC 1.1 header")
    h = _headers(head[len(VERSION) :])
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if not h.get(name):
            raise ValueError(f"a record without {name}")
    size = _length(h, "a record")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {h['warc-record-id']}: its block has {len(rest) - 4} bytes, its header says {size}")
    kind = h["warc-type"]
    if kind not in ("response", "revisit"):
        return (h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], None, rest[:size], size, hashlib.sha256(rest[:size]).hexdigest(), None)
    http, end, body = rest[:size].partition(b"\r\n\r\n")
    status, _, fields = http.partition(b"\r\n")
    if not end or not status.startswith(b"HTTP/"):
        raise ValueError(f"record {h['warc-record-id']}: its block is no HTTP response")
    told = _length(_headers(fields), "an HTTP response")
    algorithm, _, digest = h.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha256" or not re.fullmatch("[0-9a-f]{64}", digest):
        raise ValueError(f"record {h['warc-record-id']}: no SHA-256 digest of its payload")
    if kind == "response" and (len(body) != told or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"record {h['warc-record-id']}: its payload differs from its length or digest")
    if kind == "revisit" and (body or not h.get("warc-refers-to") or h.get("warc-profile") != PROFILE):
        raise ValueError(f"record {h['warc-record-id']}: a revisit has no payload, names a record and states its profile")
    page = re.fullmatch(r"<urn:page:(.*):\d+>", h["warc-record-id"])
    return (h["warc-record-id"], kind, h.get("warc-target-uri"), h["warc-date"], page and page[1], body if kind == "response" else None, told, digest, h.get("warc-refers-to"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, body, digest, first (the page a record revisits, else null), seen_before, copy of every row.

    Equal payloads are found by their SHA-256 digest and length. Only digests, lengths and ids are shuffled; groups of one are left
    out before the join, which is a broadcast if their counted rows (of fixed width) fit."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload(F.col("html")).alias("body"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("body", 256)))
    ids = rows.filter(F.octet_length("body") >= REVISIT_BYTES).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n"))
    groups = saved(ids.groupBy("digest").agg(first.alias("f"), F.sum("n").alias("size")).filter("size > 1").select(F.col("digest").alias("g_digest"), F.col("f.page_id").alias("g_first"), F.col("f.n").alias("g_same")), "groups")
    found = rows.join(small(groups), F.col("digest") == F.col("g_digest"), "left")
    own = F.col("g_digest").isNotNull() & F.col("page_id").eqNullSafe(F.col("g_first"))
    out = found.filter(~(own & (F.col("g_same") > 1))).select("page_id", "url", "body", "digest", F.col("g_first").alias("first"), (F.col("g_digest").isNotNull() & ~own).alias("seen_before"), F.lit(0).alias("copy"))
    if groups.filter("g_same > 1").isEmpty():
        return out
    # rows that repeat the page_id and the payload of a response: of each such set the first (by url) is the response, the rest revisit it
    same = found.filter(own & (F.col("g_same") > 1)).groupBy("digest", "page_id", "g_first", "url").agg(F.min("body").alias("body"), F.count(F.lit(1)).cast("int").alias("n"))
    least = same.groupBy("digest").agg(F.min(F.struct(F.col("url").isNull().alias("none"), "url")).alias("l")).select(F.col("digest").alias("g_digest"), F.col("l.url").alias("g_url"))
    dealt = same.join(least, F.col("digest") == F.col("g_digest")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return out.unionByName(dealt.select("page_id", "url", "body", "digest", F.col("g_first").alias("first"), (~(F.col("url").eqNullSafe(F.col("g_url")) & (F.col("copy") == 0))).alias("seen_before"), "copy"))


def write_archives(pages: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, sample_records: int = SAMPLE_RECORDS) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to archives in ``folder``, which must not exist.

    A null html is an empty payload, a null url an empty target. Payloads of REVISIT_BYTES and more are written once, with the smallest
    page_id (null ids last); the rest revisit it. Of repeated rows one is the response. An archive begins anew beyond ``archive_bytes``.
    An empty table leaves a folder without archives. Other columns, of any names, are ignored."""
    rows = with_revisits(pages)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for page, url, body, digest, first, seen, copy in zip(*(b.column(i) for i in range(7)), strict=True):
                yield record_bytes(page.as_py(), copy.as_py(), url.as_py(), body.as_py(), digest.as_py().hex(), _record_id(first.as_py(), 0) if seen.as_py() else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for k, (archive, frame) in enumerate(archive_frames(records(batches), archive_bytes, sample_records)):
            held.append((archive, k, frame))
            n += len(frame)
            if n > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["archive", "at", "frame"])
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["archive", "at", "frame"])

    frames = rows.mapInArrow(run, "archive int, at long, frame binary").sortWithinPartitions("archive", "at")
    frames.select("archive", F.col("frame").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", EMPTY_FRAME.decode("ascii")).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in ``folder`` (see RECORD), validated; the first fault ends the job with an error that names the archive.

    A revisit's payload is null, its length and digest are those of the full payload. Records of other types have their block as payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("page", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                out, size = [], 0
                try:
                    for data in frames_of(memoryview(content.as_buffer()).cast("B")):
                        out.append((path.as_py(), *parse_record(data)))
                        size += len(data)
                        if size > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                            out, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{path.as_py()}: {e}") from e
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").mapInArrow(run, RECORD)


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every row, as read back from archives written of it.

    See ``write_archives`` for nulls, repeated and extra columns; an empty table gives no rows."""
    spark = pages.sparkSession
    folder = new_folder(spark, "archives")
    write_archives(pages, folder)

    def page_of(ident: Column) -> Column:
        return F.regexp_extract(ident, "^<urn:page:(.*):[0-9]+>$", 1).try_cast("bigint")

    return read_archives(spark, folder).select(page_of(F.col("record_id")).alias("page_id"), F.col("target_uri").alias("url"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
