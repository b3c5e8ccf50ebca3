"""Archives by round trips, vector codes and hard negatives against plain loops."""

import hashlib
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from weftline.llm import hard_negatives, queries, vector_codes, warc

CLASHES = "page_id long, url string, html string, digest string, copy string, g_first long"


def _want(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for body, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, x))
        digest = hashlib.sha256(body).hexdigest()
        out += [(i, len(body), digest, "revisit" if k and len(body) >= 100 else "response", ids[0] if k and len(body) >= 100 else None) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def test_archived_pages(spark):
    long = "é" * 60
    rows = [(1, "http://a.b/x y", long), (2, None, long), (3, "http://c", "e" * 99), (4, "http://c", "e" * 99), (5, "u", None), (6, "u", ""), (7, "http://d/" + "p" * 3000, "<p>" * 200_000), (9, "u", "f" * 100), (8, "v", "f" * 100)]
    rows += [(20, "a", "g" * 300), (20, "a", "g" * 300), (20, "b", "g" * 300), (21, "a", "g" * 300), (None, "n", "h" * 200), (None, None, "h" * 200), (None, "n", long)]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], CLASHES).repartition(3)
    got = sorted((tuple(r) for r in warc.archived_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == _want(rows)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_archives_keep_payloads(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, f"http://h{i % 7}.org/{i}", "".join(chr(97 + c) for c in rng.integers(0, 26, 400))) for i in range(150)]
    folder = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), folder, archive_bytes=4000, sample_records=20)
    got = warc.read_archives(spark, folder).collect()
    assert {(int(r["page"]), r["target_uri"], bytes(r["payload"]).decode()) for r in got} == set(rows)
    assert len({r["archive"] for r in got}) > 6
    files = sorted((tmp_path / "a").rglob("part-*"))
    for f in files:
        assert struct.unpack("<I", f.read_bytes()[:4])[0] == warc.DICTIONARY
    broken = files[0].read_bytes()
    (tmp_path / "b").mkdir()
    for cut in (broken[:-3], broken[: len(broken) // 2], b"x" + broken):
        (tmp_path / "b" / "part-0").write_bytes(cut)
        with pytest.raises(Exception, match="frame"):
            warc.read_archives(spark, str(tmp_path / "b")).collect()


def test_records_are_validated():
    digest = hashlib.sha256(b"body").hexdigest()
    good = warc.record_bytes(5, 0, "http://a", b"body", digest, None)
    assert warc.parse_record(good)[1:] == ("response", "http://a", warc.DATE, "5", b"body", 4, digest, None)
    revisit = warc.record_bytes(6, 0, "http://a", b"body", digest, "<urn:page:5:0>")
    assert warc.parse_record(revisit)[5:] == (None, 4, digest, "<urn:page:5:0>")
    for wrong in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"body", b"bodx"), good.replace(b"WARC-Date", b"WARC Date"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"Content-Length: 4\r", b"Content-Length: 5\r"), revisit.replace(b"WARC-Refers-To", b"WARC-Other")):
        with pytest.raises(ValueError):
            warc.parse_record(wrong)


def test_frames_of_other_writers():
    raw = zstandard.train_dictionary(1024, [b"header %d of a record, again and again" % i * 9 for i in range(99)], k=64, d=8).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False)
    frames = [packer.compress(b"header 7" * n) for n in (1, 50_000)]
    data = struct.pack("<II", warc.DICTIONARY, len(raw)) + raw + frames[0] + warc.EMPTY_FRAME + frames[1]
    assert list(warc.frames_of(memoryview(data))) == [b"header 7", b"header 7" * 50_000]
    assert list(warc.frames_of(memoryview(zstandard.compress(b"plain")))) == [b"plain"]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames_of(memoryview(frames[0])))


def _lloyd(rows, entries, rounds, scale=1024, parts=4):
    kept = [(i, label, [int(np.floor(scale * float(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = -(-max(len(v) for *_, v in kept) // parts) * parts
    x = np.array([v + [0] * (dim - len(v)) for *_, v in kept], object).reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][2]))[:entries]
    books = [[list(x[k, p]) for k in order] for p in range(parts)]

    def assign():
        return [[min(range(len(order)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(row[p], books[p][j], strict=True)), j)) for p in range(parts)] for row in x]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for j in range(len(order)):
                own = [row[p] for row, a in zip(x, at, strict=True) if a[p] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for (i, label, _), row, a in zip(kept, x, assign(), strict=True):
        out.append((i, label, "".join(f"{c:02x}" for c in a), sum((u - v) ** 2 for p in range(parts) for u, v in zip(row[p], books[p][a[p]], strict=True))))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return out, digest


@pytest.mark.parametrize("case", ["clusters", "ties", "awkward"])
def test_vector_codes(spark, case, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 8 * 8 * 50)
    rng = np.random.default_rng(3)
    if case == "clusters":
        rows = [(i, int(i % 3), (rng.integers(-3, 4, 8) + rng.normal(size=8) * 0.1).tolist()) for i in range(400)]
    elif case == "ties":
        rows = [(i, 1, (rng.integers(-1, 2, 8) / 1024).tolist()) for i in range(300)]
    else:
        rows = [(3, None, [0.5] * 8), (1, None, None), (2, 5, [None] * 8), (None, 5, [0.25] * 8), (None, 5, [0.25] * 7), (7, 5, [float("nan")] * 8), (7, 5, [-0.00001] * 8), (7, 5, [-0.00001] * 8), (8, 5, []), (9, None, [1e5, -1e5] * 4), (10, 6, [float("-inf")] * 8)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, e string, ids string").repartition(3)
    got = vector_codes.with_label_errors(vector_codes.vector_codes(df, entries=16)).collect()
    want, digest = _lloyd(rows, 16, 4)
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in got), key=str) == sorted(want, key=str)
    assert {r["codebooks_sha256"] for r in got} == {digest}
    for r in got:
        assert r["label_error"] == sum(e for _, label, _, e in want if label == r["label"])


def test_vector_codes_edges(spark):
    df = spark.createDataFrame([(1, 1, [1e300, -1e300, 0.0, 1.0]), (2, 1, [0.0] * 4)], "vec_id long, label int, embedding array<double>")
    assert {(r["vec_id"], r["error"]) for r in vector_codes.vector_codes(df).collect()} == {(1, 0), (2, 0)}
    assert vector_codes.with_label_errors(vector_codes.vector_codes(df.limit(0))).count() == 0


def test_heaps_pop_less_than_all():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4)) * 30 + np.repeat(rng.integers(-1000, 1000, (8, 4)), 250, axis=0)
    x, books = x.astype(np.int64), np.stack([x[i * 250] for i in range(8)]).astype(np.int64)
    at, slack = vector_codes.measured(x, books)
    moved = books + rng.integers(-20, 20, books.shape)
    step = np.sqrt(((moved - books) ** 2).sum(axis=1))[None]
    drift = (step + vector_codes.most_of_others(step))[0]
    popped = vector_codes.violated(at, slack, drift)
    new = vector_codes.measured(x, moved)[0]
    assert len(popped) < 1000 and set(np.flatnonzero(new != at)) <= set(popped)


def _mined(rows, every, p=5, n=10):
    kept = [(i, label, [int(np.floor(256 * float(x))) for x in v], k) for k, (i, label, v) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in kept:
        if a[0] % every:
            continue
        others = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[3], b[1]) for b in kept if b[3] != a[3]))
        for s, i, _, _ in [o for o in others if o[3] == a[1]][:p]:
            fit = [o for o in others if o[3] != a[1] and 30 * -s <= 100 * -o[0] <= 90 * -s][:n]
            out += [(a[0], i, k + 1, o[1], -s, -o[0]) for k, o in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "clusters", "copies", "awkward"])
def test_hard_negatives(spark, case, monkeypatch):
    for name, value in (("SAMPLE_ROWS", 300), ("TOP_LEAVES", 6), ("SHARD_BYTES", 8 * 8 * 40), ("LEAF_ROWS", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(5)
    if case == "random":
        rows = [(i, int(i % 4), rng.normal(size=8).tolist()) for i in range(600)]
    elif case == "clusters":
        centres = rng.normal(size=(12, 8))
        rows = [(i, int(rng.integers(0, 3)), (centres[i % 12] + rng.normal(size=8) * 0.15).tolist()) for i in range(600)]
    elif case == "copies":
        rows = [(i, int(i % 3), [1.0] * 8 if i % 3 else rng.integers(0, 3, 8).astype(float).tolist()) for i in range(500)]
    else:
        rows = [(0, 1, [1.0] * 8), (0, 1, [1.0] * 8), (1, 1, [0.9] * 8), (2, 2, [0.5] * 8), (3, 2, [0.5] * 7), (4, 2, []), (5, None, [0.5] * 8), (None, 2, [0.5] * 8), (6, 2, None), (7, 2, [None] * 8), (8, 2, [float("inf")] * 8), (10, 3, [-1.0] * 8), (20, 4, [-1.0] * 8), (30, 3, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, rid string, score string").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == _mined(rows, 10) and (got or case == "awkward")
    assert hard_negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0


def test_tree_visits_less_than_all():
    rng = np.random.default_rng(1)
    x = (np.repeat(rng.normal(size=(20, 6)) * 1000, 200, axis=0) + rng.normal(size=(4000, 6)) * 20).astype(np.int64)
    mm = int((x * x).sum(axis=1).max())
    shard = hard_negatives.Shard(np.arange(4000), np.arange(4000), [i % 2 for i in range(4000)], x, mm, 50)
    s = x @ x[7]
    hi = int(np.sort(s)[-900])
    shard.ask(7, 1, x[7])
    got = shard.nearest(False, hi // 3, hi, 5)
    at = sorted((-int(v), i) for i, v in enumerate(s) if hi // 3 <= v <= hi and i % 2 == 0)[:5]
    assert [(a, i) for a, i, _ in got] == [(-a, i) for a, i in at]
    assert len(shard.ranked) < len(shard.tree.leaves) / 2


def test_moved_labels(spark):
    df = spark.createDataFrame([(0, 9, [1.0]), (7, 3, None), (8, 3, None), (14, None, None)], "vec_id long, label int, embedding array<double>")
    assert [r["label"] for r in hard_negatives.with_moved_labels(df).orderBy("vec_id").collect()] == [0, 4, 3, None]


def test_new_queries_run_over_whole_tables(spark, sf):
    q = queries.queries()
    assert q["op11_warc"](spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert q["op12_vector_codes"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
