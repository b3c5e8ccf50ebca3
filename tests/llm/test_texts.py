"""Operators on documents against brute force on small, awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, mixing, ngram_join, packing, quality, queries, recompression, repeats, suffix_dedup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def awkward(seed=0):
    """Copies, near copies, shared passages, nulls, empty, odd white space, very long and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(90))
    base = [" ".join(word() for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 60, 200, 400]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    n = len(rows)
    for k in range(30):
        words = rng.choice(base).split()
        for _ in range(len(words) // 40):
            words[rng.randrange(len(words))] = word()
        rows.append((n + k, " ".join(words)))
    rows += [(100 + k, f"{' '.join(word() for _ in range(50))} {passage} {word()}") for k in range(8)]
    rows += [(200, None), (201, None), (202, ""), (203, " \t\n "), (204, "one"), (205, "one"), (206, "a\tb  c"), (207, "a b\nc")]
    rows += [(208, "same " * 120), (209, " ".join(word() for _ in range(6000))), (210, "é😀 " * 300), (None, passage), (None, None)]
    rows += [(3, base[3]), (211, passage + "\u00a0" + passage)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


def test_packing_round_trip(spark, documents, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rows = [*rows, (300, "<|endoftext|> x\x1cy"), (301, "ΟΔΥΣΣΕΥΣ don't İ ½"), (302, "word " * 9000)]
    got = packing.pack_documents(documents(rows), TOKENIZER, docs_per_shard=30).collect()
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096
    assert packing.pack_documents(documents([]), TOKENIZER).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 50) for _ in range(rng.randint(1, 50))), reverse=True)
        number, _ = packing.best_fit_decreasing(np.array(lengths), 50)
        fill: list[int] = []
        for n in lengths:
            fits = [f for f in fill if f + n <= 50]
            if fits:
                fill[fill.index(max(fits))] += n
            else:
                fill.append(n)
        assert sorted(np.bincount(number, weights=lengths).astype(int).tolist()) == sorted(fill)


def test_exact_dedup(spark, documents, rows):
    got = exact_dedup.exact_dedup(documents(rows)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = Counter((i, first[norm(t)], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_dedup(documents([])).count() == 0
    left = exact_dedup.keep_first(documents(rows))
    assert left.columns == documents(rows).columns and left.count() == len(groups)
    assert {(r["doc_id"], norm(r["text"])) for r in left.collect()} == {(first[k], k) for k in groups}


def test_exact_dedup_goes_on_from_its_state(spark, documents, tmp_path):
    """Rows that arrive in many batches meet the state of earlier ones."""
    log = exact_dedup.arrival_log(documents([(i, f"text {i % 7}") for i in range(60)]).repartition(6))
    source = log.inputFiles()[0].rpartition("/")[0]
    got = {r["text_sha256"]: (r["first"]["doc_id"], r["group_size"]) for r in exact_dedup.stream_states(spark, source, files_per_batch=1).collect()}
    want = {hashlib.sha256(f"text {k}".encode()).hexdigest(): (k, len(range(k, 60, 7))) for k in range(7)}
    assert got == want


def test_ngram_join(spark, documents, rows):
    def tokens(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    live = [(i, tokens(t)) for i, t in rows]
    n = len(live)
    linked = {a: set() for a in range(n)}
    for a in range(n):
        for b in range(a):
            x, y = live[a][1], live[b][1]
            if x and y and None not in (live[a][0], live[b][0]) and len(x & y) >= 0.8 * len(x | y):
                linked[a].add(b)
                linked[b].add(a)
    label = [i for i, _ in live]
    for _ in range(n):
        label = [label[a] if live[a][0] is None else min([label[a], *(label[b] for b in linked[a])]) for a in range(n)]
    want = Counter((live[a][0], label[a], len(linked[a])) for a in range(n))
    got = ngram_join.ngram_join(documents(rows))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == want
    assert sum(w[2] > 0 for w in want) > 20
    assert ngram_join.ngram_join(documents([])).count() == 0
    left = ngram_join.one_of_each(documents(rows))
    assert left.columns == documents(rows).columns
    # of rows that agree in doc_id and text one stays; a null id and a text without words are no copies of anything
    once = [live[a] for a in range(n) if live[a][0] is None or not live[a][1]] + list({(i, rows[a][1]): (i, x) for a, (i, x) in enumerate(live) if x and i is not None and i == label[a]}.values())
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, _ in once)


def test_ngram_join_splits_large_buckets(spark, documents, monkeypatch):
    """With tiny limits every way is taken: splitting, blocks of pairs, blocks in counting."""
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    monkeypatch.setattr(ngram_join, "MEETINGS", 10**9)  # no first round
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(24):
        own = list(words)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(documents(rows)).collect()}
    assert got == {i: (0, 23) for i in range(24)}


def near_families(size=6, families=8):
    """Texts of which those of a family share some 70 % of their five-grams, below the threshold, and meet in several buckets."""
    rng = random.Random(11)
    out = []
    for f in range(families):
        common = [f"c{f}_{k}" for k in range(330)]
        out += [" ".join(common + [f"o{f}_{m}_{k}" for k in range(rng.randrange(60, 75))]) for m in range(size)]
        out.append(out[-1] + " end")  # one link a family
    return list(enumerate(out))


@pytest.mark.parametrize("cluster_rows", [256, 3])
def test_ngram_join_sends_a_text_to_one_group(spark, documents, monkeypatch, cluster_rows):
    """A text goes to one group a round, however many buckets its set shares with near ones, and is shuffled for that alone."""
    monkeypatch.setattr(ngram_join, "MEETINGS", 10**9)  # no first round
    monkeypatch.setattr(ngram_join, "CLUSTER_ROWS", cluster_rows, raising=False)
    sent, joins, mapped = [], [], ngram_join.mapped_groups

    def watched(frame, *args):
        if "text" in frame.columns:
            joins.append("SortMergeJoin" in frame._jdf.queryExecution().executedPlan().toString())
            sent.append(Counter(r["kid"] for r in frame.select("kid").collect()))
        return mapped(frame, *args)

    monkeypatch.setattr(ngram_join, "mapped_groups", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are larger than it
    try:
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(documents(near_families())).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: (i - 1, 1) if i % 7 == 6 else (i, int(i % 7 == 5)) for i in range(56)}
    assert not any(joins) and len(max(sent, key=len)) == 56
    most = max(n for c in sent for n in c.values())
    assert most == 1 if cluster_rows == 256 else most > 1  # clusters over the limit stay in their buckets


def test_paths_below_their_parents():
    tokens = np.unique(np.random.default_rng(4).integers(0, 1 << 63, 900).astype(np.uint64))
    levels = ngram_join.path_tree(tokens, 7, (2.0, 2.0, 1.25))
    p1, p2, p3 = ngram_join.path_blobs(levels)
    assert ngram_join.path_blobs(levels[:1])[1:] == [b"", b""]
    for k, (above, blob) in ((1, (p1, p2)), (2, (p2, p3))):
        (upper, _), (paths, parent) = levels[k - 1], levels[k]
        for asked in (upper[:0], upper[1:2], upper[::3], upper):
            want = {int(p) for p, of in zip(paths, parent, strict=True) if upper[of] in asked}
            assert set(ngram_join.paths_below(above, blob, asked, k == 1).tolist()) == want and (len(want) > 0 or len(asked) < 2)
    assert len(ngram_join.paths_below(b"", b"", np.zeros(0, np.int64), True)) == 0


def test_estimates_to_one_head():
    rng = np.random.default_rng(3)
    universe = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(universe, k, replace=False)) for k in (2, 64, 65, 700, 2000)]
    sizes, sketches = np.array(list(map(len, sets))), [ngram_join.sketch_of(s) for s in sets]
    exact = ngram_join.estimated([s[: ngram_join.SKETCH] for s in sets], sizes)
    assert np.allclose(ngram_join.estimated(sketches, sizes), exact)
    for head in range(len(sets)):
        others = np.arange(len(sets)) != head
        assert np.allclose(ngram_join.estimated_to(head, sketches, sizes)[others], exact[head, others])


def test_estimates_and_counts():
    rng = np.random.default_rng(2)
    universe = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(universe, k, replace=False)) for k in (1, 3, 60, 500, 2000, 2000)]
    sets.append(sets[-1][: int(len(sets[-1]) * 0.9)])
    j = ngram_join.jaccard(sets)
    for a in range(len(sets)):
        for b in range(len(sets)):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert a == b or abs(j[a, b] - len(x & y) / len(x | y)) < 1e-12
    e = ngram_join.estimated([s[: ngram_join.SKETCH] for s in sets], np.array(list(map(len, sets))))
    assert abs(e - j)[~np.eye(len(sets), dtype=bool)].max() < 0.25
    assert ngram_join.runs_needed(0.8, (2.0, 2.0, 1.25), 0.999) == 7


def test_substring_dedup(spark, documents, rows):
    got = recompression.with_kept_text(documents(rows)).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    want = Counter()
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in got) == want
    assert sum(k[2] for k in want) > 500
    assert recompression.with_kept_text(documents([])).count() == 0


def test_every_window_has_a_border():
    """The guarantee behind the method: eight words around a border in each window, alike in all its copies."""
    rng = np.random.default_rng(0)
    few, many = rng.integers(0, 1 << 63, 6).astype(np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    for pool in (few, many):
        for _ in range(30):
            w = rng.choice(pool, 300)
            at = recompression.borders(w)
            inner = {int(b) for b in at}
            for s in range(0, 300 - 12):
                assert any(s + 4 <= b <= s + 9 for b in inner)
            cut = w[40:200]
            assert {int(b) + 40 for b in recompression.borders(cut) if 4 <= b <= 156} == {b for b in inner if 44 <= b <= 196}


def test_suffix_dedup(spark, documents, rows):
    got = suffix_dedup.with_kept_bytes(documents(rows)).collect()
    seen: Counter = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        keep = np.ones(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                keep[k : k + 400] = False
        spans = int((np.diff(np.concatenate([[1], keep.astype(int)])) == -1).sum())
        want[i, len(b), int((~keep).sum()), spans, np.frombuffer(b, np.uint8)[keep].tobytes()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    assert suffix_dedup.with_kept_bytes(documents([])).count() == 0


def test_suffix_dedup_tells_texts_with_one_hash_apart(spark, documents, rows, monkeypatch):
    read = lambda: Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.with_kept_bytes(documents(rows)).collect())
    want = read()
    monkeypatch.setattr(suffix_dedup, "row_hash", lambda text: F.length(text).cast("long") % 3)
    assert read() == want


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        s = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 70))
        order = sorted(range(len(s)), key=lambda i: tuple(s[i:]))
        sa = suffix_dedup.suffix_array(s)
        assert list(sa) == order
        shared = suffix_dedup.permuted_prefixes(s, sa)  # they end at separators, which are zeros
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k] != 0:
                k += 1
            assert shared[b] == k


def test_repeated_windows_have_no_cap():
    """Equal strings in one order twice share far more than any one of them holds; every window of each is found, and those of a long pair too."""
    rng = np.random.default_rng(6)
    strings = [rng.integers(97, 123, 560).astype(np.uint8) for _ in range(8)]
    long = rng.integers(97, 123, 6000).astype(np.uint8)
    parts = [*strings, *strings, long, np.concatenate([long[:10], long])]
    found = suffix_dedup.repeated_windows(parts, np.ones(len(parts), np.int64), np.arange(len(parts), dtype=np.int64) << 40)
    assert [len(x) for x in found[:16]] == [161] * 16
    assert len(found[16]) == 5601 and list(found[17]) == list(range(10, 5611))


def test_minimizers_of_equal_windows_agree():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 3000).astype(np.uint8)
    at, h = suffix_dedup.minimizers(data)
    assert np.all(np.diff(at) <= suffix_dedup.WINDOW - suffix_dedup.GRAM + 1)
    again, h2 = suffix_dedup.minimizers(data[500:2000])
    inner = {(int(p) + 500, int(x)) for p, x in zip(again, h2, strict=True)}
    assert inner <= {(int(p), int(x)) for p, x in zip(at, h, strict=True)}


def test_blobs_and_ranges():
    rng = np.random.default_rng(4)
    v = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (repeats.unpack(repeats.pack(v)) == v).all() and len(repeats.unpack(repeats.pack(v[:0]))) == 0
    a, z = repeats.merged_ranges(np.array([5, 0, 20, 8]), np.array([9, 3, 25, 12]))
    assert list(zip(a, z, strict=True)) == [(0, 3), (5, 12), (20, 25)]


def test_quality(spark, sf):
    got = queries.op3_quality(spark, sf).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchdf()
    both = got.merge(labels, on="doc_id")
    out = both[both.held_out]
    assert len(out) > 5 and (out.predicted == out.quality).mean() >= 0.95
    assert got.score.between(0, 1).all() and (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_quality_edges(spark, documents, rows):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(documents(rows), labels)
    assert got.count() == len(rows) and got.filter("score is null or held_out is null").count() == 0
    none = quality.score_quality(documents(rows), labels.limit(0))
    assert {r["predicted"] for r in none.collect()} == {1}
    assert quality.score_quality(documents([]), labels).count() == 0
    left = quality.accepted(documents(rows), labels)
    assert left.columns == documents(rows).columns
    assert left.count() == got.filter("predicted = 1").count()


def test_discriminant_is_the_ratio_of_normal_densities():
    rng = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = {k: rng.normal(k, 1 + k, (400, d)) for k in (0, 1)}
    model = quality.Discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}, pooled=0.0, diagonal=0.0)
    at = rng.normal(0.5, 1, (5, d))

    def density(k):
        m, c = x[k].mean(axis=0), np.cov(x[k].T, bias=True) + 1e-4 * np.eye(d)
        return -0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,ij->i", (at - m) @ np.linalg.inv(c), at - m)

    assert np.allclose(model.score(at), 1 / (1 + np.exp(density(0) - density(1))), atol=1e-9)


def test_mixing_meets_its_targets(spark):
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 60))), rng.choice(["en", "en", "de"]), rng.choice(["a", "a", "a", "b"]), 1, 0.5) for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, probability double")
    out = mixing.mix_sources(df, targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}}, size=0.3).toPandas()
    assert len(out) == 2000 and out.probability.between(0, 1).all()
    for m in ("source", "lang"):
        expected = (out.n_tokens * out.probability).groupby(out[m]).sum()
        assert abs(expected / expected.sum() - 0.5).max() < 0.01
    assert abs((out.n_tokens * out.probability).sum() / out.n_tokens.sum() - 0.3) < 0.01
    assert abs(out.selected.mean() - out.probability.mean()) < 0.05
    kept = mixing.sampled(df, targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}}, size=0.3)
    assert {r["doc_id"] for r in kept.collect()} == set(out[out.selected].doc_id) and kept.columns == df.columns


def test_mixing_edges(spark, documents, rows):
    out = mixing.mix_sources(documents([*rows, (400, "x")]).replace("src0", None, ["source"]))
    assert out.count() == len(rows) + 1 and out.filter("probability is null or (selected is null and doc_id is not null)").count() == 0
    assert mixing.mix_sources(documents([])).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = mixing.saved(stage(spark, docs, sf), name)
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        assert docs.columns == columns and ids <= before and len(ids) == len(after)
        if name == "quality":
            assert all(labels.get(i, 1) == 0 or i in ids for i in before if i in labels)
        elif name == "exact_dedup":
            assert len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in after}) == len(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_rows_that_share_an_id_are_told_apart(spark, documents):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = documents([(1, a), (2, a + " z"), (2, b), (3, None), (3, "")])
    assert sorted((r["doc_id"], r["text"] or "") for r in ngram_join.one_of_each(docs).collect()) == [(1, a), (2, b), (3, ""), (3, "")]
    docs = documents([(7, a), (7, a), (7, a + " z"), (8, b)])
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [7, 8]


def test_mixing_keeps_rows_by_their_own_topic(spark):
    rng = random.Random(1)
    rows = [(None, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(1, 40))), "en", "a") for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # ids are null, so all rows are drawn alike, and by this seed some topics are taken and others not
    want = mixing.mix_sources(df.withColumn("copy", df["text"]), seed=407).filter("selected").select("copy").collect()
    assert 0 < len(want) < 300
    assert sorted(r["text"] for r in mixing.sampled(df, seed=407).collect()) == sorted(r["copy"] for r in want)
