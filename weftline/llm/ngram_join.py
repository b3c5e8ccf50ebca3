"""Similarity join of documents on the Jaccard similarity of their word five-grams, by chosen paths.

Every run samples a few of a set's tokens by a hash that all sets share, so that two similar sets very probably
choose a common token and meet in its bucket. Buckets that stay large are split again on tokens sampled for that path, down to a
fixed depth. Runs repeat until a pair at the threshold is missed with a probability below a target. A first
round links each set to the set that it meets most often, which merges large groups of near copies with one comparison
per member; a second round compares, in every bucket, all pairs that are not yet in one component. Buckets that
are still over the limit are compared in blocks, so nothing is capped. Sketches are compared first, and texts only where those come
near; sets that come near one another in several buckets form one cluster, to which each text goes once. Last, links are counted
inside the components, where all links lie, in blocks as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import gram_hashes, keyed, mix, named_keys, same_keys, saved, word_hashes
from weftline.llm.linking import connected_components, in_blocks, mapped_groups, pair_mask, small, stars

N, LEAST = 5, 0.8
#: Expected number of tokens that a path chooses in a set, by level of splitting (the last level is not split again and needs fewer), and
#: recall of a pair at the threshold.
CHOSEN, TARGET_RECALL = (2.0, 2.0, 1.25), 0.999
BUCKET_ROWS, BLOCK_ROWS = 64, 1024
#: Rows from which a level-one bucket is not streamed through a task, and values in a table of paths by tokens.
HOT_ROWS, TABLE = 4096, 4_000_000
#: Smallest hashes of a set that its sketch keeps, and the estimate under which a pair is not compared exactly
#: (4.5 standard deviations below the threshold).
SKETCH, SKETCH_LEAST = 64, 0.575
#: Common level-one paths from which two sets are linked in the first round.
MEETINGS = 3
#: Largest cluster of near sets that is compared as one group; the sets of larger ones are compared bucket by bucket.
CLUSTER_ROWS = 256
_U = np.uint64


def runs_needed(least: float, chosen: tuple[float, ...], recall: float) -> int:
    """Runs after which a pair at ``least`` shares a path to the full depth with the target probability.

    The common nodes of two sets form a branching process with chosen * least children on average, Poisson as sets grow."""
    lost = 0.0
    for c in reversed(chosen):
        lost = math.exp(-c * least * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words; a text with fewer words has the run of all its words, an empty one nothing."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))


def set_id(tokens: np.ndarray) -> int:
    """One signed 64-bit id per distinct set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def choose(tokens: np.ndarray, paths: np.ndarray, chosen: float) -> tuple[np.ndarray, np.ndarray]:
    """For each path the tokens it samples: (index of the path, the longer path). A token's chance is chosen / size of the set."""
    odd = mix(paths) | _U(1)
    limit = _U(min(2**64 - 1, int(2**64 * min(1.0, chosen / len(tokens)))))
    some = max(1, TABLE // len(tokens))  # paths at a time: a long text needs no more memory than TABLE values or its own
    found = [np.nonzero((tokens[None, :] * odd[at : at + some, None]) <= limit) for at in range(0, max(1, len(paths)), some)]
    of = np.concatenate([f[0] + k * some for k, f in enumerate(found)])
    return of, mix(paths[of] * _U(0x9FB21C651E98DF25) + tokens[np.concatenate([f[1] for f in found])])


def path_tree(tokens: np.ndarray, runs: int, chosen: tuple[float, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Paths by level, each with the index of its parent in the level above; they depend on the set alone."""
    paths = mix(np.arange(1, runs + 1, dtype=_U))
    levels = []
    for c in chosen:
        parent, paths = choose(tokens, paths, c)
        levels.append((paths.view(np.int64), parent))
        if not len(paths):
            break
    return levels


def path_blobs(levels: list[tuple[np.ndarray, np.ndarray]], depth: int = 3) -> list[bytes]:
    """Each level's distinct paths, from the second on followed by their parents' places among the distinct paths of the level above."""
    blobs, place = [], np.zeros(0, np.int64)
    for k, (paths, parent) in enumerate(levels[:depth]):
        kept, first, now = np.unique(paths, return_index=True, return_inverse=True)
        blobs.append(kept.astype("<i8").tobytes() + (place[parent[first]].astype("<u4").tobytes() if k else b""))
        place = now
    return blobs + [b""] * (depth - len(blobs))


def paths_below(above: bytes, blob: bytes, parents: np.ndarray, first: bool) -> np.ndarray:
    """Distinct paths of a level's blob whose parents, in the blob of the level above (``first``: the first), are among ``parents``."""
    n = len(blob) // 12
    upper = np.frombuffer(above, "<i8", len(above) // (8 if first else 12))
    return np.frombuffer(blob, "<i8", n)[np.isin(upper, parents)[np.frombuffer(blob, "<u4", n, 8 * n)]]


def sketch_of(tokens: np.ndarray) -> np.ndarray:
    """The upper halves of a set's smallest hashes; two hashes that differ only below raise an estimate by one part of a sketch."""
    return (tokens[:SKETCH] >> _U(32)).astype("<u4")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a bounded list of sets, from one token-by-set matrix in column chunks."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = times[column] > 1  # a token of one set alone is in no intersection
    column, owner = column[own], owner[own]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) != 0]))
    both = np.zeros((n, n), np.float32)  # whole numbers, exact up to 2**24 tokens
    wide = max(256, 6_000_000 // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        x = np.zeros((n, min(wide, int(column[hi - 1]) - at + 1)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        both += x @ x.T
    return both.astype(float)


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    both, sizes = common_counts(sets), np.array([len(s) for s in sets], float)
    return both / (sizes[:, None] + sizes[None, :] - both)


def last_known(sketches: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The hash up to which each sketch has its set whole."""
    return np.array([np.iinfo(s.dtype).max if size <= SKETCH else s[-1] for s, size in zip(sketches, sizes, strict=True)], sketches[0].dtype)


def estimated(sketches: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Estimated similarities from sets' smallest hashes. Up to the smaller of two sketches' last hashes both sets are known
    whole, so their similarity there is an unbiased estimate; it is exact for sets that fit in their sketch."""
    last = last_known(sketches, sizes)
    upto = np.minimum(last[:, None], last[None, :])
    held = np.stack([np.searchsorted(s, upto[i], "right") for i, s in enumerate(sketches)]).astype(float)
    both = common_counts(sketches)
    return both / (held + held.T - both)


def estimated_to(head: int, sketches: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The row of ``estimated`` for one of the sets."""
    last = last_known(sketches, sizes)
    upto, of, all_ = np.minimum(last, last[head]), np.repeat(np.arange(len(sketches)), [len(s) for s in sketches]), np.concatenate(sketches)
    known = all_ <= upto[of]
    held = np.bincount(of[known], minlength=len(sketches)).astype(float)
    both = np.bincount(of[known & np.isin(all_, sketches[head])], minlength=len(sketches))
    return both / (held + np.searchsorted(sketches[head], upto, "right") - both)


def ngram_join(docs: DataFrame, *, least: float = LEAST, n: int = N, recall: float = TARGET_RECALL, chosen: tuple[float, ...] = CHOSEN) -> DataFrame:
    """doc_id, class_id, n_links for every row.

    Two rows are linked if the Jaccard similarity of their sets of ``n`` consecutive words is ``least`` or more; words are runs of
    non-white characters, unchanged. ``n_links`` is the number of other rows linked directly, copies included; ``class_id`` is the
    smallest doc_id that links reach, the row's own included. A text with fewer than ``n`` words has one token, all its words; a null text or one without
    words links with nothing. A row with a null doc_id links with nothing and has a null class_id. Rows that repeat link with each other. Other
    columns are ignored; an empty table gives no rows.
    """
    return classes_of(docs, least=least, n=n, recall=recall, chosen=chosen).select("doc_id", "class_id", "n_links")


def row_key(docs: DataFrame) -> Column:
    """A hash of id and text, so that rows with one doc_id but different texts stay apart."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def classes_of(docs: DataFrame, *, least: float = LEAST, n: int = N, recall: float = TARGET_RECALL, chosen: tuple[float, ...] = CHOSEN) -> DataFrame:
    """What ``ngram_join`` returns, with ``row`` (``row_key``) and ``component``, which is null for rows without words or doc_id. Two components can
    have one class_id where a doc_id repeats."""
    runs = runs_needed(least, chosen, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(docs).alias("row"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kid, size, sketch, p1, p2, p3 = [], [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                x = shingles(text.as_py(), n) if doc_id is not None else ()
                size.append(len(x))
                if not len(x):
                    for c in (kid, sketch, p1, p2, p3):
                        c.append(None)
                    continue
                kid.append(set_id(x))
                sketch.append(sketch_of(x).tobytes())
                for c, blob in zip((p1, p2, p3), path_blobs(path_tree(x, runs, chosen)), strict=True):
                    c.append(blob)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), pa.array(kid, pa.int64()), pa.array(size, pa.int32()), *(pa.array(c, pa.binary()) for c in (sketch, p1, p2, p3))],
                ["doc_id", "row", "kid", "size", "sketch", "p1", "p2", "p3"],
            )

    rows = saved(texts.mapInArrow(describe, "doc_id long, row long, kid long, size int, sketch binary, p1 binary, p2 binary, p3 binary"), "sets")
    sets = rows.filter("kid is not null")
    kinds = saved(sets.groupBy("kid").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies")), "kinds")

    def first_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x, "<i8") for x in b.column("p1").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("kid").to_numpy(), [len(x) for x in parts])), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))], ["kid", "path"])

    # one row of each distinct set: rows that repeat a set are left out by the few sets that have copies
    twice = small(saved(kinds.filter("copies > 1").select(F.col("kid").alias("_kid"), F.col("doc").alias("_doc")), "twice"))
    single = sets.join(twice, (F.col("kid") == F.col("_kid")) & (F.col("doc_id") != F.col("_doc")), "left_anti")

    # level-one buckets with company, and the smallest set in each: a task streams through its sorted paths and holds one row of a bucket; of large
    # buckets the smallest set is found by partial minima
    def with_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader, told = None, 0, False
        for b in batches:
            path, kid = b.column("path").to_numpy(), b.column("kid").to_numpy()
            if not len(path):
                continue
            goes_on = last is not None and path[0] == last
            new = np.concatenate([[not goes_on], path[1:] != path[:-1]])
            lead = np.where(new, kid, 0)
            if goes_on:
                lead[0] = leader
            mark = np.maximum.accumulate(np.where(new, np.arange(len(path)), 0))
            lead = lead[mark]
            followed = np.concatenate([~new[1:], [False]])  # the last row's company comes with the next batch
            keep = ~new | followed
            out_kid, out_path, out_lead = kid[keep], path[keep], lead[keep]
            if goes_on and not told:  # the row that ended the batch before has company after all
                out_kid, out_path, out_lead = np.append(out_kid, leader), np.append(out_path, last), np.append(out_lead, leader)
            told = bool(keep[-1]) or (goes_on and path[-1] == last)
            last, leader = path[-1], lead[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (out_kid, out_path, out_lead)], ["kid", "path", "leader"])

    paths = saved(single.select("kid", "p1").mapInArrow(first_paths, "kid long, path long"), "paths")
    hot = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("kid").alias("leader")).filter(F.col("n") > HOT_ROWS)
    hot = small(saved(hot.select("path", "leader"), "hot"))  # one row for HOT_ROWS paths at most; their rows stay where they are
    cool = paths.join(hot, "path", "left_anti").repartition("path").sortWithinPartitions("path", "kid")
    meeting = saved(cool.mapInArrow(with_leader, "kid long, path long, leader long").unionByName(paths.join(hot, "path")), "meeting")

    # first round: each set against the set it meets most often
    often = meeting.filter("kid != leader").groupBy("kid", "leader").count().filter(F.col("count") >= MEETINGS)
    led = saved(often.groupBy("kid").agg(F.max(F.struct("count", "leader")).alias("m")).select("kid", F.col("m.leader").alias("leader")), "led")

    def placed(led: DataFrame) -> DataFrame:
        """Groups of each leader and its followers; a leader with many is sent to each block of them."""
        star = led.select("kid", F.col("leader").alias("star"), F.lit(0).alias("head"))
        star = star.unionByName(led.select(F.col("leader").alias("kid"), F.col("leader").alias("star"), F.lit(1).alias("head")).distinct())
        blocks = saved(led.groupBy("leader").count().select(F.col("leader").alias("star"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("b")), "stars")
        part = F.when(F.col("head") == 1, F.sequence(F.lit(0), F.col("b") - 1)).otherwise(F.array(F.pmod(F.xxhash64("kid"), "b").cast("int")))
        dealt = star.join(blocks, "star").select("kid", F.col("head").alias("block"), "star", F.explode(part).alias("part"))
        return saved(dealt.select(F.xxhash64("star", "part").alias("g"), "kid", "block"), "placed")

    def with_texts(rows: DataFrame) -> DataFrame:
        """``rows``, a saved table, with the text of each set ``kid``, from one of its rows. A doc_id that repeats may fetch other texts too; ``wanted_sets``
        leaves them out. Where the rows can be broadcast, a text is not shuffled before it goes to its group."""
        ids = small(saved(rows.select("kid").distinct().join(kinds, "kid").select("kid", "doc"), "wanted"))
        return texts.join(ids, texts["doc_id"] == ids["doc"]).select("kid", "text").join(small(rows), "kid")

    def with_sketches(rows: DataFrame) -> DataFrame:
        ids = small(saved(rows.select("kid").distinct(), "sketched"))
        return rows.join(sets.join(ids, "kid", "left_semi").groupBy("kid").agg(F.first("sketch").alias("sketch"), F.first("size").alias("size")), "kid")

    def sketches_in(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in table.column("sketch").to_pylist()], table.column("size").to_numpy()

    def near_head(table: pa.Table) -> list[tuple]:
        """Followers that may be similar to their leader."""
        head = np.flatnonzero(table.column("block").to_numpy() == 1)
        if not len(head):
            return []
        kid = table.column("kid").to_numpy()
        near = estimated_to(int(head[0]), *sketches_in(table)) >= SKETCH_LEAST
        near[head] = False
        return [(int(k), int(kid[head[0]])) for k in kid[near]]

    def wanted_sets(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
        x = [shingles(t, n) for t in table.column("text").to_pylist()]
        kid, seen, keep = table.column("kid").to_pylist(), set(), []
        slot = table.column("block").to_pylist()
        for i, own in enumerate(x):
            if len(own) and set_id(own) == kid[i] and (kid[i], slot[i]) not in seen:
                seen.add((kid[i], slot[i]))
                keep.append(i)
        return table.take(pa.array(keep, pa.int64())), [x[i] for i in keep]

    def against_head(table: pa.Table) -> list[tuple]:
        table, x = wanted_sets(table)
        head = np.array(table.column("block").to_pylist())
        if not (head == 1).any():
            return []
        h, kid = x[int(np.flatnonzero(head == 1)[0])], table.column("kid").to_pylist()
        lead, out = kid[int(np.flatnonzero(head == 1)[0])], []
        for k, s, own in zip(kid, x, head.tolist(), strict=True):
            if not own:
                both = len(np.intersect1d(h, s, assume_unique=True))
                if both >= least * (len(h) + len(s) - both) - 1e-9:
                    out.append((k, lead))
        return out

    led = saved(mapped_groups(with_sketches(placed(led)).select("g", "kid", "block", "sketch", "size"), "g", near_head, "kid long, leader long"), "led")
    edges = saved(mapped_groups(with_texts(placed(led)).select("g", "kid", "block", "text"), "g", against_head, "a long, b long"), "links")
    component = saved(connected_components(edges), "components")

    # second round: buckets with more than one component
    def open_buckets(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of buckets with several components: those to compare now, in groups ``g``, and those of buckets that are to be split.

        A bucket is ready if it is small, or if few of its rows are outside its largest component: each block of that component's rows then
        meets all the others, and rows of the component need not meet each other."""
        own = members
        parts = own.groupBy("path", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("path").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("most"))
        sizes = parts.filter("n > most.c").select("path", "n", F.col("n") - F.col("most.c"), F.col("most.component")).toDF("path", "n", "outside", "main")
        both = saved(own.join(sizes, "path").select("kid", "path", "component", "n", "outside", "main"), "open")
        fits = (F.col("n") <= BUCKET_ROWS) | (F.col("outside") <= BUCKET_ROWS)
        b = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
        part = F.when(F.col("component") == F.col("main"), F.array(F.pmod(F.xxhash64("kid"), b).cast("int"))).otherwise(F.sequence(F.lit(0), b - 1))
        now = both.filter(fits).withColumn("part", F.explode(part))
        return now.select(F.xxhash64("path", "part").alias("g"), "kid", "component", F.lit(0).alias("block"), F.lit(1).alias("alone")), both.filter(~fits).select("kid", "path", "component")

    def split(above: str, column: str, sets_to_split: DataFrame) -> DataFrame:
        """(kid, component, path): the paths of ``column`` below those in ``parents`` of column ``above``; others are never made into rows."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                blobs = zip(b.column(above).to_pylist(), b.column(column).to_pylist(), b.column("parents"), strict=True)
                found = [paths_below(upper, blob, parents.values.to_numpy(), above == "p1") for upper, blob, parents in blobs]
                sizes = [len(x) for x in found]
                of = [pa.array(np.repeat(b.column(c).to_numpy(), sizes)) for c in ("kid", "component")]
                yield pa.RecordBatch.from_arrays([*of, pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["kid", "component", "path"])

        return sets_to_split.select("kid", "component", "parents", above, column).mapInArrow(spread, "kid long, component long, path long")

    first = meeting.select("kid", "path").join(component.withColumnRenamed("id", "kid"), "kid", "left").withColumn("component", F.coalesce("component", "kid"))
    ready, large = open_buckets(first)
    for upper, column in (("p1", "p2"), ("p2", "p3"))[: len(chosen) - 1]:
        # only the sets in large buckets are taken apart further: one row a set, with the paths to split (a set has few, whatever its size)
        above = small(saved(large.groupBy("kid", "component").agg(F.collect_set("path").alias("parents")), "crowded"))
        more, large = open_buckets(saved(split(upper, column, single.join(above, "kid")), "deeper"))
        ready = ready.unionByName(more)
    # what is large to the end is compared block by block
    candidates = saved(ready.unionByName(in_blocks(large, "path", "kid", BLOCK_ROWS).select("g", "kid", "component", "block", "alone")), "candidates")

    def likely(table: pa.Table) -> list[tuple]:
        """Rows of a bucket that may be similar to a row of another component, with the smallest set that such pairs reach."""
        kid, comp = table.column("kid").to_numpy(), table.column("component").to_numpy()
        mask = pair_mask(table.column("block").to_numpy(), table.column("alone").to_numpy()) & (comp[:, None] != comp[None, :])
        near = mask & (estimated(*sketches_in(table)) >= SKETCH_LEAST)
        reached, g = dict(stars(kid, near)), int(table.column("g")[0].as_py())
        rows = zip(kid.tolist(), comp.tolist(), table.column("block").to_pylist(), table.column("alone").to_pylist(), near.any(axis=1).tolist(), strict=True)
        return [(g, k, c, bl, al, reached.get(k, k)) for k, c, bl, al, w in rows if w]

    def linked(table: pa.Table) -> list[tuple]:
        table, x = wanted_sets(table)
        if len(x) < 2:
            return []
        kid, comp = table.column("kid").to_numpy(), table.column("component").to_numpy()
        mask = comp[:, None] != comp[None, :]
        return stars(kid, (jaccard(x) >= least - 1e-12) & mask)

    close = saved(mapped_groups(with_sketches(candidates).select("g", "kid", "component", "block", "alone", "sketch", "size"), "g", likely, "g long, kid long, component long, block int, alone int, reached long"), "close")
    # near sets meet in several buckets: a text goes to its cluster once, where all pairs meet; clusters that are too large for that stay in their buckets
    clusters = saved(connected_components(close.select(F.col("kid").alias("a"), F.col("reached").alias("b"))).toDF("kid", "cluster"), "clusters")
    wide = small(saved(clusters.groupBy("cluster").count().filter(F.col("count") > CLUSTER_ROWS).select("cluster"), "wide"))
    alike = close.select("kid", "component").distinct().join(clusters.join(wide, "cluster", "left_anti"), "kid")
    alike = alike.select(F.xxhash64("cluster").alias("g"), "kid", "component", F.lit(0).alias("block"))
    spread_out = close.join(clusters.join(wide, "cluster", "left_semi"), "kid", "left_semi").select("g", "kid", "component", "block")
    meet = saved(alike.unionByName(spread_out), "meet")
    bridges = mapped_groups(with_texts(meet).select("g", "kid", "component", "block", "text"), "g", linked, "a long, b long")
    component = saved(connected_components(edges.unionByName(bridges)), "components")

    # links of each set, inside its component
    def count_of(table: pa.Table) -> list[tuple]:
        table, x = wanted_sets(table)
        if not len(x):
            return []
        copies = table.column("copies").to_numpy()
        mask = pair_mask(table.column("block").to_numpy(), table.column("alone").to_numpy())
        found = ((jaccard(x) >= least - 1e-12) & mask) @ copies
        return list(zip(table.column("kid").to_pylist(), found.tolist(), strict=True))

    members = saved(component.withColumnRenamed("id", "kid").join(kinds.select("kid", "copies"), "kid"), "members")
    in_groups = saved(in_blocks(members, "component", "kid", BLOCK_ROWS).select("g", "kid", "copies", "block", "alone"), "groups")
    counted = mapped_groups(with_texts(in_groups).select("g", "kid", "copies", "block", "alone", "text"), "g", count_of, "kid long, n long").groupBy("kid").agg(F.sum("n").alias("n"))

    named = kinds.join(component.withColumnRenamed("id", "kid"), "kid", "left").withColumn("component", F.coalesce("component", "kid"))
    classes = named.groupBy("component").agg(F.min("doc").alias("class_id"))
    result = saved(named.join(classes, "component").join(counted, "kid", "left").select("kid", "component", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0).cast("long"))).alias("n_links")), "classes")
    out = rows.select("doc_id", "row", "kid").join(result, "kid", "left")
    return out.select("doc_id", "row", "component", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, **join: float) -> DataFrame:
    """One row of each near-duplicate class, with the smallest doc_id (then the smallest hash of its text); all rows without words or with a null doc_id stay.

    Of rows that agree in doc_id and text one stays, whatever their other columns are. Rows that share a doc_id but no text are told apart. Columns may have
    any names. An empty table stays empty."""
    rows = saved(classes_of(docs, **join).filter("component is not null").select("component", "doc_id", "row"), "class-rows")
    groups = rows.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = saved(rows.join(groups, "component").select("doc_id", "row", (F.struct("doc_id", "row") == F.col("first")).alias("is_first")), "shared")
    gone = small(named_keys(saved(shared.filter("not is_first").select("doc_id", "row").distinct(), "gone")))
    twins = named_keys(saved(shared.filter("is_first").groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row"), "twins"))
    own = keyed(docs, docs["doc_id"].cast("long"), row_key(docs))
    kept = own.join(gone, same_keys(own, gone), "left_anti")
    if twins.isEmpty():
        return kept.select("row_.*")
    twins = small(twins)
    once = own.join(twins, same_keys(own, twins), "left_semi").groupBy("k0_", "k1_").agg(F.first("row_").alias("row_"))
    return kept.join(twins, same_keys(own, twins), "left_anti").select("row_.*").unionByName(once.select("row_.*"))
