"""Hard negatives: vantage-point trees over norm-augmented vectors.

With M the largest norm, x becomes (x, sqrt(M^2 - |x|^2)); for a query (q, 0) the squared distance is |q|^2 + M^2 - 2 q.x, so a
higher score is a smaller distance and a window of scores is an annulus. The top of the tree is fitted on a bounded
sample; every row goes down it to a leaf, and leaves are dealt into shards of bounded size, each with a tree of its own. A
search visits its most promising leaf first, and then only leaves that can hold something better. Inside a shard nodes are
expanded nearest first within the annulus, and rows come out in order of their scores, until k have the label asked for.
Trees only save work: scores are exact integers and bounds keep a margin, so the rows found are those of a full scan.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import saved
from weftline.llm.vector_codes import bound_of, integers, matrix

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: The window: low * positive <= out_of * negative <= high * positive.
LOW, HIGH, OUT_OF = 30, 90, 100
#: Rows that the top of the tree is fitted on, its leaves at most, bytes of a shard's vectors, rows of a shard's leaf.
SAMPLE_ROWS, TOP_LEAVES, SHARD_BYTES, LEAF_ROWS = 5_000, 1024, 8 << 20, 256
_FAR = 1 << 62


class Tree:
    """A vantage-point tree over augmented points.

    Per inner node: its vantage, two children, and for each child the range of distances to this vantage and to those above it. A tree that is
    not ``tight`` holds for rows beyond those it was grown on: a side is all that lies within the middle distance, or beyond it."""

    def __init__(self, points: np.ndarray, leaf_rows: int, tight: bool = True) -> None:
        self.vantage, self.child, self.path, self.range, self.leaves = [], [], [], [], []
        self.root = self._grow(points, np.arange(len(points)), leaf_rows, tight, [])
        self.vantage = np.array(self.vantage).reshape(-1, points.shape[1])
        self.child = np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, points: np.ndarray, own: np.ndarray, leaf_rows: int, tight: bool, above: list[int]) -> int:
        at = points[own]
        if len(own) > leaf_rows:
            vantage = at[((at - at.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            d = np.sqrt(((at - vantage) ** 2).sum(axis=1))
            order = np.argsort(d, kind="stable")
            half = len(own) // 2
            middle = d[order[half - 1]]
            half = half if tight else int(np.searchsorted(d[order], middle, "right"))
        if len(own) <= leaf_rows or half == len(own):
            self.leaves.append(own)
            return -len(self.leaves)
        node, sides = len(self.vantage), (order[:half], order[half:])
        self.vantage.append(vantage)
        self.child.append([0, 0])
        path = [*above, node] if tight else [node]
        away = [d if v == node else np.sqrt(((at - self.vantage[v]) ** 2).sum(axis=1)) for v in path]
        self.path.append(np.array(path))
        self.range.append(np.array([[(x[o].min(), x[o].max()) for x in away] for o in sides] if tight else [[(0.0, middle)], [(middle, np.inf)]]))
        self.child[node] = [self._grow(points, own[o], leaf_rows, tight, path) for o in sides]
        return node

    def within(self, node: int, side: int, d: np.ndarray, low: float, high: float) -> tuple[float, float]:
        """Least and greatest distance of a query to one side of a node, from its distances ``d`` to all vantage points."""
        own, r = d[self.path[node]], self.range[node][side]
        return max(low, float((own - r[:, 1]).max()), float((r[:, 0] - own).max())), min(high, float((own + r[:, 1]).min()))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point goes down to."""
        out = np.full(len(points), self.root)
        while (inner := np.flatnonzero(out >= 0)).size:
            node = out[inner]
            d = np.sqrt(((points[inner] - self.vantage[node]) ** 2).sum(axis=1))
            middle = np.array([r[0, 0, 1] for r in self.range])
            out[inner] = self.child[node, (d > middle[node]).astype(int)]
        return -out - 1

    def leaf_bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance from ``q`` to anything in each leaf."""
        low, high = np.zeros(len(self.leaves)), np.full(len(self.leaves), np.inf)
        d = np.sqrt(((self.vantage - q) ** 2).sum(axis=1))
        stack = [(self.root, 0.0, np.inf)]
        while stack:
            node, a, b = stack.pop()
            if node < 0:
                low[-node - 1], high[-node - 1] = a, b
                continue
            stack += [(int(self.child[node, side]), *self.within(node, side, d, a, b)) for side in (0, 1)]
        return low, high


def scores_between(low: np.ndarray, high: np.ndarray, qq: float, mm: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score at distances from ``low`` to ``high``, with a margin for rounding."""
    spare = 1 + 1e-9 * (qq + mm)
    return (qq + mm - high * high) / 2 - spare, (qq + mm - low * low) / 2 + spare


def augmented(x: np.ndarray, mm: int) -> np.ndarray:
    """Rows with the component that gives all of them the norm sqrt(mm)."""
    f = x.astype(float)
    return np.concatenate([f, np.sqrt(np.maximum(0.0, mm - (f * f).sum(axis=1)))[:, None]], axis=1)


class Shard:
    """The rows of one shard and the tree over them."""

    def __init__(self, rid: np.ndarray, ids: np.ndarray, label: list, x: np.ndarray, mm: int, leaf_rows: int = LEAF_ROWS) -> None:
        self.mm, self.tree = float(mm), Tree(augmented(x, mm), leaf_rows)
        order = np.concatenate(self.tree.leaves)
        self.cut = np.cumsum([0, *map(len, self.tree.leaves)])
        self.rid, self.ids = rid[order], ids[order]
        names = {v: i for i, v in enumerate(dict.fromkeys(label))}
        self.names, self.label = names, np.array([names[v] for v in label])[order]
        # no sum of products exceeds mm, so below 2**53 doubles are exact
        self.x = x[order].astype(float) if mm < 1 << 53 else x[order]

    def ask(self, rid: int, label: object, q: np.ndarray) -> None:
        """Begin the searches of one anchor: distances to all vantage points and the ranked rows of leaves serve all its windows."""
        self.own, self.q, self.qq = rid, q.astype(self.x.dtype), float((q.astype(float) ** 2).sum())
        self.same = self.label == self.names.get(label, -1)
        self.d = np.sqrt(((self.tree.vantage - np.append(q.astype(float), 0.0)) ** 2).sum(axis=1))
        self.ranked: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def leaf(self, node: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(negated scores, positions) of a leaf's rows with an equal, or a different, label, in the order of results."""
        if (node, same) not in self.ranked:
            start, end = self.cut[-node - 1], self.cut[-node]
            at = np.flatnonzero((self.same[start:end] == same) & (self.rid[start:end] != self.own)) + start
            s = -(self.x[start:end] @ self.q)[at - start]
            order = np.lexsort((self.rid[at], self.ids[at], s))
            self.ranked[node, same] = s[order], at[order]
        return self.ranked[node, same]

    def nearest(self, same: bool, lo: int, hi: int, k: int) -> list[tuple[int, int, int]]:
        """The first ``k`` (score, vec_id, row) with lo <= score <= hi and an equal, or a different, label: nodes and the next row of each open leaf wait in one queue by score."""
        total, spare, tree = self.qq + self.mm, 1 + 1e-9 * (self.qq + self.mm), self.tree
        queue: list[tuple] = [(-float("inf"), 0, tree.root, 0.0, float("inf"))]
        out: list[tuple[int, int, int]] = []

        def wait(node: int, i: int) -> None:
            s, at = self.leaf(node, same)
            if i < len(s) and s[i] <= -lo:
                heapq.heappush(queue, (s[i], 1, int(self.ids[at[i]]), int(self.rid[at[i]]), node, i))

        while queue and len(out) < k:
            item = heapq.heappop(queue)
            if item[1]:
                out.append((-int(item[0]), item[2], item[3]))
                wait(item[4], item[5] + 1)
                continue
            node, a, b = item[2:]
            if node < 0:
                wait(node, int(np.searchsorted(self.leaf(node, same)[0], -hi)))
                continue
            for side in (0, 1):
                low, high = tree.within(node, side, self.d, a, b)
                most = (total - low * low) / 2 + spare
                if most >= lo and (total - high * high) / 2 - spare <= hi:
                    heapq.heappush(queue, (-most, 0, int(tree.child[node, side]), low, high))
        return out


def routed(searches: DataFrame, tree: Tree, mm: int, pieces: np.ndarray, first: bool) -> DataFrame:
    """``searches`` with ``shard``, a row for each to visit: of the most promising leaf if ``first``, else of all other leaves that can hold a score of ``lo`` or more."""
    begins = np.concatenate([[0], np.cumsum(pieces)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, shard = [], []
            bounds: dict[bytes, tuple] = {}
            for i, (v, lo, hi, floor) in enumerate(zip(b.column("vector").to_pylist(), b.column("lo").to_pylist(), b.column("hi").to_pylist(), b.column("floor").to_pylist(), strict=True)):
                if v not in bounds:
                    q = np.frombuffer(v, "<i8").astype(float)
                    bounds = {v: scores_between(*tree.leaf_bounds(np.append(q, 0.0)), float((q * q).sum()), float(mm))}
                least, most = bounds[v]
                fit = (most >= lo) & (least <= hi) & (pieces > 0)
                if not fit.any():
                    continue
                best = int(np.where(fit, most, -np.inf).argmax())
                for leaf in [best] if first else np.flatnonzero(fit & (most >= floor)).tolist():
                    if first or leaf != best:
                        take += [i] * int(pieces[leaf])
                        shard += range(int(begins[leaf]), int(begins[leaf + 1]))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(take, pa.int64())).columns, pa.array(shard, pa.int64())], [*b.schema.names, "shard"])

    return searches.mapInArrow(run, searches.withColumn("shard", F.lit(0).cast("long")).schema)


def visited(shards: DataFrame, searches: DataFrame, mm: int, same: bool, k: int) -> DataFrame:
    """(rid, lo, hi, score, vec_id, row): what each shard has for each search that visits it. A task holds one shard's rows; searches stream by."""
    both = shards.select("shard", F.lit(0).alias("kind"), "rid", "vec_id", "label", "vector", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("floor"))
    both = both.unionByName(searches.select("shard", F.lit(1).alias("kind"), "rid", F.lit(0).cast("long").alias("vec_id"), "label", "vector", "lo", "hi", "floor"))

    leaf_rows = LEAF_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard, asked = None, [], None, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("shard", "kind", "rid", "vec_id", "label", "vector", "lo", "hi", "floor")}
            out = []
            for s, kind, rid, vec_id, label, vector, lo, hi, floor in zip(*cols.values(), strict=True):
                if s != at:
                    at, held, shard, asked = s, [], None, None
                if kind == 0:
                    held.append((rid, vec_id, label, vector))
                    continue
                if shard is None:
                    if not held:
                        continue
                    r, v, names, data = zip(*held, strict=True)
                    held = []
                    shard = Shard(np.array(r), np.array(v), list(names), np.frombuffer(b"".join(data), "<i8").reshape(len(r), -1), mm, leaf_rows)
                if asked != rid:
                    shard.ask(rid, label, np.frombuffer(vector, "<i8"))
                    asked = rid
                out += [(rid, lo, hi, *found) for found in shard.nearest(same, max(lo, floor), hi, k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 6)], ["rid", "lo", "hi", "score", "vec_id", "row"])

    return both.repartition("shard").sortWithinPartitions("shard", "kind", "rid", "hi").mapInArrow(run, "rid long, lo long, hi long, score long, vec_id long, row long")


def best(found: DataFrame, k: int) -> DataFrame:
    """``found`` with ``rank``, the first ``k`` of each search."""
    by = Window.partitionBy("rid", "lo", "hi").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def searched(shards: DataFrame, searches: DataFrame, tree: Tree, mm: int, pieces: np.ndarray, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of every search (rid, label, vector, lo, hi), in two visits: the second asks only leaves that may beat what the first found."""
    begun = searches.withColumn("floor", F.col("lo"))
    one = saved(best(visited(shards, routed(begun, tree, mm, pieces, True), mm, same, k), k), "visit")
    least = one.groupBy("rid", "lo", "hi").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    again = searches.join(least, ["rid", "lo", "hi"], "left").withColumn("floor", F.greatest("lo", F.coalesce("kth", "lo"))).drop("kth")
    two = visited(shards, routed(again.select(begun.columns), tree, mm, pieces, False), mm, same, k)
    return saved(best(one.drop("rank").unionByName(two), k), "found")


def hard_negatives(vectors: DataFrame, anchors: Column, *, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, out_of: int = OUT_OF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says, over vec_id, which rows are anchors. Rows with a null vec_id or label, a null vector or a null or non-finite component take no part.
    Short vectors are filled with zeros; integer components beyond ``bound_of`` the length become that bound. Ties go to the smaller vec_id; repeated
    rows are rows of their own, so a repeated anchor has its results twice and is its own twin's positive. An anchor without
    other rows of its label, or whose positive scores leave an empty window, has no rows. An empty table gives none. Other columns, of any names, are ignored."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), integers(F.col("embedding"), scale).alias("e")).filter("e is not null and vec_id is not null and label is not null")
    dim = max(1, rows.agg(F.max(F.size("e"))).first()[0] or 0)
    bound = bound_of(dim, 8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("e"), dim, bound)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array((x * x).sum(axis=1), pa.int64())], ["vec_id", "label", "vector", "norm"])

    kind = vectors.schema["label"].dataType.simpleString()
    points = saved(rows.mapInArrow(pack, f"vec_id long, label {kind}, vector binary, norm long").withColumn("rid", F.monotonically_increasing_id()), "points")
    n, mm = points.agg(F.count(F.lit(1)), F.max("norm")).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    per = max(LEAF_ROWS, SHARD_BYTES // (8 * dim))
    sample = [r[0] for r in points.orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE_ROWS).select("vector").collect()]
    fitted = np.frombuffer(b"".join(sample), "<i8").reshape(-1, dim)
    tree = Tree(augmented(fitted, mm), max(1, -(-len(fitted) // min(TOP_LEAVES, -(-n // per)))), tight=False)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("vector").to_pylist()), "<i8").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf_of(augmented(x, mm)), pa.int32())], [*b.schema.names, "leaf"])

    placed = saved(points.select("rid", "vec_id", "label", "vector").mapInArrow(down, f"rid long, vec_id long, label {kind}, vector binary, leaf int"), "placed")
    pieces = np.zeros(len(tree.leaves), np.int64)
    for leaf, rows_of in placed.groupBy("leaf").count().collect():
        pieces[leaf] = -(-rows_of // per)
    begins = F.array(*(F.lit(int(v)) for v in np.cumsum(pieces) - pieces))
    size = F.array(*(F.lit(int(v)) for v in np.maximum(1, pieces)))
    shards = placed.withColumn("shard", (F.get(begins, F.col("leaf")) + F.pmod(F.xxhash64("rid"), F.get(size, F.col("leaf")))).cast("long"))

    asked = saved(placed.filter(anchors).select("rid", "label", "vector", F.col("vec_id").alias("anchor_id")), "anchors")
    wide = asked.select("rid", "label", "vector", F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi"))
    found = searched(shards, wide, tree, mm, pieces, True, positives).select("rid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    window = found.withColumn("lo", F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, {out_of})) div {out_of})")).withColumn("hi", F.expr(f"({high} * positive_score - pmod({high} * positive_score, {out_of})) div {out_of}")).filter("lo <= hi")
    window = saved(window, "windows")
    narrow = window.select("rid", "lo", "hi").distinct().join(asked.select("rid", "label", "vector"), "rid").select("rid", "label", "vector", "lo", "hi")
    mined = searched(shards, narrow, tree, mm, pieces, False, negatives).select("rid", "lo", "hi", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = window.join(mined, ["rid", "lo", "hi"]).join(asked.select("rid", "anchor_id"), "rid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def with_moved_labels(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding with the label moved by one (modulo ten) where vec_id is divisible by seven."""
    return vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
