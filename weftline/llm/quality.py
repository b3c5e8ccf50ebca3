"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Per class the counts, means and second moments of the statistics are summed by Spark over all labelled rows, so
nothing is sampled and the driver holds two small matrices. Scores are differences of Mahalanobis log-densities,
computed from Cholesky factors that are made once and sent with the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import saved

FEATURES = (
    "log_words", "word_length", "upper", "shout", "symbol", "bar", "digit", "stop", "comma", "newline",
    "log_distinct", "repeat_next", "top_word", "ends_odd", "space", "short_words",
)
#: Weight of the pooled covariance and of its diagonal in each class covariance.
POOLED, DIAGONAL = 0.1, 0.05
THRESHOLD = 0.3
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#$%&*+<=>@\\^_`{}~[]", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, already transformed (logs and square roots of shares) so that they are closer to normal."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size, letters = float(count.sum()), float(count[_UPPER].sum() + count[_LOWER].sum()) + 1
    share = Counter(words)
    distinct = len(share)
    same = sum(map(str.__eq__, words, words[1:]))
    odd = sum(1 for w in words if w[-1] in "*%&$#!|")
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(n)), float(np.log(len(text) / n)), root(count[_UPPER].sum() / letters), root(count[33] / n), root(count[_SYMBOL].sum() / n), root(count[124] / n),
        root(count[_DIGIT].sum() / size), root(count[46] / n), root(count[44] / n), root(count[10] / n), float(np.log1p(distinct) / np.log1p(n)),
        root(same / n), root(share.most_common(1)[0][1] / n), root(odd / n), root((count[32] + count[9]) / n), root(sum(1 for w in words if len(w) < 4) / n),
    ]


def with_statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The key columns and ``x``, the array of statistics of the whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(x, pa.list_(pa.float64()))], [*keys, "x"])

    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(measure, ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "x array<double>"]))


class Discriminant:
    """Two normal densities with shrunk covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = POOLED, diagonal: float = DIAGONAL):
        d = len(FEATURES)
        total = sum(m[0] for m in moments.values())
        spread = {k: s2 / n - np.outer(s / n, s / n) for k, (n, s, s2) in moments.items()}
        common = sum((moments[k][0] / total * spread[k] for k in moments), np.zeros((d, d)))
        self.classes = {}
        for k, (n, s, _) in moments.items():
            cov = (1 - pooled) * spread[k] + pooled * common
            cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.classes[k] = (s / n, np.linalg.inv(factor), float(np.log(n / total) - np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; without two classes, the share of class 1 among the labels (1 without labels)."""
        if len(self.classes) < 2:
            return np.full(len(x), float(min(self.classes, default=1)))
        log = {k: c - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for k, (mean, inverse, c) in self.classes.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))


def fit(labelled: DataFrame, **shrinkage: float) -> Discriminant:
    """From rows (x, label 0 or 1): one distributed pass that sums moments."""
    d = len(FEATURES)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for b in batches:
            label = b.column("label").to_numpy(zero_copy_only=False)
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, d)
            for k, into in sums.items():
                own = x[label == k]
                into += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([list(sums[0]), list(sums[1])], pa.list_(pa.float64()))], ["label", "m"])

    parts = labelled.filter("label in (0, 1)").select("x", F.col("label").cast("int").alias("label")).mapInArrow(add_up, "label int, m array<double>")
    total = parts.select("label", F.posexplode("m").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
    m = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in total.collect():  # 2 * (1 + d + d * d) numbers, whatever the input
        m[r[0]][r[1]] = r[2]
    return Discriminant({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in m.items() if v[0]}, **shrinkage)


def held_out(doc_id: Column) -> Column:
    """Rows that never serve for learning: crc32 of the id as text is divisible by five (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant]:
    """The saved statistics (doc_id, x) of all rows, and the model of those with a label that may serve."""
    x = saved(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).filter(~held_out(F.col("doc_id")))
    return x, fit(x.join(known, "doc_id"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold; rows are judged where they are read, without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels)[1])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column("text")], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.value.score(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null text is scored as an empty one, whose statistics are all zero. Labels that are null or neither 0 nor 1 are left
    out, as are those of held-out ids; repeated labels count as often as they occur. Without labels of both classes every row
    gets the one class that there is (1 if there is none). Other columns are ignored; an empty table gives no rows.
    """
    x, fitted = learn(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.value.score(np.array(b.column("x").to_pylist(), float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "x").mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
