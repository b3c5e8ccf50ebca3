"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic); the cell weights are raked in turn to the target shares of each
margin until they agree. Every document then has the probability of its cell and is drawn by a hash of its id, so the
sample does not depend on order, partitions or repeats of a task. The cells are as many as there are combinations of
categories, and they stay in Spark.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftline.llm.common import keyed, named_keys, same_keys, saved, word_spans

MARGINS = ("source", "lang", "topic")
#: Target share of a category by default: its share of tokens to this power, which lifts small ones.
FLATTEN = 0.9
ROUNDS, ROUNDS_PER_JOB, TOLERANCE = 30, 5, 1e-6
#: Tokens of the sample as a share of all tokens.
SIZE = 0.7
TOPICS, SEED = 8, 97
NONE = "(none)"
#: Bytes to 64 classes: letters of either case 1 to 26, bytes of other letters 32 to 63, all else 0.
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = np.arange(1, 27)
_LETTER[128:] = 32 + np.arange(128) % 32


def measured(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """The columns of ``docs`` but its text as one struct ``row_``, n_tokens (words of the whole text) and topic.

    A topic is the nearest of ``topics`` fixed random directions to the shares of letter pairs in the text: an unsupervised stand-in
    for a topic model that puts like vocabulary together. A text without words has the topic ``t_``."""
    directions = np.random.default_rng(SEED).standard_normal((topics, 4096))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, topic = [], []
            for text in b.column("text_"):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                n = len(word_spans(data)[0])
                count.append(n)
                if n:
                    low = _LETTER[data]
                    pair = np.bincount(low[:-1] * 64 + low[1:], minlength=4096) if len(low) > 1 else np.zeros(4096)
                    share = np.sqrt(pair / max(1, pair.sum()))
                    topic.append(f"t{int(np.argmax(directions @ (share - 1 / 64)))}")
                else:
                    topic.append("t_")
            yield pa.RecordBatch.from_arrays([b.column("row_"), pa.array(count, pa.int64()), pa.array(topic, pa.string())], ["row_", "n_tokens", "topic"])

    keys = [c for c in docs.columns if c not in ("text", "n_tokens", "topic")]
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in keys)).alias("row_"), docs["text"].cast("string").alias("text_"))
    return rows.mapInArrow(measure, StructType([rows.schema["row_"], StructField("n_tokens", LongType()), StructField("topic", StringType())]))


def targets_of(cells: DataFrame, margin: str, given: Mapping[str, float] | None, flatten: float) -> DataFrame:
    """(margin, target): shares that sum to one over the categories that occur. ``given`` weights apply to the categories it names; others have their own share."""
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("w"))
    if given:
        pairs = F.create_map(*(F.lit(x) for k, v in given.items() for x in (k, float(v))))
        own = own.withColumn("w", F.coalesce(pairs[F.col(margin)], F.col("w") / F.sum("w").over(_all())))
    else:
        own = own.withColumn("w", F.pow(F.col("w"), flatten))
    return own.select(margin, (F.col("w") / F.sum("w").over(_all())).alias("target")).filter("target > 0")


def _all():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], size: float = SIZE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margins, tokens) with ``weighted``: shares of the sample's tokens whose sums agree with every target, as closely as the cells allow.

    No cell gives more tokens than it has (``most``): scarce ones are taken whole, and the raking spreads what they lack over the others. The
    table has a row per combination of categories, not per document, so it is kept in one partition, where its sums need no shuffles."""
    share = F.col("tokens") / F.sum("tokens").over(_all())
    now = cells.withColumn("weighted", share).withColumn("most", share / size)
    for m, t in targets.items():
        now = now.join(t.withColumnRenamed("target", f"target_{m}"), m)
    now = saved(now.coalesce(1), "raked").coalesce(1)
    off = 0.0
    for done in range(1, rounds + 1):
        worst = [f"_off_{m}" for m in targets]
        for m in targets:
            total = F.sum("weighted").over(_by(m))
            now = now.withColumn("_s", total).withColumn("weighted", F.when(F.col("_s") > 0, F.least("most", F.col("weighted") * F.col(f"target_{m}") / F.col("_s"))).otherwise(F.lit(0.0))).withColumn(f"_off_{m}", F.abs(F.col("_s") - F.col(f"target_{m}"))).drop("_s")
        if done % ROUNDS_PER_JOB and done < rounds:
            now = now.drop(*worst)
            continue
        now = saved(now, "raked").coalesce(1)
        off = now.agg(F.max(F.greatest(*worst))).first()[0] or 0.0
        now = now.drop(*worst)
        if off < tolerance:
            return now
    warnings.warn(f"after {rounds} rounds a margin is {off:.2g} off its target: the cells hold too few tokens for these targets and this size", stacklevel=2)
    return now


def _by(margin: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(margin)


def drawn(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: 53 bits of a 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix_sources(docs: DataFrame, *, targets: Mapping[str, Mapping[str, float]] | None = None, size: float = SIZE, flatten: float = FLATTEN, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` (without its text) with n_tokens, topic, probability and selected.

    Token shares of the sample agree in expectation with the targets of source, lang and topic as far as the tokens at hand allow: a
    cell that has too few is taken whole. The sample has about ``size`` of all tokens. A null source or lang is the
    category ``(none)`` for the targets and stays null in the result; a text without words weighs nothing and has its cell's probability (1 if the cell has no
    tokens). Rows with one doc_id are drawn alike, as are all with a null doc_id. Columns of ``docs`` named n_tokens, topic, probability
    or selected are replaced; others stay. An empty table gives no rows.
    """
    docs = docs.drop("probability", "selected")
    rows = saved(measured(docs), "measured")
    kind = {"source": F.col("row_.source"), "lang": F.col("row_.lang"), "topic": F.col("topic")}
    named = rows.select("row_", "n_tokens", "topic", *(F.coalesce(kind[m].cast("string"), F.lit(NONE)).alias(f"in_{m}") for m in MARGINS))
    cells = named.groupBy(*(F.col(f"in_{m}").alias(m) for m in MARGINS)).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    cells = saved(cells, "cells")
    raked = rake(cells, {m: targets_of(cells, m, (targets or {}).get(m), flatten) for m in MARGINS}, size)
    chance = raked.select(*(F.col(m).alias(f"in_{m}") for m in MARGINS), F.least(F.lit(1.0), F.col("weighted") / F.col("most")).alias("p_"))
    chance = saved(chance, "chances")
    out = named.join(chance, [f"in_{m}" for m in MARGINS], "left")
    p = F.coalesce("p_", F.when(F.col("n_tokens") > 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    return out.select("row_.*", "n_tokens", "topic", p.alias("probability"), (drawn(F.col("row_.doc_id"), seed) < p).alias("selected"))


def sampled(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that ``mix_sources`` selects, with all their columns, which may have any names.

    What is left out is found by id, source, language and a hash of id and text, which together decide about a row; texts are not shuffled. Null
    sources and languages are a category of their own, and rows that repeat are all kept or all left out. An empty table stays empty."""
    from weftline.llm.linking import small

    key = F.xxhash64(docs["doc_id"], docs["text"].cast("string"))
    slim = docs.select("doc_id", "source", "lang", "text", key.alias("key"))
    chosen = mix_sources(slim, **options)
    gone = small(named_keys(saved(chosen.filter("not selected").select("doc_id", "source", "lang", "key").distinct(), "left-out")))
    own = keyed(docs, docs["doc_id"], docs["source"], docs["lang"], key)
    return own.join(gone, same_keys(own, gone), "left_anti").select("row_.*")
