"""URL filters: explicit host and path rules, then association rules mined from labelled URLs.

Spark's FP-growth finds the combinations of URL tokens that go with a label. Rules are pruned by support and
confidence and by shorter rules that say as much; a URL is matched through an inverted index that files every rule under its
rarest token, so it meets only rules that share a token with it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: Labelled URLs that a rule must stand on, however few there are.
MIN_URLS = 10
#: Mined rules that a task may hold. FP-growth at a minimum support s has at most 1/s frequent tokens a URL
#: position, so this is far above what the production support can give; beyond it the caller must raise the support.
RULES_BOUND = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels and their hyphenated parts, path segments and query names; plain numbers are left out."""
    host = F.transform(F.split(host_of(url), r"[.\-]"), lambda t: F.concat(F.lit("h:"), t))
    path = F.transform(F.split(F.translate(path_of(url), UPPER, LOWER), r"[/._\-]"), lambda t: F.concat(F.lit("p:"), t))
    query = F.transform(F.split(F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("")), "&"), lambda t: F.concat(F.lit("q:"), F.substring_index(t, "=", 1)))
    return F.array_distinct(F.filter(F.concat(host, path, query), lambda t: ~t.rlike(r"^.:[0-9]*$")))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits. Longest: host and path together; ties go to the smaller text."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), *(-ord(c) for c in r[1] + r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, verdict, confidence, support) of the rules that are left after pruning, from rows (url, verdict).

    Rows with a null url or verdict are left out. A rule holds for ``min_support`` of the rows and ``min_urls`` of them at least. A rule falls if one with fewer of its tokens has the same verdict and at least its confidence."""
    verdicts = ("allow", "block")
    rows = labelled.filter(F.col("url").isNotNull() & F.col("verdict").isin(*verdicts)).select(url_tokens(F.col("url")).alias("items"), "verdict").filter(F.size("items") > 0)
    rows = rows.select(F.concat("items", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    n = rows.count()
    if n < min_urls:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_urls / n)), minConfidence=min_confidence).fit(rows)
    aims = [f"={v}" for v in verdicts]
    said = model.associationRules.filter(F.col("consequent")[0].isin(*aims) & ~F.arrays_overlap("antecedent", F.array(*map(F.lit, aims))))
    found = said.select("antecedent", "consequent", "confidence", "support").limit(RULES_BOUND + 1).collect()
    if len(found) > RULES_BOUND:
        raise ValueError(f"over {RULES_BOUND} rules: raise min_support")
    best: dict[tuple[str, frozenset], float] = {}
    out = []
    for r in sorted(found, key=lambda r: (len(r[0]), sorted(r[0]))):
        tokens, verdict = frozenset(r[0]), r[1][0][1:]
        smaller = [tokens - {t} for t in tokens]
        covered = max((best.get((verdict, s), 0.0) for s in smaller), default=0.0)
        best[verdict, tokens] = max(covered, r[2])
        if covered < r[2]:
            out.append((tuple(sorted(tokens)), verdict, float(r[2]), float(r[3])))
    return out


def judge_urls(pages: DataFrame, labelled: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", **mining: float) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A null url, or one without ``://``, has an empty host and path, so no rule with a host fits it. Where no rule fits, the
    mined rule with the highest confidence (then support, then more tokens, then smaller tokens) decides; where none
    matches, ``default``. Repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    mined = mine_rules(labelled, **mining)
    seen: dict[str, int] = defaultdict(int)
    for tokens, *_ in mined:
        for t in tokens:
            seen[t] += 1
    index: dict[str, list[tuple[frozenset, tuple, str]]] = defaultdict(list)
    for tokens, verdict, confidence, support in mined:
        index[min(tokens, key=lambda t: (seen[t], t))].append((frozenset(tokens), (-confidence, -support, -len(tokens), tokens), verdict))
    index = dict(index)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tokens in b.column("tokens").to_pylist():
                own = set(tokens or ())
                out.append(min(((rank, verdict) for t in own for needs, rank, verdict in index.get(t, ()) if needs <= own), default=(None, default))[1])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], ["page_id", "host", "path", "rule", "verdict", "mined"])

    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(url_tokens(F.col("url")), F.array().cast("array<string>")).alias("tokens"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "tokens")
    if index:
        kind = pages.schema["page_id"].dataType.simpleString()
        rows = rows.mapInArrow(match, f"page_id {kind}, host string, path string, rule string, verdict string, mined string")
    else:
        rows = rows.withColumn("mined", F.lit(default))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined").alias("verdict"))


def url_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, verdict) of the pages whose article number (the last number of the path) has a label: low-quality and toxic documents are to be blocked."""
    numbered = pages.select("url", path_of(F.col("url")).alias("path")).select("url", F.expr("try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9/]*/?$', 1) as bigint)").alias("doc_id"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return numbered.join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(bad, "block").otherwise("allow").alias("verdict")), "doc_id").select("url", "verdict")
