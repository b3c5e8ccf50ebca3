"""The queries ``opN_<name>``: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.site_tree import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.recompression import with_kept_text

    return with_kept_text(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.suffix_dedup import with_kept_bytes

    return with_kept_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "selected")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.url_rules import judge_urls, url_labels

    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, url_labels(pages, table(spark, sf_dir, "labels")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.vector_codes import vector_codes, with_label_errors

    return with_label_errors(vector_codes(table(spark, sf_dir, "embeddings"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.hard_negatives import hard_negatives, with_moved_labels

    return hard_negatives(with_moved_labels(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_packing, op3_quality, op4_html, op5_exact_dedup, op6_substring_dedup, op7_suffix_dedup, op8_mixing, op9_embeddings, op10_url_rules, op11_warc, op12_vector_codes, op13_hard_negatives)}


#: DuckDB SQL over the same tables.
ORACLE = {
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
seen AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM win JOIN seen USING (g) WHERE first < doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op9_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
}

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(rounds: int = 4) -> str:
    """Lloyd rounds over four parts of 16 components, one common table expression each."""
    out = [
        f"WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_FINITE})",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, e[p * len(e) // 4 + 1:(p + 1) * len(e) // 4] AS x FROM v, range(4) AS t(p))",
        "c0 AS MATERIALIZED (SELECT p, j, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j FROM parts) WHERE j < 256)",
    ]
    for k in range(rounds + 1):
        distance = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        out.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(label) AS label, any_value(x) AS x, min({{'d': {distance}, 'j': j}}) AS m FROM parts JOIN c{k} USING (p) GROUP BY vec_id, p)")
        if k < rounds:
            sums = f"SELECT p, m.j AS j, i, floor(sum(x[i]) / count(*)) AS f FROM a{k}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i) GROUP BY ALL"
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT p, j, coalesce(n, c) AS c FROM c{k} LEFT JOIN (SELECT p, j, list(f ORDER BY i) AS n FROM ({sums}) GROUP BY ALL) USING (p, j))")
    out.append(f"h AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, j, i)) AS codebooks_sha256 FROM c{rounds}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i))")
    out.append(f"r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    return ",\n".join(out) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"


ORACLE |= {
    "op11_warc": """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN nullif(min(page_id) OVER (PARTITION BY payload_digest), page_id) END AS refers_to FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM f""",
    "op12_vector_codes": _codes_sql(),
    "op13_hard_negatives": f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM pos p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s QUALIFY rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
