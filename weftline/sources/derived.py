"""Lineage inputs derived from the driver's tables, in SQL that Spark and DuckDB read alike.

The lineage graph is acyclic by construction: a block of 160 tables has 16 layers of ten, and a table's layer is later than the layers of those that it is made from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _fqn(k: str) -> str:
    return f"concat('cat', CAST(({k}) % 3 AS STRING), '.', CASE WHEN ({k}) % 160 < 40 THEN 'bronze' WHEN ({k}) % 160 < 80 THEN 'silver' WHEN ({k}) % 160 < 120 THEN 'gold' ELSE 'mart' END, '.t', CAST(({k}) AS STRING))"


# Every row counts. 120 part keys are the sources of a block of 160 tables and 25 entities; targets lie in the own or the next block, in a later layer
# of it. So tables and entities grow with the part keys, and no path has more than 16 tables.
_KEYS = """SELECT l_orderkey, b * 160 + p AS k0, b * 160 + p - p % 10 + 10 + l_suppkey % 39 + l_orderkey % 2 * 160 AS k1, b * 25 + l_suppkey % 25 AS e, l_linenumber, l_returnflag, l_suppkey, l_shipdate, l_quantity
 FROM (SELECT l.*, l_partkey % 120 AS p, CAST((l_partkey - l_partkey % 120) / 120 AS BIGINT) AS b FROM lineitem l) n"""

# Some jobs, pipelines, providers and uses are left out on purpose: what they should name then has no name, which is a case of its own.
#: View name -> SQL over the driver's tables and earlier views.
VIEWS: dict[str, str] = {
    "v_lineage": f"""SELECT CASE WHEN l_linenumber = 6 THEN NULL ELSE {_fqn("k0")} END AS source_table_full_name, {_fqn("k1")} AS target_table_full_name,
       CASE WHEN l_linenumber = 6 THEN concat(CASE WHEN k0 % 2 = 0 THEN 'dbfs:' ELSE '' END, '/Volumes/cat', CAST(k0 % 3 AS STRING), '/bronze/v', CAST(k0 % 7 AS STRING), '/f.csv') END AS source_path,
       CASE l_returnflag WHEN 'A' THEN 'JOB' WHEN 'R' THEN 'PIPELINE' END AS entity_type,
       CASE WHEN l_returnflag IN ('A', 'R') THEN CAST(e AS STRING) END AS entity_id,
       concat('u', CAST(l_suppkey % 5 AS STRING)) AS created_by, l_shipdate AS event_time
FROM ({_KEYS}) k""",
    "v_column_lineage": f"""SELECT {_fqn("k0")} AS source_table_full_name, concat('c', CAST(l_linenumber % 3 AS STRING)) AS source_column_name,
       {_fqn("k1")} AS target_table_full_name, concat('c', CAST((l_linenumber + 1) % 3 AS STRING)) AS target_column_name, l_shipdate AS event_time,
       CASE l_returnflag WHEN 'A' THEN 'JOB' WHEN 'R' THEN 'PIPELINE' ELSE 'NOTEBOOK' END AS entity_type, CAST(e AS STRING) AS entity_id,
       CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN concat('x', CAST(l_suppkey AS STRING)) ELSE CAST(l_orderkey AS STRING) END AS entity_run_id, CAST(l_shipdate AS DATE) AS event_date, 'w1' AS workspace_id
FROM ({_KEYS}) k WHERE l_linenumber <> 6""",
    "v_hops": """SELECT DISTINCT concat('col:', source_table_full_name, '::', source_column_name) AS src_node_id, source_table_full_name AS src_fqn, source_column_name AS src_col,
       concat('col:', target_table_full_name, '::', target_column_name) AS dst_node_id, target_table_full_name AS dst_fqn, target_column_name AS dst_col,
       concat('e_', source_table_full_name, '.', source_column_name, '>', target_table_full_name, '.', target_column_name) AS edge_id,
       CASE WHEN source_column_name = 'c0' THEN concat('sum(', source_column_name, ')') WHEN source_column_name = 'c1' THEN concat('cast(', source_column_name, ' as int)') ELSE source_column_name END AS expr,
       CASE WHEN source_column_name = 'c0' THEN 'aggregation' WHEN source_column_name = 'c1' THEN 'cast' ELSE 'projection' END AS transform_category
FROM v_column_lineage""",
    "v_usage": f"""SELECT CASE l_returnflag WHEN 'A' THEN 'P_JOBS_SERVERLESS_X' WHEN 'R' THEN 'DLT_CORE' ELSE 'ALL_PURPOSE' END AS sku_name, 'DBU' AS usage_unit,
       CAST(l_quantity AS DECIMAL(18,4)) AS usage_quantity, l_shipdate AS usage_start_time,
       CASE WHEN l_returnflag = 'A' THEN CAST(e AS STRING) END AS job_id, CASE WHEN l_returnflag = 'R' THEN CAST(e AS STRING) END AS dlt_pipeline_id
FROM ({_KEYS}) k""",
    "v_list_prices": """SELECT sku_name, 'DBU' AS usage_unit, CAST(p AS DECIMAL(18,4)) AS price, CAST(s AS TIMESTAMP) AS price_start_time, CAST(e AS TIMESTAMP) AS price_end_time FROM (VALUES
 ('P_JOBS_SERVERLESS_X', '0.35', '1990-01-01 00:00:00', '1996-01-01 00:00:00'), ('P_JOBS_SERVERLESS_X', '0.39', '1996-01-01 00:00:00', NULL),
 ('DLT_CORE', '0.20', '1990-01-01 00:00:00', '1995-07-01 00:00:00'), ('DLT_CORE', '0.25', '1995-07-01 00:00:00', NULL)) AS t(sku_name, p, s, e)""",
    "v_tables": f"""SELECT concat('cat', CAST(k % 3 AS STRING)) AS table_catalog, CASE WHEN k % 41 = 40 THEN 'information_schema' WHEN k % 160 < 40 THEN 'bronze' WHEN k % 160 < 80 THEN 'silver' WHEN k % 160 < 120 THEN 'gold' ELSE 'mart' END AS table_schema,
       CASE WHEN k % 37 = 36 THEN concat('event_log_', CAST(k AS STRING)) ELSE concat('t', CAST(k AS STRING)) END AS table_name,
       CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'VIEW' WHEN k % 5 = 2 THEN 'STREAMING_TABLE' WHEN k % 5 = 3 THEN 'FOREIGN' ELSE 'MANAGED' END AS table_type,
       concat('u', CAST(k % 4 AS STRING)) AS table_owner, p_name AS comment, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created, CAST('2024-02-01 00:00:00' AS TIMESTAMP) AS last_altered, {_fqn("k")} AS fqn
FROM (SELECT CAST(p_partkey AS INT) AS k, p_name FROM part) p""",
    "v_columns": """SELECT table_catalog, table_schema, table_name, concat('c', CAST(n AS STRING)) AS column_name, CASE n WHEN 0 THEN 'bigint' WHEN 1 THEN 'string' ELSE 'decimal' END AS data_type,
       CASE n WHEN 0 THEN 'bigint' WHEN 1 THEN 'string' ELSE 'decimal(18,2)' END AS full_data_type, CASE WHEN n = 0 THEN 'NO' ELSE 'YES' END AS is_nullable, n + 1 AS ordinal_position
FROM v_tables CROSS JOIN (VALUES (2), (0), (1)) AS c(n)""",
    "v_versions": """SELECT concat('ext_', CAST(o_custkey % 200 AS STRING)) AS extraction_id, concat('sha', CAST(o_orderkey % 7 AS STRING), '_', CAST(o_orderkey AS STRING)) AS content_sha256, o_orderdate AS recorded_at, o_orderkey AS seq FROM orders""",
    "v_run_hops": f"""SELECT concat('run', CAST(l_suppkey % 6 AS STRING)) AS pipeline_run_id, {_fqn("k0")} AS src_fqn, {_fqn("k1")} AS dst_fqn, concat('e_', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS edge_id, l_shipdate AS materialized_at FROM ({_KEYS}) k""",
    "v_table_shares": """SELECT table_catalog AS catalog_name, table_schema AS schema_name, table_name, concat('share', CAST(length(table_name) % 2 AS STRING), substr(table_name, 2, 1)) AS share_name,
       CASE WHEN table_type = 'VIEW' THEN 'public' END AS shared_as_schema, CASE WHEN table_owner = 'u1' THEN concat('x_', table_name) END AS shared_as_table FROM v_tables WHERE table_type IS NOT NULL""",
    "v_privileges": """SELECT concat('share', CAST(n_nationkey % 2 AS STRING), CAST(n_nationkey % 10 AS STRING)) AS share_name, n_name AS recipient_name, CASE WHEN n_nationkey % 6 = 5 THEN 'MODIFY' ELSE 'SELECT' END AS privilege_type FROM nation""",
    "v_providers": """SELECT r_name AS provider_name, CASE WHEN r_regionkey % 2 = 0 THEN 'aws' ELSE 'azure' END AS cloud, concat('reg', CAST(r_regionkey AS STRING)) AS region FROM region WHERE r_regionkey < 4""",
    "v_catalog_uses": """SELECT concat('cat', CAST(n_nationkey % 4 AS STRING)) AS catalog_name, CASE WHEN n_nationkey % 4 = 3 THEN 'GONE' ELSE r_name END AS provider_name, n_name AS share_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = n_nationkey % 4 OR n_nationkey % 4 = 3""",
    "v_jobs": f"""SELECT CAST(e AS STRING) AS job_id, concat('Job ', CAST(max(l_suppkey) AS STRING), ' of ', CAST(e AS STRING)) AS name, CASE WHEN e % 3 = 0 THEN NULL ELSE concat('run', CAST(e AS STRING)) END AS run_as_user_name, concat('made', CAST(e AS STRING)) AS creator_user_name FROM ({_KEYS}) k WHERE e % 25 < 20 GROUP BY e""",
    "v_pipelines": f"""SELECT CAST(e AS STRING) AS pipeline_id, concat('Pipeline ', CAST(e AS STRING)) AS name FROM ({_KEYS}) k WHERE e % 25 > 3 GROUP BY e""",
    "v_exprs": """SELECT p_partkey AS id, CASE p_partkey % 13 WHEN 0 THEN concat('sum(', p_brand, ')') WHEN 1 THEN 'row_number() OVER (partition by a)' WHEN 2 THEN 'CASE WHEN a > 1 THEN b END' WHEN 3 THEN 'coalesce(a, b)' WHEN 4 THEN 'cast(a as int)'
       WHEN 5 THEN 'a::bigint' WHEN 6 THEN 'upper(trim(a))' WHEN 7 THEN 'date_trunc(''month'', ts)' WHEN 8 THEN 'a * 2' WHEN 9 THEN 'o.amount' WHEN 10 THEN 'F.col("amount")' WHEN 11 THEN '' ELSE 'f(a)' END AS expr FROM part""",
}


def needs(name: str, seen: list[str] | None = None) -> list[str]:
    """The views that a view is made from, in order, with itself last."""
    seen = seen if seen is not None else []
    for other in VIEWS:
        if other != name and f"{other}" in VIEWS[name].replace(",", " ").replace(")", " ").split() and other not in seen:
            needs(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the Parquet tables of a folder."""
    base = ("lineitem", "part", "orders", "nation", "region", "supplier", "customer", "events")
    sql = VIEWS[name]
    frames: dict[str, DataFrame] = {}
    words = set(sql.replace(",", " ").replace("(", " ").replace(")", " ").split())
    for b in base:
        if b in words:
            frames[b] = spark.read.parquet(f"{sf_dir}/{b}.parquet")
    for v in VIEWS:
        if v != name and v in words:
            frames[v] = view(spark, sf_dir, v)
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(frames)})\b", r"\1 {\2}", sql) if frames else sql
    return spark.sql(text, **frames)


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB after common table expressions of the views; a recursive query keeps its keyword."""
    order: list[str] = []
    for n in names:
        needs(n, order)
    recursive = sql.lstrip().upper().startswith("WITH RECURSIVE")
    own = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    rest = sql.lstrip()
    if rest.upper().startswith("WITH"):
        rest = rest.split(None, 2)[2] if recursive else rest.split(None, 1)[1]
        return f"WITH {'RECURSIVE ' if recursive else ''}{own}, {rest}"
    return f"WITH {own} {rest}"
