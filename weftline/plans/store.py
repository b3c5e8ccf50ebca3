"""The lineage store: twelve tables, partitioned by run where they hold runs.

Tables are Parquet tables of the session's catalog. Rows are replaced by partition: the new files are written whole beside the old ones, which go only when
the job commits, so a write that fails leaves what was there. A job that is repeated after a lost driver leaves no rows twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.durable import new_folder, saved

# The tables' columns.
TABLES: dict[str, str] = {
    "lineage_raw_code": "pipeline_run_id string, extraction_id string, run_id bigint, job_id bigint, task_key string, source_kind string, source_path string, git_commit string, language string, content_sha256 string, raw_source string, normalized_cells_json string, extracted_at timestamp",
    "lineage_parse_metrics": "pipeline_run_id string, extraction_id string, language string, statements_parsed int, statements_skipped int, table_ref_count int, mapping_count int, warnings string, parsed_at timestamp",
    "lineage_nodes": "pipeline_run_id string, node_id string, node_type string, label string, table_fqn string, column_name string, artifact_id string, meta_json string, created_at timestamp",
    "lineage_edges": "pipeline_run_id string, edge_id string, src_id string, dst_id string, edge_type string, artifact_id string, meta_json string, created_at timestamp",
    "lineage_code_versions": "pipeline_run_id string, extraction_id string, content_sha256 string, is_new_version boolean, recorded_at timestamp",
    "lineage_extraction_reports": "pipeline_run_id string, report_json string, recorded_at timestamp",
    "lineage_graph_cache": "pipeline_run_id string, cache_key string, kpi_table_fqn string, graph_json string, version_hash string, materialized_at timestamp",
    "lineage_reconciliation": "pipeline_run_id string, system_lineage_row_count bigint, parsed_edge_count_run bigint, note string, recorded_at timestamp",
    "lineage_edge_endpoints": "pipeline_run_id string, src_node_id string, src_fqn string, src_col string, dst_node_id string, dst_fqn string, dst_col string, edge_id string, artifact_id string, source_path string, expr string, expr_lang string, expr_sql string, transform_category string, materialized_at timestamp",
    "lineage_pyspark_to_sql_cache": "expr_sha string, pyspark_expr string, sql_expr string, model string, translated_at timestamp",
    "lineage_sublineage_cache": "pipeline_run_id string, cache_key string, src_node_id string, dst_node_id string, mode string, hop_count int, path_count int, paths_json string, version_hash string, computed_at timestamp",
    "lineage_notebook_path_cache": "notebook_id string, nb_path string, resolved_at timestamp",
}
RUN = "pipeline_run_id"
#: What ``clear`` with scope ``all`` leaves: paths and translations are costly and never wrong.
KEPT = ("lineage_pyspark_to_sql_cache", "lineage_notebook_path_cache")
_FRESH = "1970-01-01"


class Store:
    """The tables in one schema of the session's catalog."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema = spark, schema

    def name(self, table: str) -> str:
        return f"`{self.schema}`.`{table}`"

    def ensure(self) -> None:
        """Create what is missing."""
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{self.schema}`")
        for table, columns in TABLES.items():
            by = f" PARTITIONED BY ({RUN})" if columns.startswith(RUN) else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING parquet{by}")

    def read(self, table: str, run: str | None = None) -> DataFrame:
        df = self.spark.table(self.name(table))
        return df if run is None else df.filter(F.col(RUN) == run)

    def _ready(self, table: str, rows: DataFrame, run: str | None) -> DataFrame:
        """Rows with the table's columns in the order that the table has them; what is missing is null."""
        if run is not None:
            rows = rows.withColumn(RUN, F.lit(run))
        fields = self.spark.table(self.name(table)).schema.fields
        return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

    def append(self, table: str, rows: DataFrame, run: str | None = None) -> None:
        self._ready(table, rows, run).write.mode("append").insertInto(self.name(table))

    def _swap(self, table: str, rows: DataFrame) -> bool:
        """Replace the runs that occur in ``rows``, and say whether there are any; no other run is touched.

        Only partitions with new rows are overwritten, which is a session's setting: a session of its own has it, so that the caller's keeps its own."""
        path = new_folder(self.spark, table)
        rows.write.parquet(path)
        own = self.spark.newSession()
        own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        ready = own.read.schema(rows.schema).parquet(path)
        if ready.isEmpty():
            return False
        ready.write.mode("overwrite").insertInto(self.name(table))
        self.spark.catalog.refreshTable(self.name(table))  # the caller's session has listed the files that are gone
        return True

    def _drop_run(self, table: str, run: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({RUN} = '{_quoted(run)}')")

    def replace_run(self, table: str, rows: DataFrame, run: str) -> None:
        """The run's rows anew, none if ``rows`` is empty; other runs stay."""
        if RUN not in TABLES[table]:
            raise ValueError(f"{table} holds no runs")
        if not self._swap(table, self._ready(table, rows, run)):
            self._drop_run(table, run)

    def keep_only(self, table: str, condition: Column) -> None:
        """Rewrite the runs of a table with the rows that meet a condition (null counts as not). Runs that lose no row stay as they are; of runs only the ids of those that lose all come to the driver."""
        if RUN not in TABLES[table]:
            raise ValueError(f"{table} holds no runs")
        now = self.spark.table(self.name(table))
        good = F.coalesce(condition, F.lit(False))
        changed = saved(now.groupBy(RUN).agg(F.count_if(~good).alias("lost"), F.count_if(good).alias("left")).filter("lost > 0"), "changed")
        self._swap(table, now.filter(good).join(changed.filter("left > 0").select(RUN), RUN, "left_semi").select(*now.columns))
        for row in changed.filter("left = 0").select(RUN).toLocalIterator():
            self._drop_run(table, row[0])

    def clear(self, scope: str, table_fqn: str | None = None) -> list[str]:
        """Forget cached results (``cache``), all about one table (``table``), or everything but KEPT (``all``). Returns the tables that were touched."""
        caches = ["lineage_graph_cache", "lineage_sublineage_cache"]
        if scope == "cache":
            for t in caches:
                self.spark.sql(f"TRUNCATE TABLE {self.name(t)}")
            return caches
        if scope == "all":
            gone = [t for t in TABLES if t not in KEPT]
            for t in gone:
                self.spark.sql(f"TRUNCATE TABLE {self.name(t)}")
            return gone
        if scope != "table" or not table_fqn:
            raise ValueError("scope is cache, table (with a table) or all")
        mine = lambda c: F.coalesce(F.col(c).startswith(f"col:{table_fqn}::") | (F.col(c) == f"tbl:{table_fqn}"), F.lit(False))
        self.keep_only("lineage_edge_endpoints", ~F.coalesce((F.col("src_fqn") == table_fqn), F.lit(False)) & ~F.coalesce((F.col("dst_fqn") == table_fqn), F.lit(False)))
        self.keep_only("lineage_nodes", ~F.coalesce(F.col("table_fqn") == table_fqn, F.lit(False)))
        self.keep_only("lineage_edges", ~mine("src_id") & ~mine("dst_id"))
        return ["lineage_edge_endpoints", "lineage_nodes", "lineage_edges"]


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")
