"""Catalog metadata, run discovery and name resolution.

Inputs are DataFrames with the columns of the catalog's own views (``tables``: table_catalog, table_schema, table_name, table_type, table_owner, comment,
created, last_altered; ``columns``: table_catalog, table_schema, table_name, column_name, data_type, full_data_type, is_nullable, ordinal_position).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import refs

# Statements that cannot have produced a table.
NOT_PRODUCING = (
    "SELECT", "USE", "SET", "SHOW", "DESCRIBE", "DROP", "ALTER", "GRANT", "REVOKE", "OPTIMIZE", "VACUUM", "ANALYZE", "EXPLAIN", "REFRESH", "COMMENT", "TRUNCATE", "DELETE", "UPDATE",
)
DEFINED_TYPES = ("VIEW", "MATERIALIZED_VIEW", "STREAMING_TABLE")
MATCHES_SHOWN = 12


def live_catalogs(spark: SparkSession) -> DataFrame:
    """Catalogs of the session itself, by the same rule as ``catalogs``."""
    return catalogs(spark.createDataFrame([(c.name,) for c in spark.catalog.listCatalogs()], "catalog string"))


def catalogs(names: DataFrame) -> DataFrame:
    """(catalog) without the system's own, sorted."""
    return names.select("catalog").filter(~F.col("catalog").isin(*refs.SYSTEM_CATALOGS)).distinct().orderBy("catalog")


def schemas(names: DataFrame) -> DataFrame:
    """(databaseName) without the system's own, sorted."""
    return names.select("databaseName").filter(~F.col("databaseName").isin(*refs.SYSTEM_SCHEMAS)).distinct().orderBy("databaseName")


def full_name() -> F.Column:
    return F.concat_ws(".", "table_catalog", "table_schema", "table_name")


def all_tables(tables: DataFrame) -> DataFrame:
    """Every table that people made, in order of catalog, schema and name; an unknown type is TABLE."""
    rows = tables.filter(refs.schema_filter(F.col("table_schema")) & refs.not_internal(F.col("table_name")))
    return rows.select("table_catalog", "table_schema", "table_name", full_name().alias("full_name"), F.coalesce("table_type", F.lit("TABLE")).alias("table_type")).orderBy("table_catalog", "table_schema", "table_name")


def columns_of(columns: DataFrame, table: str) -> DataFrame:
    """(name, type, nullable) of one table, in order."""
    rows = columns.filter(full_name() == table).orderBy("ordinal_position")
    return rows.select(F.col("column_name").alias("name"), F.col("data_type").alias("type"), (F.col("is_nullable") == "YES").alias("nullable"))


def columns_by_table(columns: DataFrame, nodes: DataFrame, *, full_types: bool = False) -> DataFrame:
    """(node, columns): the ordered columns of all wanted tables (node) at once."""
    kind = F.col("full_data_type" if full_types else "data_type")
    one = F.struct("ordinal_position", F.col("column_name").alias("name"), kind.alias("type"), (F.col("is_nullable") == "YES").alias("nullable"))
    rows = columns.withColumn("node", full_name()).join(nodes.select("node").distinct(), "node", "left_semi")
    own = rows.groupBy("node").agg(F.sort_array(F.collect_list(one)).alias("c"))  # a table's columns are few
    return own.select("node", F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["nullable"].alias("nullable"))).alias("columns"))


def catalog_stats(tables: DataFrame) -> DataFrame:
    rows = all_tables(tables)
    return rows.groupBy("table_catalog").agg(F.countDistinct("table_schema").alias("schemas"), F.count(F.lit(1)).alias("tables")).orderBy("table_catalog")


def schema_stats(tables: DataFrame, catalog: str) -> DataFrame:
    """(table_schema, tables): bronze, silver and gold first."""
    rank = F.when(F.lower("table_schema") == "bronze", 0).when(F.lower("table_schema") == "silver", 1).when(F.lower("table_schema") == "gold", 2).otherwise(3)
    return all_tables(tables).filter(F.col("table_catalog") == catalog).groupBy("table_schema").agg(F.count(F.lit(1)).alias("tables")).orderBy(rank, "table_schema")


def search_score(name: F.Column, full: F.Column, text: str) -> F.Column:
    q = text.strip().lower()
    low = F.lower(name)
    shorter = 1 - F.length(name) / 100
    return F.when(low == q, F.lit(1000.0)).when(low.startswith(q), 500 + shorter).when(low.contains(q), 200 + shorter).when(F.lower(full).contains(q), F.lit(100.0)).otherwise(F.lit(0.0))


def search(tables: DataFrame, text: str, limit: int | None = MATCHES_SHOWN) -> DataFrame:
    """(full_name, score) of matching tables, the best first, then by name; ``limit`` is the number of results to show."""
    rows = tables.select("full_name", search_score(F.col("table_name"), F.col("full_name"), text).alias("score")).filter("score > 0").orderBy(F.desc("score"), "full_name")
    return rows if limit is None else rows.limit(limit)


def match_count(tables: DataFrame, text: str) -> DataFrame:
    q = text.strip().lower()
    return tables.filter(F.lower("full_name").contains(q)).agg(F.count(F.lit(1)).alias("matches"))


def grid(rows: DataFrame, text: str, column: str, *, descending: bool = False) -> DataFrame:
    """Rows with the text in any string column, sorted as numbers where the column holds only numbers."""
    q = text.strip().lower()
    hit = F.lit(not q)
    for name, kind in rows.dtypes:
        if kind == "string":
            hit = hit | F.coalesce(F.lower(F.col(name)).contains(q), F.lit(False))
    number = F.col(column).try_cast("double")
    order = [F.desc(c) if descending else F.asc(c) for c in ("_n", column)]
    return rows.filter(hit).withColumn("_n", number).orderBy(*order).drop("_n")


def recent(index: DataFrame, visited: DataFrame, limit: int = 5) -> DataFrame:
    """Visited tables (full_name, position) that still exist, in their order."""
    return visited.join(index.select("full_name"), "full_name", "left_semi").orderBy("position").limit(limit)


# --- runs, notebooks, sources -------------------------------------------------------------------


def touches(tables: Sequence[str]) -> F.Column:
    """Source or target is one of the tables; false for none."""
    return F.coalesce(F.col("source_table_full_name").isin(*tables) | F.col("target_table_full_name").isin(*tables), F.lit(False)) if tables else F.lit(False)


def discover_runs(column_lineage: DataFrame, tables: Sequence[str], *, as_of: str, days: int, kinds: Sequence[str] = ("JOB", "NOTEBOOK", "PIPELINE")) -> DataFrame:
    """Distinct runs that touch the tables; the date column prunes partitions before the exact window is applied."""
    rows = column_lineage.filter(F.col("event_date") >= F.date_sub(F.to_date(F.lit(as_of)), days)).filter(refs.in_window(F.col("event_time"), F.lit(as_of), days))
    rows = rows.filter(F.col("entity_type").isin(*kinds) & F.col("entity_run_id").isNotNull()).filter(touches(tables))
    return rows.select("workspace_id", "entity_type", "entity_id", "entity_run_id", "source_table_full_name", "target_table_full_name", "source_column_name", "target_column_name", "event_time").distinct()


def numeric_run_ids(runs: DataFrame) -> DataFrame:
    return runs.select(F.col("entity_run_id").try_cast("bigint").alias("run_id")).filter("run_id is not null").distinct().orderBy("run_id")


def entities_of(runs: DataFrame, kind: str) -> DataFrame:
    return runs.filter((F.col("entity_type") == kind) & F.col("entity_id").isNotNull()).select("entity_id").distinct().orderBy("entity_id")


def notebook_paths(audit: DataFrame, wanted: DataFrame, *, as_of: str, days: int) -> DataFrame:
    """(notebook_id, nb_path): the latest path that the audit log has for each wanted id."""
    rows = audit.filter(F.col("event_date") >= F.date_sub(F.to_date(F.lit(as_of)), days))
    rows = rows.select(F.col("request_params")["notebookId"].alias("notebook_id"), F.col("request_params")["path"].alias("nb_path"), "event_time").filter("nb_path is not null")
    return rows.join(wanted.select("notebook_id").distinct(), "notebook_id", "left_semi").groupBy("notebook_id").agg(F.max_by("nb_path", F.struct("event_time", "nb_path")).alias("nb_path"))


def cached_paths(audit: DataFrame, wanted: DataFrame, cache: DataFrame, *, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(paths of all wanted ids, rows to add to the cache): only ids that the cache lacks are looked up."""
    hits = cache.join(wanted.select("notebook_id").distinct(), "notebook_id", "left_semi").groupBy("notebook_id").agg(F.max_by("nb_path", "resolved_at").alias("nb_path"))
    new = notebook_paths(audit, wanted.join(cache, "notebook_id", "left_anti"), as_of=as_of, days=days)
    return hits.unionByName(new), new.withColumn("resolved_at", F.lit(as_of).cast("timestamp"))


def language_of(path: F.Column) -> F.Column:
    """sql or python by the file's name; notebooks are Python; null for anything else."""
    low = F.lower(path)
    return F.when(low.endswith(".sql"), "sql").when(low.endswith(".py") | low.endswith(".ipynb") | low.contains("/notebooks/"), "python")


def task_sources(run_tasks: DataFrame) -> DataFrame:
    """(run_id, task_key, source_kind, source_path, language) from runs with an array of tasks (task_key, notebook_path, python_file, sql_file, git_url)."""
    t = run_tasks.select("run_id", F.explode("tasks").alias("t")).select("run_id", "t.*")
    path = F.coalesce("notebook_path", "python_file", "sql_file")
    kind = F.when(F.col("git_url").isNotNull(), "git").otherwise("workspace")
    what = F.when(F.col("notebook_path").isNotNull(), "notebook").when(F.col("python_file").isNotNull(), "python").otherwise("sql")
    rows = t.withColumn("source_path", path).filter("source_path is not null")
    return rows.select("run_id", "task_key", F.concat_ws("_", kind, what).alias("source_kind"), "source_path", F.when(what == "sql", "sql").when(what == "notebook", F.coalesce(language_of(F.col("source_path")), F.lit("python"))).otherwise(language_of(F.col("source_path"))).alias("language"))


def library_sources(pipelines: DataFrame) -> DataFrame:
    """(pipeline_id, source_kind, source_path, language) from pipelines with an array of libraries (notebook, file)."""
    lib = pipelines.select("pipeline_id", F.explode("libraries").alias("l")).select("pipeline_id", "l.notebook", "l.file").withColumn("source_path", F.coalesce("notebook", "file")).filter("source_path is not null")
    return lib.select("pipeline_id", F.when(F.col("notebook").isNotNull(), "pipeline_notebook").otherwise("pipeline_file").alias("source_kind"), "source_path", F.coalesce(language_of(F.col("source_path")), F.lit("python")).alias("language"))


def fetched(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources with raw_source from a table of files (path, content), which ``whole_files`` reads; what is not there is empty."""
    return sources.join(files.select(F.col("path").alias("source_path"), F.col("content").alias("raw_source")), "source_path", "left").na.fill("", ["raw_source"])


def whole_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of source files, each as one row."""
    return spark.read.option("wholetext", True).text(glob).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("path"), F.col("value").alias("content"))


def definitions(wanted: DataFrame, tables: DataFrame, ddl: DataFrame) -> DataFrame:
    """(full_name, raw_source, skip_reason): the DDL of wanted views and streaming tables; foreign tables and unreadable definitions say why they are skipped."""
    kinds = tables.select(full_name().alias("full_name"), "table_type")
    rows = wanted.select("full_name").distinct().join(kinds, "full_name").filter(F.col("table_type").isin(*DEFINED_TYPES, "FOREIGN")).join(ddl.select("full_name", "ddl"), "full_name", "left")
    why = F.when(F.col("table_type") == "FOREIGN", "external_source").when(F.col("ddl").isNull(), "definition_unreadable")
    return rows.select("full_name", F.when(why.isNull(), F.col("ddl")).alias("raw_source"), why.alias("skip_reason"))


def uncovered(wanted: DataFrame, covered: DataFrame, runs: DataFrame) -> DataFrame:
    """Wanted tables that neither a definition nor a discovered run explains."""
    done = covered.select("full_name").unionByName(runs.select(F.col("target_table_full_name").alias("full_name")))
    return wanted.select("full_name").distinct().join(done, "full_name", "left_anti")


def producing_queries(history: DataFrame, wanted: DataFrame, *, as_of: str, hours: int) -> DataFrame:
    """(full_name, n, statement_text, start_time): all finished statements that name a wanted table, numbered from the newest: the newest that parses to the table is its
    producer, however many that only name it came after it."""
    rows = history.filter((F.col("execution_status") == "FINISHED") & (F.col("start_time") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {max(24, hours)} HOURS")) & ~F.col("statement_type").isin(*NOT_PRODUCING))
    # a statement names a table by its parts, so the join is on words of the text, not on every pair
    words = rows.withColumn("_id", F.xxhash64("statement_text", "start_time")).withColumn("word", F.explode(F.array_distinct(F.split(F.lower("statement_text"), r"[^\w.]+"))))
    names = wanted.select("full_name", F.lower("full_name").alias("word")).unionByName(wanted.select("full_name", F.lower(F.substring_index("full_name", ".", -1)).alias("word"))).unionByName(wanted.select("full_name", F.lower(F.substring_index("full_name", ".", -2)).alias("word")))
    hit = words.join(names.distinct(), "word").select("full_name", "_id", "statement_text", "start_time").distinct()
    order = Window.partitionBy("full_name").orderBy(F.desc("start_time"), "statement_text")
    return hit.withColumn("n", F.row_number().over(order)).select("full_name", "n", "statement_text", "start_time")


def one_artifact_each(artifacts: DataFrame) -> DataFrame:
    """One artifact per extraction id: the first by priority, then by path."""
    order = Window.partitionBy("extraction_id").orderBy("priority", "source_path")
    return artifacts.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def entity_names(entities: DataFrame, jobs: DataFrame, pipelines: DataFrame, paths: DataFrame) -> DataFrame:
    """(entity_type, entity_id, name, owner). A notebook that is named by its path has the path's last part. Without a name, or with an id that could
    not be one, the name is the type and the first twelve characters of the id."""
    every = entities.select("entity_type", "entity_id").filter("entity_id is not null").distinct()
    j = jobs.select(F.lit("JOB").alias("entity_type"), F.col("job_id").alias("entity_id"), "name", F.coalesce("run_as_user_name", "creator_user_name").alias("owner"))
    p = pipelines.select(F.lit("PIPELINE").alias("entity_type"), F.col("pipeline_id").alias("entity_id"), "name", F.lit(None).cast("string").alias("owner"))
    n = paths.select(F.lit("NOTEBOOK").alias("entity_type"), F.col("notebook_id").alias("entity_id"), F.substring_index("nb_path", "/", -1).alias("name"), F.lit(None).cast("string").alias("owner"))
    known = j.unionByName(p).unionByName(n).groupBy("entity_type", "entity_id").agg(F.min("name").alias("name"), F.min("owner").alias("owner"))
    is_notebook = F.col("entity_type") == "NOTEBOOK"
    by_path = F.when(is_notebook & F.col("entity_id").contains("/"), F.substring_index("entity_id", "/", -1))
    fallback = F.concat_ws(" ", F.when(is_notebook, "Notebook").otherwise(F.col("entity_type")), F.substring("entity_id", 1, 12))
    safe = F.col("entity_id").rlike(r"^[A-Za-z0-9_./@ +\-]{1,512}$")
    name = F.coalesce(F.when(safe, F.coalesce(by_path, F.nullif("name", F.lit("")))), fallback)
    return every.join(known, ["entity_type", "entity_id"], "left").select("entity_type", "entity_id", name.alias("name"), F.when(safe, F.col("owner")).alias("owner"))


def diagnostics(spark: SparkSession, required: dict[str, DataFrame | None], optional: dict[str, DataFrame | None]) -> DataFrame:
    """(source, required, available, ok): which inputs can be read; ok is false on every row if a required one cannot."""
    rows = []
    for need, group in ((True, required), (False, optional)):
        for name, df in group.items():
            try:
                rows.append((name, need, df is not None and (df.limit(1).count() >= 0)))
            except Exception:  # noqa: BLE001  the probe's answer is that it fails
                rows.append((name, need, False))
    ok = all(seen for _, need, seen in rows if need)
    return spark.createDataFrame([(*r, ok) for r in rows], "source string, required boolean, available boolean, ok boolean")


def skip_report(skipped: DataFrame) -> DataFrame:
    return skipped.filter("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def extraction_report(tried: DataFrame) -> DataFrame:
    """(item, name, value) about artifacts that were tried (source_kind, skip_reason, error, seconds): how many were extracted, skipped and failed, the extracted ones by kind of source,
    skipped ones by reason, failed ones by error, and the seconds that each kind took. An artifact with both a reason and an error counts for both."""
    done = F.col("skip_reason").isNull() & F.col("error").isNull()
    none = F.lit(None).cast("string")
    sums = tried.agg(F.count_if(done).alias("artifacts_extracted"), F.count("skip_reason").alias("artifacts_skipped"), F.count("error").alias("artifacts_failed"))
    names = ("artifacts_extracted", "artifacts_skipped", "artifacts_failed")
    total = sums.select(F.inline(F.array(*(F.struct(F.lit(n).alias("item"), none.alias("name"), F.col(n).cast("double").alias("value")) for n in names))))

    def by(item: str, column: str, rows: DataFrame, value: F.Column) -> DataFrame:
        return rows.groupBy(F.col(column).alias("name")).agg(value.cast("double").alias("value")).select(F.lit(item).alias("item"), "name", "value")

    n = F.count(F.lit(1))
    parts = by("by_source_kind", "source_kind", tried.filter(done), n), by("skip_reasons", "skip_reason", tried.filter("skip_reason is not null"), n), by("errors", "error", tried.filter("error is not null"), n), by("timings", "source_kind", tried, F.sum("seconds"))
    for p in parts:
        total = total.unionByName(p)
    return total
