"""From parsed column mappings to graph records and to the table of hops that is served."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.plans.durable import saved

EXPR_LIMIT = 2000
PARSER = "weftline_1"


def _output(mapping: DataFrame) -> Column:
    table, column = F.col("output_table_fqn"), F.col("output_column")
    lost = F.concat(F.lit("col:out:"), "artifact_id", F.lit(":"), F.coalesce(column, F.lit("unknown")))
    return F.when(F.coalesce(table, F.lit("")) != "", refs.column_node(table, column)).otherwise(lost)


def _mapped(mappings: DataFrame) -> DataFrame:
    """``mappings`` with the nodes out_node and src_node, without columns that would feed themselves."""
    m = mappings.withColumn("expr", F.substring("expr", 1, EXPR_LIMIT)).withColumn("out_node", _output(mappings))
    src = F.when(F.col("source_fqn").isNotNull(), refs.column_node(F.col("source_fqn"), F.col("source_column"))).otherwise(F.concat(F.lit("col:unresolved:"), "artifact_id", F.lit(":"), F.coalesce("source_column", F.lit("unknown"))))
    return m.withColumn("src_node", src).filter("src_node != out_node")


def _derive_id(artifact: Column, out_node: Column, src_node: Column, expr: Column) -> Column:
    return refs.edge_id(F.lit("derive"), artifact, out_node, src_node, F.sha2(expr, 256))


def graph_of(mappings: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed artifacts.

    ``mappings``: artifact_id, output_column, output_table_fqn, source_fqn, source_column, source_ref, expr, expr_lang. ``reads``: artifact_id, table_fqn.
    Nodes are transformations, read tables and columns; edges lead from tables and columns to the transformation that reads them and from it to the columns
    that it makes. A column that would feed itself is left out. The id of a derived edge depends on its ends and on the expression."""
    m = _mapped(mappings).withColumn("category", refs.category(F.col("expr"))).withColumn("xfm", F.concat(F.lit("xfm:"), "artifact_id"))
    about = F.to_json(F.struct("source_ref", F.col("src_node").alias("src_node_id"), F.col("category").alias("transform_category"), "expr", "expr_lang"))
    derive = m.select(_derive_id(F.col("artifact_id"), F.col("out_node"), F.col("src_node"), F.col("expr")).alias("edge_id"), F.col("xfm").alias("src_id"), F.col("out_node").alias("dst_id"), F.lit("derive").alias("edge_type"), "artifact_id", about.alias("meta_json"))
    xfm = F.concat(F.lit("xfm:"), "artifact_id")
    table = F.concat(F.lit("tbl:"), "table_fqn")
    from_tables = reads.select(refs.edge_id(F.lit("read"), table, xfm).alias("edge_id"), table.alias("src_id"), xfm.alias("dst_id"), F.lit("read").alias("edge_type"), "artifact_id", F.lit(None).cast("string").alias("meta_json"))
    from_columns = m.select(refs.edge_id(F.lit("read"), F.col("src_node"), F.col("xfm")).alias("edge_id"), F.col("src_node").alias("src_id"), F.col("xfm").alias("dst_id"), F.lit("read").alias("edge_type"), "artifact_id", F.lit(None).cast("string").alias("meta_json"))
    # an id begins with its edge's type, so no derived edge repeats a read
    derive, read = derive.dropDuplicates(["edge_id"]), from_tables.unionByName(from_columns).dropDuplicates(["edge_id"])
    edges = derive.withColumn("edge_type", F.lit("derive")).unionByName(read.withColumn("edge_type", F.lit("read")))  # set anew, so that who wants one type makes one

    none = F.lit(None).cast("string")
    transformations = mappings.select("artifact_id").unionByName(reads.select("artifact_id")).distinct().select(xfm.alias("node_id"), F.lit("transformation").alias("node_type"), F.col("artifact_id").alias("label"), none.alias("table_fqn"), none.alias("column_name"), "artifact_id", none.alias("meta_json"))
    tables = reads.groupBy("table_fqn").agg(F.min("artifact_id").alias("artifact_id")).select(table.alias("node_id"), F.lit("table").alias("node_type"), F.col("table_fqn").alias("label"), "table_fqn", none.alias("column_name"), "artifact_id", none.alias("meta_json"))
    # repeats go before texts are made of them: an output once an expression, a source once with its first artifact, as ``one_node_each`` would choose
    made = m.select("out_node", "output_column", "output_table_fqn", "artifact_id", "expr", "expr_lang").distinct()
    said = F.to_json(F.struct("expr", refs.category(F.col("expr")).alias("transform_category"), "expr_lang"))
    outs = made.select(F.col("out_node").alias("node_id"), F.lit("column").alias("node_type"), F.col("output_column").alias("label"), F.col("output_table_fqn").alias("table_fqn"), F.col("output_column").alias("column_name"), "artifact_id", said.alias("meta_json"))
    fed = m.groupBy("src_node", "source_column", "source_fqn").agg(F.min("artifact_id").alias("artifact_id"))
    ins = fed.select(F.col("src_node").alias("node_id"), F.lit("column").alias("node_type"), F.col("source_column").alias("label"), F.col("source_fqn").alias("table_fqn"), F.col("source_column").alias("column_name"), "artifact_id", none.alias("meta_json"))
    return one_node_each(transformations.unionByName(tables).unionByName(outs).unionByName(ins)), edges


def one_node_each(nodes: DataFrame) -> DataFrame:
    """One record per node id: one with metadata first, then by artifact and metadata."""
    order = Window.partitionBy("node_id").orderBy(F.col("meta_json").isNull(), "artifact_id", "meta_json")
    return nodes.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def edge_endpoints(nodes: DataFrame, edges: DataFrame, raw_code: DataFrame) -> DataFrame:
    """Hops: derived edges with both columns' tables and the source's path. The source column is taken from the edge's own metadata, so columns of one name in several tables give one hop each."""
    told = ("src_node_id", "expr", "expr_lang", "transform_category")
    d = edges.filter((F.col("edge_type") == "derive") & F.col("src_id").startswith("xfm:") & F.col("dst_id").startswith("col:"))
    d = d.select("edge_id", "artifact_id", F.col("dst_id").alias("dst_node_id"), F.json_tuple("meta_json", *told).alias(*told)).filter("src_node_id is not null")
    own = nodes.select("node_id", "table_fqn", "column_name")
    src = own.select(F.col("node_id").alias("src_node_id"), F.col("table_fqn").alias("src_fqn"), F.col("column_name").alias("src_col"))
    dst = own.select(F.col("node_id").alias("dst_node_id"), F.col("table_fqn").alias("dst_fqn"), F.col("column_name").alias("dst_col"))
    out = d.join(src, "src_node_id").join(dst, "dst_node_id").join(_paths(raw_code), "artifact_id", "left")
    return _hop(out)


def _hop(rows: DataFrame) -> DataFrame:
    names = ("src_node_id", "src_fqn", "src_col", "dst_node_id", "dst_fqn", "dst_col", "edge_id", "artifact_id", "source_path", "expr", "expr_lang")
    return rows.select(*names, F.when(F.col("expr_lang") == "sql", F.col("expr")).alias("expr_sql"), "transform_category")


def _paths(raw_code: DataFrame) -> DataFrame:
    return raw_code.groupBy(F.col("extraction_id").alias("artifact_id")).agg(F.min("source_path").alias("source_path"))


def endpoints_of(mappings: DataFrame, raw_code: DataFrame) -> DataFrame:
    """The hops that ``edge_endpoints`` finds in the graph of ``mappings``, read from these at once: each has both its ends, so nothing is looked up but the path.

    Repeats are told apart inside their artifact, by columns that are short; ids and categories are made after the only shuffle."""
    keys = ("artifact_id", "out_node", "src_node", "expr")
    rest = F.min(F.struct("source_fqn", "source_column", "output_table_fqn", "output_column", "expr_lang")).alias("m")
    own = ("artifact_id", "output_table_fqn", "output_column", "source_fqn", "source_column", "expr", "expr_lang")
    d = _mapped(mappings.select(*own).filter("artifact_id is not null").repartition("artifact_id")).groupBy(*keys).agg(rest).join(_paths(raw_code), "artifact_id", "left")
    named = (F.col("src_node").alias("src_node_id"), F.col("m.source_fqn").alias("src_fqn"), F.col("m.source_column").alias("src_col"), F.col("out_node").alias("dst_node_id"), F.col("m.output_table_fqn").alias("dst_fqn"), F.col("m.output_column").alias("dst_col"))
    ids = _derive_id(F.col("artifact_id"), F.col("out_node"), F.col("src_node"), F.col("expr")).alias("edge_id"), refs.category(F.col("expr")).alias("transform_category")
    return _hop(d.select(*named, "artifact_id", "source_path", "expr", F.col("m.expr_lang").alias("expr_lang"), *ids))


def pending_expressions(hops: DataFrame, cache: DataFrame) -> DataFrame:
    """(expr_sha, pyspark_expr): distinct PySpark expressions without SQL that no cache entry translates."""
    todo = hops.filter((F.col("expr_lang") == "pyspark") & F.col("expr_sql").isNull() & F.col("expr").isNotNull() & (F.length("expr") <= EXPR_LIMIT))
    todo = todo.select(F.sha2("expr", 256).alias("expr_sha"), F.col("expr").alias("pyspark_expr")).groupBy("expr_sha").agg(F.min("pyspark_expr").alias("pyspark_expr"))
    return todo.join(cache.select("expr_sha"), "expr_sha", "left_anti")


def enriched(hops: DataFrame, cache: DataFrame, translate: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hops, cache) after what is pending went through ``translate`` (a column function, so any function or UDF can serve) and back into expr_sql."""
    cache = cache.select("expr_sha", "pyspark_expr", "sql_expr")
    if translate is not None:
        hops = saved(hops, "hops")  # asked twice: for what is pending, and to be filled
        new = pending_expressions(hops, cache).withColumn("sql_expr", translate(F.col("pyspark_expr"))).filter("sql_expr is not null")
        cache = saved(cache.unionByName(new), "translated")  # its size is known then: few translations are broadcast, and hops of one expression do not meet in one task
    best = cache.groupBy(F.col("expr_sha").alias("_sha")).agg(F.min("sql_expr").alias("_sql"))
    joined = hops.join(best, (F.sha2("expr", 256) == F.col("_sha")) & (F.col("expr_lang") == "pyspark"), "left")
    return joined.withColumn("expr_sql", F.coalesce("expr_sql", "_sql")).drop("_sha", "_sql"), cache


def translated(hops: DataFrame, cache: DataFrame, setup: Callable[[], Callable[[list[str]], list[str | None]]], *, batch: int = 64, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """``enriched`` by a model that translates lists of expressions.

    ``setup`` makes the model once in each worker task that has work; expressions go to it ``batch`` at a time. A batch that fails is tried again, ``attempts`` times in all, then its
    expressions stay pending. What was translated is written once and is in the returned cache by its key, so a second run with it translates nothing."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for part in parts:
            model = model or setup()
            said: list[str | None] = []
            texts = part.column("pyspark_expr").to_pylist()
            for at in range(0, len(texts), batch):
                own, found = texts[at : at + batch], None
                for _ in range(attempts):
                    try:
                        found = model(own)
                        break
                    except Exception:  # noqa: BLE001, S112  whatever the model raises: the batch is tried again, then left pending
                        continue
                said += found if found is not None and len(found) == len(own) else [None] * len(own)
            yield pa.RecordBatch.from_arrays([part.column("expr_sha"), part.column("pyspark_expr"), pa.array(said, pa.string())], ["expr_sha", "pyspark_expr", "sql_expr"])

    kept = cache.select("expr_sha", "pyspark_expr", "sql_expr")
    new = saved(pending_expressions(hops, kept).mapInArrow(run, "expr_sha string, pyspark_expr string, sql_expr string").filter("sql_expr is not null"), "translated")
    return enriched(hops, kept.unionByName(new))


def changed(artifacts: DataFrame, versions: DataFrame, force: bool = False) -> DataFrame:
    """(extraction_id, token, is_new): artifacts whose source (or the parser) is not what was last recorded."""
    last = versions.groupBy("extraction_id").agg(F.max_by("content_sha256", F.struct("recorded_at", "content_sha256")).alias("last"))
    now = artifacts.select("extraction_id", refs.version_token(F.col("raw_source"), PARSER).alias("token"))
    return now.join(last, "extraction_id", "left").select("extraction_id", "token", (F.lit(force) | F.col("last").isNull() | (F.col("last") != F.col("token"))).alias("is_new"))


def latest_sha(versions: DataFrame) -> DataFrame:
    """The digest of each artifact's latest version; of versions of one time the greatest digest."""
    return versions.groupBy("extraction_id").agg(F.max_by("content_sha256", F.struct("recorded_at", "content_sha256")).alias("content_sha256"))


def version_hash(hops: DataFrame) -> DataFrame:
    """(pipeline_run_id, version_hash): changes with any edge of the run. Ids are hashed and added up per run, so no run's ids meet in one list."""
    one = F.conv(F.substring(F.sha2("edge_id", 256), 1, 12), 16, 10).cast("decimal(38,0)")
    d = hops.select("pipeline_run_id", "edge_id").distinct()
    return d.groupBy("pipeline_run_id").agg(F.sum(one).alias("s"), F.count(F.lit(1)).alias("n")).select("pipeline_run_id", F.substring(F.sha2(F.concat_ws("|", F.col("s").cast("string"), F.col("n").cast("string")), 256), 1, 32).alias("version_hash"))


def latest_run(hops: DataFrame, table: str | None = None) -> DataFrame:
    """One run: one that writes the table before one that only reads it, then the latest; without a table the latest of all."""
    rows = hops if table is None else hops.filter((F.col("src_fqn") == table) | (F.col("dst_fqn") == table))
    writes = F.lit(0) if table is None else F.max(F.when(F.col("dst_fqn") == table, 1).otherwise(0))
    runs = rows.groupBy("pipeline_run_id").agg(writes.alias("writes"), F.max("materialized_at").alias("materialized_at"))
    return runs.orderBy(F.desc("writes"), F.desc("materialized_at"), F.desc("pipeline_run_id")).limit(1)


def freshness(hops: DataFrame, table: str, as_of: str, stale_hours: int = 24) -> DataFrame:
    """One row: exists, edge_count, last_built, age, is_stale."""
    rows = hops.filter((F.col("src_fqn") == table) | (F.col("dst_fqn") == table))
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_built")
    one = rows.agg(F.count(F.lit(1)).alias("edge_count"), F.max("materialized_at").alias("last_built"))
    return one.select((F.col("edge_count") > 0).alias("exists"), "edge_count", "last_built", F.coalesce(refs.age_text(seconds), F.lit("Never")).alias("age"), F.coalesce(seconds > stale_hours * 3600, F.lit(True)).alias("is_stale"))


def reconciliation(system_rows: DataFrame, hops: DataFrame, run: str, as_of: str, days: int) -> DataFrame:
    """One row: column records of the window against parsed hops of a run."""
    a = system_rows.filter(refs.in_window(F.col("event_time"), F.lit(as_of), days)).agg(F.count(F.lit(1)).alias("system_lineage_row_count")).withColumn("_", F.lit(1))
    b = hops.filter(F.col("pipeline_run_id") == run).agg(F.count(F.lit(1)).alias("parsed_edge_count_run")).withColumn("_", F.lit(1))
    return a.join(b, "_").drop("_")


def pair_differences(system_edges: DataFrame, hops: DataFrame) -> DataFrame:
    """Column pairs that only one side knows (beyond the counts): found_in is system or parsed."""
    four = ["source_table_full_name", "source_column_name", "target_table_full_name", "target_column_name"]
    parsed = hops.select(F.col("src_fqn").alias(four[0]), F.col("src_col").alias(four[1]), F.col("dst_fqn").alias(four[2]), F.col("dst_col").alias(four[3])).distinct()
    system = system_edges.select(*four).distinct()
    return system.join(parsed, four, "left_anti").withColumn("found_in", F.lit("system")).unionByName(parsed.join(system, four, "left_anti").withColumn("found_in", F.lit("parsed")))
