"""Settling open column sources: stars, bare names of several tables, temporary views, the frames of SQL texts.

Readers see one statement at a time and leave open what only the catalog or another cell knows. Here both are joined in Spark: each row of OPEN
becomes a use per relation that may be meant; uses of views are replaced by what the views are made from, in rounds, until none is left; stars
and bare names are then settled by the columns table. A round settles all views whose definitions use no unsettled one, so there are as many
rounds as views stand on one another; views that go round in a circle stay unsettled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.durable import saved, saved_with_count

OPEN = "artifact_id string, kind string, output_column string, position int, target string, is_view boolean, options array<struct<fqn:string,raw:string>>, fallback string, source_column string, source_ref string, expr string, expr_lang string, hidden array<string>"
COLUMNS = "table_fqn string, column_name string, ordinal_position int"
_ABOUT = ("kind", "output_column", "target", "is_view", "fallback", "source_ref", "expr", "expr_lang")


def _hides(hidden: Column, name: Column) -> Column:
    return F.array_contains(hidden, F.lower(name))


def positioned(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns without a name take that of the target's column at their position; where that is unknown they are left out."""
    at = columns.select(F.lower("table_fqn").alias("_t"), F.col("ordinal_position").alias("_p"), F.col("column_name").alias("_c")).dropDuplicates(["_t", "_p"])
    bare = rows.filter("output_column is null").join(at, (F.lower("target") == F.col("_t")) & (F.col("position") == F.col("_p"))).withColumn("output_column", F.col("_c")).select(rows.columns)
    return rows.filter("output_column is not null").unionByName(bare)


def uses_of(rows: DataFrame) -> DataFrame:
    """One use per relation that a row may mean: rid, artifact_id, about, opt, rel, raw (set if it may be a view), col, hidden, sure."""
    numbered = rows.withColumn("rid", F.monotonically_increasing_id().cast("string")).withColumn("about", F.struct(*_ABOUT))
    return numbered.select("rid", "artifact_id", "about", "hidden", F.col("source_column").alias("col"), F.posexplode_outer("options").alias("opt", "o"), F.lit(False).alias("sure")).select("rid", "artifact_id", "about", "hidden", "col", "opt", F.col("o.fqn").alias("rel"), F.col("o.raw").alias("raw"), "sure")


def substituted(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """``uses`` of settled views (their name in ``raw``) as uses of what the views are made from.

    A named column is what its definition is made from, else a column of what the view takes over whole; a star is every column of the view."""
    d = defs.select(F.col("artifact_id").alias("d_artifact"), F.lower("target").alias("d_view"), F.col("output_column").alias("d_name"), F.col("source_fqn").alias("d_rel"), F.col("source_column").alias("d_col"), F.col("star").alias("d_star"), F.col("void").alias("d_void"), F.col("hidden").alias("d_hidden"))
    here = (F.col("artifact_id") == F.col("d_artifact")) & (F.lower("raw") == F.col("d_view"))
    named, stars = uses.filter("about.kind = 'named'"), uses.filter("about.kind != 'named'")
    none, out = F.lit(None).cast("string"), uses.columns

    hit = named.join(d, here & ~F.col("d_star") & (F.lower("d_name") == F.lower("col")))
    exact = hit.withColumns({"rel": F.when(~F.col("d_void"), F.col("d_rel")), "col": F.when(~F.col("d_void"), F.col("d_col")), "raw": none, "sure": F.lit(True)}).select(out)
    known = d.filter(~F.col("d_star")).select("d_artifact", "d_view", F.lower("d_name").alias("d_low")).distinct()
    other = named.join(known, here & (F.lower("col") == F.col("d_low")), "left_anti")
    through = other.join(d, here & F.col("d_star") & ~_hides(F.col("d_hidden"), F.col("col")), "left").withColumns({"rel": F.col("d_rel"), "raw": none}).select(out)

    every = stars.join(d, here)
    own = every.filter(~F.col("d_star") & ~_hides(F.col("hidden"), F.col("d_name")))
    own = own.withColumns({
        "rid": F.concat_ws("/", "rid", "d_name"), "rel": F.when(~F.col("d_void"), F.col("d_rel")), "col": F.when(~F.col("d_void"), F.col("d_col")), "raw": none, "sure": F.lit(True),
        "about": F.col("about").withField("output_column", F.col("d_name")).withField("kind", F.lit("named")).withField("source_ref", F.col("d_name")),
    }).select(out)
    whole = every.filter("d_star").withColumns({"rid": F.concat_ws("/", "rid", "d_rel"), "rel": F.col("d_rel"), "raw": none, "hidden": F.array_union("hidden", "d_hidden")}).select(out)
    return exact.unionByName(through).unionByName(own).unionByName(whole)


def settled(uses: DataFrame, columns: DataFrame) -> DataFrame:
    """Uses of base tables as results: artifact_id, about's columns, source_fqn, source_column, star, void, hidden.

    Of several tables that may have a column the one that has it counts, by the columns table; else the only one that the columns table does not know; else the
    fallback. A star over a known table is a row per column; over another one it stays a star."""
    meta = columns.select(F.lower("table_fqn").alias("m_table"), F.col("column_name").alias("m_name"))
    tables, cells = meta.select("m_table").distinct().withColumn("m_known", F.lit(True)), meta.select(F.col("m_table").alias("c_table"), F.lower("m_name").alias("c_name")).distinct().withColumn("c_has", F.lit(True))
    uses = uses.withColumn("low", F.lower("rel"))
    named = uses.filter("about.kind = 'named'").join(tables, F.col("low") == F.col("m_table"), "left").join(cells, (F.col("low") == F.col("c_table")) & (F.lower("col") == F.col("c_name")), "left")
    rank = F.when(F.col("sure") | F.col("c_has"), 3).when(F.col("rel").isNull(), 0).when(F.col("m_known").isNull(), 2).otherwise(1)
    ranked = named.withColumn("rank", rank)
    best = ranked.groupBy("rid").agg(F.max("rank").alias("b_rank"), F.max("opt").alias("b_last")).withColumnRenamed("rid", "b_rid")
    top = ranked.join(best, (F.col("rid") == F.col("b_rid")) & (F.col("rank") == F.col("b_rank")))
    choice = top.groupBy("b_rid").agg(F.min("opt").alias("a_opt"), F.max("opt").alias("z_opt")).withColumnRenamed("b_rid", "z_rid")
    picked = top.join(choice, F.col("rid") == F.col("z_rid"))
    one = (F.col("b_rank") > 1) | (F.coalesce("b_last", F.lit(0)) == 0) & (F.col("b_rank") > 0)
    clear = one & F.col("a_opt").eqNullSafe(F.col("z_opt")) | F.col("sure") & F.col("rel").isNull()
    found = picked.select("artifact_id", "about.*", F.when(clear, F.col("rel")).otherwise(F.col("about.fallback")).alias("source_fqn"), F.col("col").alias("source_column"), F.lit(False).alias("star"), (F.col("rel").isNull() & F.col("col").isNull()).alias("void"), "hidden").distinct()

    stars = uses.filter("about.kind != 'named' and rel is not null")
    spread = stars.join(meta, F.col("low") == F.col("m_table")).filter(~_hides(F.col("hidden"), F.col("m_name")))
    aims = tables.select(F.col("m_table").alias("t_table"))
    aimed = spread.join(aims, F.lower("about.target") == F.col("t_table"), "left").join(cells, (F.lower("about.target") == F.col("c_table")) & (F.lower("m_name") == F.col("c_name")), "left")
    aimed = aimed.filter((F.col("about.kind") != "merge") | F.col("t_table").isNull() | F.col("c_has"))
    wide = aimed.select("artifact_id", F.col("about").withField("output_column", F.col("m_name")).withField("source_ref", F.col("m_name")).alias("about"), "rel", "m_name", "hidden")
    wide = wide.select("artifact_id", "about.*", F.col("rel").alias("source_fqn"), F.col("m_name").alias("source_column"), F.lit(False).alias("star"), F.lit(False).alias("void"), "hidden")
    left = stars.join(tables, F.col("low") == F.col("m_table"), "left_anti").select("artifact_id", "about.*", F.col("rel").alias("source_fqn"), F.lit("*").alias("source_column"), F.lit(True).alias("star"), F.lit(False).alias("void"), "hidden")
    return found.unionByName(wide).unionByName(left)


def resolved(rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Mappings (artifact_id, output_column, output_table_fqn, source_fqn, source_column, source_ref, expr, expr_lang) of rows of OPEN.

    ``columns`` (table_fqn, column_name, ordinal_position) is the catalog's; without it stars over tables give no mapping and bare names of several tables have no source.
    Views are those of the same artifact; what defines them gives no mapping of its own. A column that would feed itself is left out."""
    spark = rows.sparkSession
    columns = saved(columns.select("table_fqn", "column_name", "ordinal_position").filter("table_fqn is not null and column_name is not null"), "columns") if columns is not None else spark.createDataFrame([], COLUMNS)
    open_ = saved(positioned(rows, columns), "open")
    views = saved(open_.filter("is_view").select(F.col("artifact_id").alias("v_artifact"), F.lower("target").alias("view")).distinct(), "views")
    uses, n = saved_with_count(uses_of(open_), "uses")
    named = (F.col("artifact_id") == F.col("v_artifact")) & (F.lower("raw") == F.col("view"))
    done = None
    while n:
        waiting = uses.join(views, named).select("rid").distinct()
        now = saved(settled(uses.join(waiting, "rid", "left_anti"), columns), "settled")
        done = now if done is None else done.unionByName(now)
        late = saved(uses.join(waiting, "rid"), "late")
        if late.isEmpty():
            break
        unready = late.filter("about.is_view").select(F.col("artifact_id").alias("v_artifact"), F.lower("about.target").alias("view")).distinct()
        ready = views.join(unready, ["v_artifact", "view"], "left_anti")
        first = late.join(ready, named, "left_semi")
        if first.isEmpty():  # views that stand on themselves
            done = done.unionByName(saved(settled(late.withColumn("rel", F.lit(None).cast("string")).filter("about.kind = 'named'"), columns), "circle"))
            break
        rest = late.join(ready, named, "left_anti")
        uses, n = saved_with_count(rest.unionByName(substituted(first, done.filter("is_view"))), "uses")
    if done is None:
        return spark.createDataFrame([], "artifact_id string, output_column string, output_table_fqn string, source_fqn string, source_column string, source_ref string, expr string, expr_lang string")
    out = done.filter("not is_view and not star and not void and not (source_fqn <=> target and lower(source_column) <=> lower(output_column))")
    return out.select("artifact_id", "output_column", F.col("target").alias("output_table_fqn"), "source_fqn", "source_column", "source_ref", "expr", "expr_lang")


def read_tables(reads: DataFrame, rows: DataFrame) -> DataFrame:
    """(artifact_id, table_fqn) of reads (artifact_id, table_fqn, raw) that are no views of their artifact."""
    views = rows.filter("is_view").select("artifact_id", F.lower("target").alias("view")).distinct()
    return reads.withColumn("view", F.lower("raw")).join(views, ["artifact_id", "view"], "left_anti").select("artifact_id", "table_fqn").distinct()
