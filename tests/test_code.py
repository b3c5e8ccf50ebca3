"""Open sources of columns: stars, bare names, views, scopes, broken cells."""

import pytest

from weftline.sources import code

META = [(t, c, k + 1) for t, names in {"m.s.x": ("id", "a", "p"), "m.s.y": ("id", "r", "z"), "m.s.t": ("id", "v")}.items() for k, c in enumerate(names)]


def lineage(spark, *artifacts, meta=META):
    df = spark.createDataFrame([(f"A{k}", lang, text) for k, (lang, text) in enumerate(artifacts)], "extraction_id string, language string, raw_source string")
    columns = spark.createDataFrame(meta, "table_fqn string, column_name string, ordinal_position int") if meta else None
    maps, reads = code.lineage_of(spark, df, "m", "s", columns)
    return sorted((r["artifact_id"], r["output_table_fqn"], r["output_column"], r["source_fqn"], r["source_column"]) for r in maps.collect()), {tuple(r) for r in reads.collect()}


def test_without_a_catalog_stars_give_nothing_and_bare_names_have_no_source(spark):
    maps, reads = lineage(spark, ("sql", "INSERT INTO t SELECT *, a + 1 AS k FROM x JOIN y ON x.id = y.id; INSERT INTO t SELECT id, (a + 1) FROM x"), meta=None)
    assert maps == [("A0", "m.s.t", "id", "m.s.x", "id"), ("A0", "m.s.t", "k", None, "a")]
    assert reads == {("A0", "m.s.x"), ("A0", "m.s.y")}


def test_catalog_settles_stars_and_names(spark):
    sql = "INSERT INTO t SELECT *, a + z AS k FROM x JOIN y ON x.id = y.id; CREATE TABLE n AS SELECT * EXCEPT (a) FROM unknown; CREATE TABLE o AS SELECT a, a + p FROM x"
    maps, _ = lineage(spark, ("sql", sql))
    want = [("A0", "m.s.t", c, "m.s.x", c) for c in ("id", "a", "p")] + [("A0", "m.s.t", c, "m.s.y", c) for c in ("id", "r", "z")] + [("A0", "m.s.t", "k", "m.s.x", "a"), ("A0", "m.s.t", "k", "m.s.y", "z"), ("A0", "m.s.o", "a", "m.s.x", "a"), ("A0", "m.s.o", "(a + p)", "m.s.x", "a"), ("A0", "m.s.o", "(a + p)", "m.s.x", "p")]
    assert maps == sorted(want)


def test_views_belong_to_their_artifact_and_may_go_round(spark):
    one = "CREATE TEMP VIEW v AS SELECT a AS b, 1 AS one FROM x; CREATE TABLE n AS SELECT b, one, c FROM v"
    two = "CREATE TABLE o AS SELECT b FROM v"
    ring = "CREATE OR REPLACE TEMP VIEW v AS SELECT b FROM w; CREATE OR REPLACE TEMP VIEW w AS SELECT b FROM v; CREATE TABLE q AS SELECT b FROM w"
    maps, reads = lineage(spark, ("sql", one), ("sql", two), ("sql", ring))
    assert set(maps) == {("A0", "m.s.n", "b", "m.s.x", "a"), ("A0", "m.s.n", "c", None, "c"), ("A1", "m.s.o", "b", "m.s.v", "b"), ("A2", "m.s.q", "b", None, "b")}
    assert reads == {("A0", "m.s.x"), ("A1", "m.s.v")}


def test_views_on_views_of_both_languages(spark):
    text = """spark.sql("SELECT *, a + 1 AS k FROM m.s.x").drop("p").createOrReplaceTempView("v")
# COMMAND ----------
# MAGIC %sql
# MAGIC CREATE TEMP VIEW w AS SELECT v.k, v.id, p FROM v JOIN m.s.y USING (id)
# COMMAND ----------
spark.table("w").write.saveAsTable("m.s.n")"""
    maps, reads = lineage(spark, ("python", text))
    assert set(maps) == {("A0", "m.s.n", "k", "m.s.x", "a"), ("A0", "m.s.n", "id", "m.s.x", "id"), ("A0", "m.s.n", "p", None, "p")}
    assert reads == {("A0", "m.s.x"), ("A0", "m.s.y")}


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("CREATE TABLE a.b.t AS SELECT id, q FROM (SELECT id, p + 1 AS q FROM a.b.x) i FULL JOIN a.b.y USING (id)", {("id", "a.b.x", "id"), ("id", "a.b.y", "id"), ("q", "a.b.x", "p")}),
        ("CREATE TABLE a.b.t AS SELECT * FROM (SELECT p + 1 AS q, r FROM a.b.x) i", {("q", "a.b.x", "p"), ("r", "a.b.x", "r")}),
        ("CREATE OR REFRESH STREAMING LIVE TABLE t (CONSTRAINT c EXPECT (k(x) > 0), CONSTRAINT d EXPECT (y = 1) ON VIOLATION FAIL UPDATE) COMMENT 'n' AS SELECT x AS k FROM STREAM(LIVE.raw)", {("k", "raw", "x")}),
        ("CREATE TEMPORARY LIVE VIEW v AS SELECT x AS k FROM live.raw", set()),
        ("DELETE FROM a.b.t WHERE id IN (SELECT id FROM a.b.y)", set()),
    ],
)
def test_more_sql(spark, sql, want):
    found, _, warnings = code.sql_mappings(spark, "A", sql)
    assert {(m[1], m[3], m[4]) for m in found} == want and not warnings


def test_updates_read_what_their_subqueries_name(spark):
    assert code.sql_mappings(spark, "A", "UPDATE a.b.t SET v = w + 1 WHERE id IN (SELECT id FROM a.b.y)")[:2] == ([("A", "v", "a.b.t", "a.b.t", "w", "w", "(w + 1)", "sql")], [("A", "a.b.y")])
    assert code.sql_mappings(spark, "A", "DELETE FROM a.b.t WHERE id IN (SELECT id FROM a.b.y)")[1] == [("A", "a.b.y")]


def python(text):
    return {(t, o, s, c) for _, o, t, s, c, *_ in code.python_mappings("A", text)[0]}


def test_names_inside_functions_end_with_them():
    text = """
d = spark.table("m.s.out")
@dlt.table
def one():
    d = spark.table("m.s.a")
    return d.select("k")
@dlt.table("two")
def other():
    return d.select("k")
def helper(d, c="z"):
    d = d.withColumn(c, d["y"])
    return d
helper(d, "z").select("z").write.saveAsTable("m.s.n")
d.select("k").write.saveAsTable("m.s.o")
"""
    assert python(text) == {("one", "k", "m.s.a", "k"), ("two", "k", "m.s.out", "k"), ("m.s.n", "z", "m.s.out", "y"), ("m.s.o", "k", "m.s.out", "k")}


def test_calls_that_go_round_end():
    assert python('def f(d):\n    return f(d)\nf(spark.table("a.b.c")).select("k").write.saveAsTable("a.b.d")') == {("a.b.d", "k", None, "k")}


def test_sinks_in_assignments_and_views_of_frames():
    text = 'q = spark.readStream.table("a.b.c").select("k").writeStream.toTable("a.b.d")\nspark.table("a.b.c").select("j").writeTo("a.b.e").createOrReplace()'
    assert python(text) == {("a.b.d", "k", "a.b.c", "k"), ("a.b.e", "j", "a.b.c", "j")}


def test_broken_sources_are_scanned_only_if_nothing_else_gave_rows():
    broken = 'n = "a.b.c"\nprint "x"\nspark.table(n).withColumn("k", F.upper(F.col("j")), ).select(F.col("k").alias("l"), "m").write.saveAsTable("a.b.d")\nspark.sql(f"CREATE TABLE a.b.f AS SELECT i FROM {n}")'
    reader = code.read_python("A", [broken])
    assert {(r[1], r[5][0][0], r[7]) for r in reader.rows} == {("k", "a.b.c", "j"), ("l", "a.b.c", "j"), ("m", "a.b.c", "m")}
    assert list(reader.texts.values()) == ["CREATE TABLE a.b.f AS SELECT i FROM a.b.c"]
    reader = code.read_python("A", [broken, 'spark.table("a.b.x").select("y").write.saveAsTable("a.b.z")'])
    assert {r[3] for r in reader.rows} == {"a.b.z"}
    assert code.read_python("A", ["def ("]).rows == []
