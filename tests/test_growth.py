"""Work that must not grow faster than the input: rows that plans make on inputs with hubs and many repeats."""

import hashlib

from pyspark.sql import functions as F

from weftline.operators import graph, hops, paths, report, scope
from weftline.plans import catalogue
from weftline.sources import code
from weftline.sources.derived import view


def most_rows(spark, run):
    """What ``run`` returns, and the most rows that one operator of its plans gave out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out, most = store.executionsCount(), run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for i in range(before, store.executionsCount()):
        execution = store.executionsList().apply(i).executionId()
        metrics, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for n in range(nodes.size()):
            own = nodes.apply(n).metrics()
            for m in range(own.size()):
                if own.apply(m).name() == "number of output rows":
                    said = metrics.get(own.apply(m).accumulatorId())
                    most = max(most, int(said.get().replace(",", "")) if said.isDefined() else 0)
    return out, most


def test_scope_does_not_meet_all_readers_of_a_volume_with_all_that_is_made_from_it(spark):
    n, kind = 400, "source_table_full_name string, target_table_full_name string, source_path string, entity_type string, entity_id string, created_by string, event_time string"
    volume = "/Volumes/cat0/bronze/v0/f.csv"
    rows = [(None, f"cat0.silver.t{i}", volume, "JOB", str(i), "u", "2024-01-01") for i in range(n)]
    rows += [(None, f"cat0.silver.t{i}", volume, None, None, "u", "2024-01-01") for i in range(2 * n)]
    tables = spark.createDataFrame([("cat0", "silver", f"t{i}", "TABLE") for i in range(2 * n)], "table_catalog string, table_schema string, table_name string, table_type string")
    edges, most = most_rows(spark, lambda: {tuple(r) for r in scope.scope_graph(scope.records(spark.createDataFrame(rows, kind)), tables, "cat0", "silver")[1].collect()})
    v = "cat0.bronze.v0"
    assert edges == {(v, f"entity:JOB:{i}") for i in range(n)} | {(f"entity:JOB:{i}", f"cat0.silver.t{i}") for i in range(n)} | {(v, f"cat0.silver.t{i}") for i in range(n, 2 * n)}
    assert most < 20 * n


def test_moved_asks_either_end(spark):
    reads = [(f"e{i}", "s") for i in range(5)] + [("e0", "x"), ("e7", "y")]
    writes = [("e3", "t"), ("e9", "u")] + [(f"e{i}", "w") for i in range(9)]
    pairs = [(s, t) for s in "sxyz" for t in "tuwz"]
    got = graph.moved(spark.createDataFrame(pairs, "source string, target string"), spark.createDataFrame(reads, "entity string, source string"), spark.createDataFrame(writes, "entity string, target string"))
    assert sorted(map(tuple, got.collect())) == sorted({(s, t) for s, t in pairs for a, b in reads for c, d in writes if a == c and (b, d) == (s, t)})


def test_pairs_of_one_source_share_its_search(spark, monkeypatch):
    n = 300
    names = [(f"a{i}", f"a{i + 1}") for i in range(4)] + [("a0", f"b{i}") for i in range(5)] + [(f"x{i}", f"y{i}") for i in range(n)]
    hops = spark.createDataFrame([(s, t, f"e_{s}_{t}") for s, t in names], "src_node_id string, dst_node_id string, edge_id string")
    pairs = hops.select(F.lit("a0").alias("source"), F.col("dst_node_id").alias("target"))
    found = lambda: {(r["target"], r["step"], r["edge_id"]) for r in paths.shortest_paths(hops, pairs).collect()}
    shared, most = most_rows(spark, found)
    assert shared == {(f"a{i}", k + 1, f"e_a{k}_a{k + 1}") for i in range(1, 5) for k in range(i)} | {(f"b{i}", 1, f"e_a0_b{i}") for i in range(5)}
    assert most < 4 * n  # each pair with each successor of the source are 6 * n rows
    monkeypatch.setattr(paths, "SHARED", 0)
    assert found() == shared


def test_targets_by_shapes_of_statements(spark, monkeypatch):
    texts = ["INSERT INTO m.s.c{0} SELECT a FROM m.s.x{0}", "SELECT a FROM m.s.c{0}", "NOT SQL m.s.c{0}", "INSERT INTO c{0}.C{0}.`c{0}` SELECT 'c{0}', 1e{0}, 1.e{0} FROM t -- c", "MERGE INTO s{0}.t USING u1 ON s{0}.t.a = u1.a WHEN MATCHED THEN DELETE", "INSERT INTO q.`wl0q{0}` SELECT 1", "INSERT INTO k{0} SELECT 'it''s c{0}' x{0}"]
    cells = [(f"{j}_{i}", t.format(i)) for i in range(1, 40) for j, t in enumerate(texts)]
    asked, plan_of = [], code.plan_of
    monkeypatch.setattr(code, "plan_of", lambda s, sql: asked.append(sql) or plan_of(s, sql))
    got = {tuple(r) for r in code.sql_targets(spark, spark.createDataFrame(cells, "artifact_id string, source string")).collect()}
    want = {(a, ".".join(n)) for a, s in cells for n in _written(spark, plan_of, s)}
    assert got == want and len(want) == 5 * 39
    assert len(asked) <= 4 + 3 * 39  # four of the seven texts are one shape each, or rejected as one


def _written(spark, plan_of, statement):
    try:
        return [n for n, _ in code._targets(plan_of(spark, statement))]
    except Exception:  # noqa: BLE001  not a statement of Spark's
        return []


def test_hops_drop_repeats_by_four_columns(spark, sf):
    hops = catalogue._hops(spark, sf)
    want = view(spark, sf, "v_hops")
    assert hops.columns == want.columns and hops.exceptAll(want).isEmpty() and want.exceptAll(hops).isEmpty()
    shuffled = [x for x in hops._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert len(shuffled) == 1 and shuffled[0].count(",") <= 7 and "concat" not in shuffled[0]


def test_pairs_outside_the_scope_are_never_made(spark):
    n = 60
    edges = [(f"d.s.r{i}", "entity:JOB:1") for i in range(n)] + [("entity:JOB:1", f"d.s.w{i}") for i in range(n)] + [("c.s.a", "entity:JOB:1"), ("entity:JOB:1", "c.s.b"), ("c.s.b", "d.s.q"), ("d.s.q", "d.s.p")]
    rows = spark.createDataFrame(edges, "source string, target string")
    sheet = report.client_lineage_sheet(rows, "c", "s")
    got = [tuple(r) for r in sheet.collect()]
    assert got == sorted([("c.s.a", f"d.s.w{i}") for i in range(n)] + [(f"d.s.r{i}", "c.s.b") for i in range(n)] + [("c.s.a", "c.s.b"), ("c.s.b", "d.s.q")])
    joins = [x for x in sheet._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any(" OR " in x for x in joins)  # no join compares all pairs and then asks for the scope


def test_maps_meet_an_entity_once_and_not_once_a_schema(spark):
    schemas, entities = 10, 20
    tables = [f"c.s{k}.t{i}" for k in range(schemas) for i in range(6)]
    edges = [(t, f"entity:JOB:{e}") for t in tables for e in range(entities)]
    e = spark.createDataFrame(edges, "source string, target string")
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    everything = {x for pair in edges for x in pair}
    for limit in (schemas, 64):
        got, most = most_rows(spark, lambda m=limit: {tuple(r) for r in report.schema_maps(nodes, e, m).collect()})
        assert got == {(f"c.s{k}", node) for k in range(schemas) for node in everything}
        assert most <= 2 * len(edges)  # each entity's neighbours once a schema are ten times the edges


def test_maps_of_more_schemas_than_a_word_has_bits(spark):
    edges = [(f"c.s{k:03d}.a", f"c.s{k:03d}.b") for k in range(130)] + [("c.s000.a", "c.s129.b")]
    e = spark.createDataFrame(edges, "source string, target string")
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    got = {tuple(r) for r in report.schema_maps(nodes, e, 128).collect()}
    assert got == {(f"c.s{k:03d}", f"c.s{k:03d}.{x}") for k in range(128) for x in "ab"} | {("c.s000", "c.s129.b")}


def test_status_does_not_shuffle_distinct_edges_once_more(spark, sf):
    by_both = "source#"  # an exchange of edges by their ends; those of counts and nodes are by node
    for q in (catalogue.node_status, catalogue.sheet_by_schema):
        shuffled = [x for x in q(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
        assert shuffled and not any(by_both in x for x in shuffled)


def _crowd(n):
    """``n`` entities that all read n tables and write n others, some direct edges, and a table with an edge to itself."""
    edges = [(f"r{i}", f"entity:JOB:{e}") for i in range(n) for e in range(n)] + [(f"entity:JOB:{e}", f"w{i}") for i in range(n) for e in range(n)]
    return edges + [("w0", "r0"), ("x", "x"), ("r1", "w1"), ("entity:JOB:0", "r2"), ("w1", "entity:JOB:n")]


def test_views_do_not_make_a_pair_once_for_each_node_between(spark, monkeypatch):
    n = 20
    edges = _crowd(n)
    e = spark.createDataFrame(edges, "source string, target string")
    entity = lambda x: x.startswith("entity:")
    through = {(a, d) for a, b in edges for c, d in edges if b == c and a != d}
    table = {(a, d) for a, d in through if not entity(a) and not entity(d) and not {(a, "x"), ("x", d)} & set(edges)} & {(a, d) for a, b in edges for c, d in edges if b == c and entity(b)} | {p for p in edges if not entity(p[0]) and not entity(p[1])}
    pipeline = {(a, d) for a, b in edges for c, d in edges if b == c and entity(a) and entity(d) and not entity(b) and a != d}
    for most in (None, 100):
        if most:
            monkeypatch.setattr(graph, "GROUP_SOURCES", most)
        for mode, want in (("table", table), ("pipeline", pipeline)):
            got, rows = most_rows(spark, lambda m=mode: [tuple(r) for r in graph.view(e, m).collect()])
            assert sorted(got) == sorted(want)
            assert most or rows < 2 * len(edges)  # each pair once an entity are n * n * n rows
        assert sorted(r[0] for r in graph.table_nodes(e).collect()) == sorted({x for p in table for x in p})


def test_nodes_of_an_entity_that_reads_what_it_writes(spark):
    e = spark.createDataFrame([("a", "entity:J:1"), ("entity:J:1", "a"), ("b", "entity:J:2"), ("entity:J:2", "b"), ("entity:J:2", "c")], "source string, target string")
    assert {tuple(r) for r in graph.view(e, "table").collect()} == {("b", "c")}
    assert {r[0] for r in graph.table_nodes(e).collect()} == {"b", "c"}


def test_shown_nodes_are_read_without_meeting_entities(spark):
    rows = [(s, t) for s, t in _crowd(6)] * 2 + [("a", "entity:J:1"), ("entity:J:1", "a"), ("b", "entity:J:2"), ("entity:J:2", "b"), ("entity:J:2", "c"), ("d", "entity:J:3"), ("entity:J:4", "e"), ("f", "entity:J:5"), ("g", "entity:J:5"), ("entity:J:5", "g")]
    e = spark.createDataFrame(rows, "source string, target string")
    pairs = {tuple(r) for r in graph.view(e.distinct(), "table").collect()}
    got, most = most_rows(spark, lambda: sorted(r[0] for r in graph.table_nodes(e).collect()))
    assert got == sorted({x for p in pairs for x in p}) and "g" in got and "a" not in got
    plan = graph.table_nodes(e)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "min(source" not in plan


def test_routed_edges_are_distinct_with_repeats_and_tables_named_as_entities(spark):
    rows = [("a", "b", "entity:J:1"), ("b", "c", "entity:J:1"), ("a", "b", None), (None, "d", "entity:J:1"), ("f", None, "entity:J:2"), ("entity:J:1", "b", None), ("g", None, None), ("h", "h", "entity:J:3")] * 3
    e = "entity:J:1"
    got = [tuple(r) for r in scope.routed(spark.createDataFrame(rows, "source string, target string, entity string")).collect()]
    assert sorted(got) == sorted({("a", e), (e, "b"), (e, "c"), ("b", "c"), ("a", "b"), (e, "d"), ("f", "entity:J:2"), ("entity:J:3", "h"), ("h", "h")})


def test_derived_edges_are_made_without_the_reads(spark):
    m = spark.createDataFrame([("a", "x", "c.s.t", "c.s.u", "y", "u.y", "y + 1", "sql")] * 2 + [("a", "x", "c.s.t", "c.s.v", "y", "v.y", "y", "sql")], "artifact_id string, output_column string, output_table_fqn string, source_fqn string, source_column string, source_ref string, expr string, expr_lang string")
    nodes, edges = hops.graph_of(m, m.select("artifact_id", F.col("source_fqn").alias("table_fqn")))
    derived = edges.filter("edge_type = 'derive'")
    assert derived.count() == 2 and edges.count() == 6 and nodes.count() == 6
    assert "tbl:" not in derived._jdf.queryExecution().optimizedPlan().toString()


def test_rendering_groups_the_edges_of_the_paths_only(spark):
    n = 500
    h = spark.createDataFrame([(f"e{i}", f"x{i}") for i in range(n)], "edge_id string, expr string")
    found = spark.createDataFrame([(1, ["a", "b", "c"], ["e1", "e2"])], "path int, nodes array<string>, edges array<string>")
    shown = paths.rendered(found, h)
    assert sorted(tuple(r) for r in shown.collect()) == [(1, 0, "a", None, None), (1, 1, "b", "e1", "x1"), (1, 2, "c", "e2", "x2")]
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_a_cone_of_ready_edges_does_not_copy_them(spark, monkeypatch):
    e = spark.createDataFrame([("a", "entity:J:1"), ("entity:J:1", "b"), ("b", "b"), ("b", "c")], "source string, target string")
    want = {r[0] for r in graph.cone(e, "a", 1).collect()}
    monkeypatch.setattr(graph, "prepared", lambda _: 1 / 0)
    assert {r[0] for r in graph.cone(e, "a", 1, ready=True).collect()} == want == {"a", "entity:J:1", "b"}


def test_hops_read_from_mappings_are_those_of_the_graph(spark):
    kind = "artifact_id string, output_column string, output_table_fqn string, source_fqn string, source_column string, source_ref string, expr string, expr_lang string"
    rows = [(f"a{i % 3}", f"x{i % 4}", "c.s.t" if i % 5 else None, f"c.s.u{i % 2}" if i % 7 else None, f"y{i % 3}", f"u.y{i % 3}", f"y + {i % 6}", "sql" if i % 3 else "pyspark") for i in range(120)]
    rows += [*rows[:9], ("a1", "x", "c.s.t", "c.s.t", "x", "t.x", "x", "sql"), ("a1", None, "c.s.t", "c.s.u", "y", "y", "y", "sql"), ("a2", "x", "c.s.t", "c.s.u", None, "y", "y", "sql"), (None, "x", "c.s.t", "c.s.u", "y", "y", "y", "sql"), ("a1", None, None, None, None, None, None, None)]
    m = spark.createDataFrame(rows, kind)
    code = spark.createDataFrame([("a0", "/q"), ("a0", "/p"), ("a1", "/r")], "extraction_id string, source_path string")
    want = hops.edge_endpoints(*hops.graph_of(m, m.select("artifact_id", F.col("source_fqn").alias("table_fqn"))), code)
    got = hops.endpoints_of(m, code)
    both = [sorted(map(repr, df.collect())) for df in (got, want)]
    assert got.columns == want.columns and both[0] == both[1] and len(both[0]) > 30


def test_endpoints_shuffle_each_hop_once_after_its_repeats(spark, sf, monkeypatch):
    monkeypatch.setattr(hops, "graph_of", lambda *_: 1 / 0)
    out = catalogue.edge_endpoints(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not [x for x in plan.splitlines() if "hashpartitioning" in x and "sha2" in x]  # hops of one expression would meet in one task
    want = view(spark, sf, "v_hops")
    assert out.count() == want.count() > 1000
    assert out.select("src_node_id", "dst_node_id", "expr").exceptAll(want.select("src_node_id", "dst_node_id", "expr")).isEmpty()


def test_lists_of_sources_go_once_to_each_home_of_targets(spark, monkeypatch):
    n, name = 30, lambda b, i: "r" + hashlib.sha256(f"{b} {i}".encode()).hexdigest()  # names that do not compress
    edges = [(name(b, i), f"entity:JOB:{b}") for b in range(4) for i in range(n)] + [(f"entity:JOB:{b}", f"w{b}_{i}") for b in range(4) for i in range(n)]
    want = sorted((name(b, i), f"w{b}_{j}") for b in range(4) for i in range(n) for j in range(n))
    e = spark.createDataFrame(edges, "source string, target string")
    got, sent = shuffled_bytes(spark, lambda: sorted(tuple(r) for r in graph.view(e, "table").collect()))
    monkeypatch.setattr(graph, "HOME_TARGETS", n - 1)  # every target is at home by itself
    alone, more = shuffled_bytes(spark, lambda: sorted(tuple(r) for r in graph.view(e, "table").collect()))
    assert got == alone == want and 1.5 * sent < more


def shuffled_bytes(spark, run):
    """What ``run`` returns, and the bytes that its stages shuffled."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before, out = written(), run()
    return out, sum(n for stage, n in written().items() if stage not in before)


def test_views_of_names_with_line_breaks_and_of_none(spark):
    edges = [("a\nb", "entity:J:1"), ("", "entity:J:1"), ("a", "entity:J:1"), ("entity:J:1", "t\n"), ("b", "t\n"), ("a", "u"), ("entity:J:2", "v"), ("w", "entity:J:3")]
    kind = "source string, target string"
    assert sorted(tuple(r) for r in graph.view(spark.createDataFrame(edges, kind), "table").collect()) == [("", "t\n"), ("a", "t\n"), ("a", "u"), ("a\nb", "t\n"), ("b", "t\n")]
    plain = [(s.replace("\n", ""), t) for s, t in edges]
    assert sorted(tuple(r) for r in graph.view(spark.createDataFrame(plain, kind), "table").collect()) == [("", "t\n"), ("a", "t\n"), ("a", "u"), ("ab", "t\n"), ("b", "t\n")]
    assert graph.view(spark.createDataFrame([], kind), "table").count() == 0
