"""Column-level walks over hops (src_node_id, dst_node_id, edge_id, src_fqn, src_col, dst_fqn, dst_col, expr, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import refs
from weftline.operators.graph import cut, hop, seed_of
from weftline.plans.durable import saved, saved_with_count

MAX_DEPTH, SERVICE_DEPTH, MAX_PATHS = 6, 8, 50
#: Rows of searches that pairs share, at most, as a multiple of the pairs.
SHARED = 16


def pruned(hops: DataFrame, include: Sequence[str] | None = None, exclude_tables: Sequence[str] = ()) -> DataFrame:
    """Hops of the wanted categories (null counts as unknown) whose source table matches none of the patterns, in any case of letters."""
    if include is not None:
        hops = hops.filter(F.lower(F.coalesce("transform_category", F.lit("unknown"))).isin([c.lower() for c in include]))
    for pattern in exclude_tables:
        hops = hops.filter(~F.coalesce(F.col("src_fqn").rlike(f"(?i){pattern}"), F.lit(False)))
    return hops


def backtrack(hops: DataFrame, target: str, max_depth: int = MAX_DEPTH, include: Sequence[str] | None = None, exclude_tables: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(levels, edges) upstream of a column node.

    levels: node, depth (the shallowest), is_source (nothing feeds it, before pruning). edges: depth (of the level that they feed), src_node_id,
    dst_node_id, edge_id; edges into nodes that were seen before are kept. A target that no hop has gives no rows."""
    # only the columns that the walk reads are kept
    read = ["src_node_id", "dst_node_id", "edge_id", *(["transform_category"] if include is not None else []), *(["src_fqn"] if exclude_tables else [])]
    hops = saved(hops.filter("src_node_id != dst_node_id").select(*read), "hops")
    walk = pruned(hops, include, exclude_tables)
    known = hops.select(F.col("src_node_id").alias("node")).unionByName(hops.select(F.col("dst_node_id").alias("node")))
    seen = frontier = cut(known.filter(F.col("node") == target).distinct().withColumn("depth", F.lit(0)))
    taken = None
    for depth in range(1, max_depth + 1):
        edges = walk.join(frontier.select(F.col("node").alias("dst_node_id")), "dst_node_id", "left_semi").select("src_node_id", "dst_node_id", "edge_id").distinct().withColumn("depth", F.lit(depth))
        edges = cut(edges)
        taken = edges if taken is None else taken.unionByName(edges)
        frontier, found = hop(edges.select(F.col("src_node_id").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not found:
            break
        seen = seen.unionByName(frontier)
    fed = hops.select(F.col("dst_node_id").alias("node")).join(seen, "node", "left_semi").distinct().withColumn("fed", F.lit(True))
    levels = seen.join(fed, "node", "left").select("node", "depth", F.col("fed").isNull().alias("is_source"))
    return levels, taken


def service_backtrack(hops: DataFrame, table: str, column: str, max_depth: int = SERVICE_DEPTH, touching_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Levels and edges as a transformation view shows them, for one column of a table.

    nodes: level, label, colour, table, column, is_source_column. edges: level, source and target node, expression, category, colour; one
    edge per pair of nodes and level. ``touching_only`` walks only hops that have the table at one end."""
    hops = hops.filter("src_fqn is not null and dst_fqn is not null and src_col is not null and dst_col is not null and src_node_id != dst_node_id")
    if touching_only:
        hops = hops.filter((F.col("src_fqn") == table) | (F.col("dst_fqn") == table))
    hops = saved(hops.select("src_node_id", "dst_node_id", "edge_id", *(c for c in ("expr_sql", "expr", "transform_category") if c in hops.columns)), "hops")
    levels, edges = backtrack(hops, f"col:{table}::{column}", max_depth)
    nodes = levels.select(
        F.col("depth").alias("level"), refs.level_label(F.col("depth")).alias("label"), refs.level_colour(F.col("depth")).alias("colour"), "node",
        refs.node_table(F.col("node")).alias("table"), refs.node_column(F.col("node")).alias("column"), F.col("is_source").alias("is_source_column"),
    )
    said = F.coalesce(*(F.col(c) for c in ("expr_sql", "expr") if c in hops.columns), F.lit("—"))
    kind = F.upper(F.coalesce("transform_category", F.lit("unknown")))
    about = hops.select("edge_id", said.alias("expression"), kind.alias("category"))
    pairs = edges.join(about, "edge_id").groupBy("depth", "src_node_id", "dst_node_id").agg(F.min(F.struct("edge_id", "expression", "category")).alias("e"))
    shown = pairs.select(F.col("depth").alias("level"), F.col("src_node_id").alias("source"), F.col("dst_node_id").alias("target"), "e.expression", "e.category")
    return nodes, shown.withColumn("colour", refs.category_colour(F.col("category")))


def shortest_path(hops: DataFrame, source: str, target: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(step, src_node_id, dst_node_id, edge_id) of a shortest path; among equals the one whose steps back from the target have the smallest edge ids.

    No rows if there is none within ``max_depth`` hops, or if source and target are one."""
    pair = hops.sparkSession.createDataFrame([(source, target)], "source string, target string")
    return shortest_paths(hops, pair, max_depth).select("step", "src_node_id", "dst_node_id", "edge_id")


def shortest_paths(hops: DataFrame, pairs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(source, target, step, src_node_id, dst_node_id, edge_id): a shortest path of every pair (source, target) that has one within ``max_depth`` hops.

    Two searches, from all sources and from all targets, each a frontier of (pair, node). A round carries the smaller frontier one hop further and asks where
    it meets what the other search has seen: both know all nodes within their depths, so the first meeting is a shortest one, and the pair leaves both frontiers.
    Pairs that share an end with many others and have no path are left out first (``_near``).
    From the middle the nodes on shortest paths are followed out through the levels of either side; ties go to the smallest edge ids from the target back."""
    hops = saved(hops.filter("src_node_id != dst_node_id").select("src_node_id", "dst_node_id", "edge_id").distinct(), "hops")
    pairs, n = saved_with_count(pairs.select("source", "target").filter("source != target").distinct(), "pairs")
    fore = hops.select(F.col("src_node_id").alias("node"), F.col("dst_node_id").alias("next"))
    along = {True: fore, False: fore.select(F.col("next").alias("node"), F.col("node").alias("next"))}
    pairs, n = _near(pairs, n, along, max_depth)
    pair, key = ["source", "target"], ["source", "target", "node"]
    front = {True: pairs.withColumn("node", F.col("source")), False: pairs.withColumn("node", F.col("target"))}
    seen = {side: front[side].withColumn("depth", F.lit(0)) for side in front}
    size, depth = {True: n, False: n}, {True: 0, False: 0}
    middle = done = None
    while depth[True] + depth[False] < max_depth and size[True] and size[False]:
        side = size[True] <= size[False]
        depth[side] += 1
        open_ = front[side] if done is None else front[side].join(done, pair, "left_anti")
        step = open_.join(along[side], "node").select("source", "target", F.col("next").alias("node")).distinct().join(seen[side].select(key), key, "left_anti")
        other = seen[not side].filter(F.col("depth") == depth[not side]).select(*key, F.lit(True).alias("met"))
        front[side], size[side] = saved_with_count(step.join(other, key, "left"), "front")
        hit = front[side].filter("met").select(*key, F.lit(depth[True]).alias("fore"), F.lit(depth[False]).alias("back"))
        front[side] = front[side].select(key)
        seen[side] = seen[side].unionByName(front[side].withColumn("depth", F.lit(depth[side])))
        middle = hit if middle is None else middle.unionByName(hit)
        done = middle.select(pair).distinct()
    none = hops.select(F.col("src_node_id").alias("source"), F.col("dst_node_id").alias("target"), F.lit(0).alias("step"), "src_node_id", "dst_node_id", "edge_id").filter("false")
    if middle is None:
        return none
    middle = saved(middle.withColumn("at", F.col("fore")), "middle")  # at: distance from the source
    on = middle
    for way, most in ((1, depth[False]), (-1, depth[True])):
        held = middle
        for _ in range(most):  # a few joins, by the depths that were searched
            left = F.col("at") if way < 0 else F.col("fore") + F.col("back") - F.col("at")
            step = held.join(along[way > 0], "node").select("source", "target", F.col("next").alias("node"), "fore", "back", (F.col("at") + way).alias("at")).distinct()
            held = step.join(seen[way < 0].select(*key, F.col("depth").alias("have")), key).filter(F.col("have") == left).select(middle.columns)
            on = on.unionByName(held)
    on = saved(on.select(*key, "at", (F.col("fore") + F.col("back")).alias("length")).distinct(), "on")
    path, at = none, on.filter("at = length").select(*key, "at")
    before = on.select("source", "target", F.col("node").alias("src_node_id"), (F.col("at") + 1).alias("at"))
    for _ in range(depth[True] + depth[False]):
        edges = at.withColumnRenamed("node", "dst_node_id").join(hops, "dst_node_id").join(before, ["source", "target", "src_node_id", "at"])
        best = edges.groupBy("source", "target", F.col("at").alias("step"), "dst_node_id").agg(F.min(F.struct("edge_id", "src_node_id")).alias("e"))
        best = cut(best.select("source", "target", "step", "e.src_node_id", "dst_node_id", "e.edge_id"))
        path = path.unionByName(best)
        at = best.select("source", "target", F.col("src_node_id").alias("node"), (F.col("step") - 1).alias("at"))
    return path


def _near(pairs: DataFrame, n: int, along: dict[bool, DataFrame], max_depth: int) -> tuple[DataFrame, int]:
    """The ``n`` pairs less those without a path, where many pairs share an end: one search from each such end serves all its pairs.

    Only where searches that find every node would have at most ``SHARED`` times as many rows as there are pairs; else all pairs are left."""
    nodes = along[True].select("node").unionByName(along[True].select(F.col("next").alias("node"))).distinct().count()
    for forward, end, other in ((True, "source", "target"), (False, "target", "source")):
        frontier, size = saved_with_count(pairs.select(F.col(end).alias("end")).distinct().withColumn("node", F.col("end")), "near")
        if size * nodes > SHARED * n:
            continue
        seen = frontier
        for _ in range(max_depth):
            step = frontier.join(along[forward], "node").select("end", F.col("next").alias("node")).distinct()
            frontier, found = hop(step.join(seen, ["end", "node"], "left_anti"))
            if not found:
                break
            seen = seen.unionByName(frontier)
        return saved_with_count(pairs.join(seen.select(F.col("end").alias(end), F.col("node").alias(other)), ["source", "target"], "left_semi"), "pairs")
    return pairs, n


def simple_paths(hops: DataFrame, source: str, target: str, max_depth: int = MAX_DEPTH, max_paths: int | None = MAX_PATHS) -> DataFrame:
    """(path, length, nodes, edges): simple paths, shortest first and then by their edge ids; parallel edges give paths of their own.

    Only hops that lie on a path are walked: those whose ends are reached from the source and reach the target within the depth. A
    source that is the target has the empty path."""
    from pyspark.sql import Window

    from weftline.operators.graph import reach, reversed_edges

    hops = saved(hops.filter("src_node_id != dst_node_id").select("src_node_id", "dst_node_id", "edge_id").distinct(), "hops")
    empty = hops.sparkSession.createDataFrame([], "nodes array<string>, edges array<string>")
    if source == target:
        found = hops.sparkSession.createDataFrame([([source], [])], empty.schema)
    else:
        edges = hops.select(F.col("src_node_id").alias("source"), F.col("dst_node_id").alias("target"))
        fore = reach(edges, seed_of(hops, source), max_depth, ready=True).select(F.col("node").alias("src_node_id"), F.col("depth").alias("d"))
        back = reach(reversed_edges(edges), seed_of(hops, target), max_depth, ready=True).select(F.col("node").alias("dst_node_id"), F.col("depth").alias("e"))
        useful = saved(hops.join(fore, "src_node_id").join(back, "dst_node_id").filter(F.col("d") + 1 + F.col("e") <= max_depth).select("src_node_id", "dst_node_id", "edge_id", "e"), "useful")
        open_ = hops.sparkSession.createDataFrame([(source, [source], [])], "node string, nodes array<string>, edges array<string>")
        found = empty
        for depth in range(1, max_depth + 1):
            step = open_.join(useful, open_["node"] == useful["src_node_id"]).filter(~F.array_contains("nodes", F.col("dst_node_id")) & (F.col("e") + depth <= max_depth))
            step = cut(step.select(F.col("dst_node_id").alias("node"), F.array_append("nodes", F.col("dst_node_id")).alias("nodes"), F.array_append("edges", F.col("edge_id")).alias("edges")))
            found = found.unionByName(step.filter(F.col("node") == target).select("nodes", "edges"))
            open_ = step.filter(F.col("node") != target)
            if open_.isEmpty():
                break
    found = found.withColumn("length", F.size("edges"))
    if max_paths is not None:
        found = found.orderBy("length", "edges").limit(max_paths)
    return found.withColumn("path", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("length", "edges"))) if max_paths is not None else found.withColumn("path", F.xxhash64("edges"))


def rendered(paths: DataFrame, hops: DataFrame) -> DataFrame:
    """(path, step, node, edge_id, expression): one row per step of each path; step 0 is the source and has no edge."""
    steps = saved(paths, "paths").select("path", F.posexplode("nodes").alias("step", "node"), "edges").withColumn("edge_id", F.when(F.col("step") > 0, F.element_at("edges", F.greatest(F.col("step"), F.lit(1))))).drop("edges")
    said = F.coalesce(*(F.col(c) for c in ("expr_sql", "expr") if c in hops.columns))
    asked = saved(steps.select("edge_id").distinct(), "asked")  # the paths' edges only: other hops are not grouped
    about = hops.join(asked, "edge_id", "left_semi").groupBy("edge_id").agg(F.min(said).alias("expression"))
    return steps.join(about, "edge_id", "left").select("path", "step", "node", "edge_id", "expression")


def column_trace(edges: DataFrame, table: str, column: str) -> DataFrame:
    """(table, column, direction, depth): columns that feed or are fed by one column, across any schemas; names of columns agree in any case of letters."""
    from weftline.operators.graph import prepared, reach, reversed_edges

    def node(end: str) -> F.Column:
        return F.concat(F.col(f"{end}_table_full_name"), F.lit("::"), F.lower(f"{end}_column_name"))

    pairs = saved(prepared(edges.select(node("source").alias("source"), node("target").alias("target"))), "pairs")
    seed = seed_of(edges, f"{table}::{column.lower()}")
    both = reach(reversed_edges(pairs), seed, ready=True).withColumn("direction", F.lit("up")).unionByName(reach(pairs, seed, ready=True).withColumn("direction", F.lit("down")))
    return both.select(F.substring_index("node", "::", 1).alias("table"), F.substring_index("node", "::", -1).alias("column"), "direction", "depth")


def column_edges(lineage: DataFrame, catalog: str, schema: str, *, as_of: str | None = None, days: int | None = None, limit: int | None = None) -> DataFrame:
    """Distinct column pairs that touch a schema, both ends named, without self-loops."""
    four = ["source_table_full_name", "source_column_name", "target_table_full_name", "target_column_name"]
    rows = lineage.dropna(subset=four)
    if as_of is not None and days is not None:
        rows = rows.filter(refs.in_window(F.col("event_time"), F.lit(as_of), days))
    prefix = f"{catalog}.{schema}."
    rows = rows.filter(F.col(four[0]).startswith(prefix) | F.col(four[2]).startswith(prefix))
    rows = rows.filter((F.col(four[0]) != F.col(four[2])) | (F.col(four[1]) != F.col(four[3]))).select(*four).distinct()
    return rows if limit is None else rows.orderBy(*four).limit(limit)


def edges_of_column(edges: DataFrame, table: str, column: str, *, exact_case: bool = True) -> DataFrame:
    same = (lambda c: F.col(c) == column) if exact_case else (lambda c: F.lower(c) == column.lower())
    at = lambda end: (F.col(f"{end}_table_full_name") == table) & same(f"{end}_column_name")
    return edges.filter(at("source") | at("target"))


def visible(edges: DataFrame, hidden: Sequence[str]) -> DataFrame:
    """Edges (category) without those of hidden categories, in any case of letters."""
    return edges.filter(~F.upper("category").isin([h.upper() for h in hidden])) if hidden else edges


def categories(edges: DataFrame) -> DataFrame:
    """The categories that occur among edges (category), sorted."""
    return edges.select("category").distinct().orderBy("category")
