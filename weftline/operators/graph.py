"""Graph queries as iterative joins over an edge table (source, target).

A walk keeps what it has visited and the frontier of the last hop; each hop joins the frontier to the edges, drops
what is known and is cut off as a table in the shared folder, so plans stay small and lost executors cost one hop at most. Spark picks
broadcast or shuffled joins by the frontier's size. Edges are deduplicated and kept once before the first hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.durable import saved, saved_with_count

MAX_HOPS, NODE_CAP = 16, 2500
#: Rounds of colouring in a job, and layers after which their tables become one, so that plans stay short.
ROUNDS_PER_JOB, LONG = 4, 64
#: Reads of an entity in one block when its reads meet its writes.
HUB_READS = 1000
#: Sources, repeats included, in all lists of one target that are taken together in one group.
GROUP_SOURCES = 100_000
#: Sources, repeats included, of all targets in one task on average; most targets of a node between that are kept together.
TASK_SOURCES, HOME_TARGETS = 2_000_000, 256


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once (an RDD checkpoint would compute it twice) and safe from lost executors."""
    return saved(df, "hop")


def hop(df: DataFrame) -> tuple[DataFrame, bool]:
    """``cut``, and whether there are rows; they are counted while they are written, so a hop is one job."""
    out, n = saved_with_count(df, "hop")
    return out, n > 0


def is_entity(node: Column) -> Column:
    return node.startswith("entity:")


def prepared(edges: DataFrame) -> DataFrame:
    """Distinct edges with both ends, without self-loops."""
    return edges.select("source", "target").filter("source is not null and target is not null and source != target").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, *, ready: bool = False) -> DataFrame:
    """(node, depth): the least number of hops from any seed (node) along the edges, seeds included at 0. ``ready`` edges are prepared and kept already."""
    edges = edges if ready else saved(prepared(edges), "edges")
    seen = frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_hops is None or depth < max_hops:
        depth += 1
        step = edges.join(frontier.select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier, found = hop(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not found:
            break
        seen = seen.unionByName(frontier)
    return seen


def seed_of(edges: DataFrame, node: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(node,)], "node string")


def descendants(edges: DataFrame, node: str, max_hops: int | None = MAX_HOPS, *, ready: bool = False) -> DataFrame:
    return reach(edges, seed_of(edges, node), max_hops, ready=ready)


def ancestors(edges: DataFrame, node: str, max_hops: int | None = MAX_HOPS, *, ready: bool = False) -> DataFrame:
    return reach(reversed_edges(edges), seed_of(edges, node), max_hops, ready=ready)


def trace_nodes(edges: DataFrame, seed: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """(node, direction, depth) of the directional cone: what feeds the seed, and what it feeds. The two walks do not share what they have visited."""
    edges = saved(prepared(edges), "edges")
    up = ancestors(edges, seed, max_hops, ready=True).withColumn("direction", F.lit("up"))
    down = descendants(edges, seed, max_hops, ready=True).withColumn("direction", F.lit("down"))
    return up.unionByName(down).select("node", "direction", "depth")


def cone(edges: DataFrame, seed: str, max_depth: int = 0, *, ready: bool = False) -> DataFrame:
    """Nodes within ``max_depth`` table hops of the seed, either way (0: no limit), with the direct neighbours of all entities among them.

    A hop into an entity costs nothing, so a node's depth is the least number of table hops; tables at the limit are not expanded.
    ``ready`` edges are distinct and kept already."""
    edges = edges.select("source", "target").filter("source != target") if ready else saved(prepared(edges), "edges")

    def walk(along: DataFrame) -> DataFrame:
        best = frontier = cut(seed_of(edges, seed).withColumn("depth", F.lit(0)))
        while True:
            step = along.join(frontier.withColumnRenamed("node", "source"), "source")
            if max_depth:
                step = step.filter(is_entity(F.col("source")) | (F.col("depth") < max_depth))
            step = step.select(F.col("target").alias("node"), (F.col("depth") + F.when(is_entity(F.col("target")), 0).otherwise(1)).alias("depth"))
            if max_depth:
                step = step.filter(F.col("depth") <= max_depth)
            step = step.groupBy("node").agg(F.min("depth").alias("depth"))
            known = best.withColumnRenamed("depth", "had")
            better, found = hop(step.join(known, "node", "left").filter("had is null or depth < had").select("node", "depth"))
            if not found:
                return best
            best = cut(best.unionByName(better).groupBy("node").agg(F.min("depth").alias("depth")))
            frontier = better

    found = walk(edges).select("node").unionByName(walk(reversed_edges(edges)).select("node")).distinct()
    entities = found.filter(is_entity(F.col("node")))
    around = edges.join(entities.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("target").alias("node"))
    before = edges.join(entities.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("node"))
    return found.unionByName(around).unionByName(before).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target")


def met(reads: DataFrame, writes: DataFrame, block: int | None = None) -> DataFrame:
    """(entity, source, target): each source that an entity reads with each target that it writes.

    Entities with over ``block`` reads are found by counts first; their reads are dealt into blocks, each of which meets a copy of the writes, so that
    no task holds a hub's whole product."""
    block = block or HUB_READS
    hubs = saved(reads.groupBy("entity").count().filter(F.col("count") > block).select("entity", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hubs")
    if hubs.isEmpty():
        return reads.join(writes, "entity").select("entity", "source", "target")
    dealt = reads.join(hubs, "entity", "left").withColumn("block", F.pmod(F.xxhash64("source"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    copied = writes.join(hubs, "entity", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return dealt.join(copied, ["entity", "block"]).select("entity", "source", "target")


def moved(pairs: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """The distinct ``pairs`` (source, target) of which some entity reads the source (entity, source) and writes the target (entity, target).

    Each pair asks the entities of the end that has fewer of them, so what all entities read (a volume) never meets all that was made from it."""
    fewer = F.col("readers") <= F.col("writers")
    readers = reads.groupBy("source").agg(F.count(F.lit(1)).alias("readers"))
    writers = writes.groupBy("target").agg(F.count(F.lit(1)).alias("writers"))
    pairs = saved(pairs.select("source", "target").distinct().join(readers, "source").join(writers, "target").withColumn("by_source", fewer).drop("readers", "writers"), "asked")
    by_source = pairs.filter("by_source").join(reads, "source").join(writes, ["entity", "target"], "left_semi")
    by_target = pairs.filter("not by_source").join(writes, "target").join(reads, ["entity", "source"], "left_semi")
    return by_source.select("source", "target").unionByName(by_target.select("source", "target")).distinct()


def through(reads: DataFrame, writes: DataFrame, direct: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The distinct pairs (source, target) behind ``reads`` (via, source) and ``writes`` (via, target), and those of ``direct``; none of a node with itself.

    Targets that have a ``via`` in common mostly have the same home (see ``_homes``). A ``via`` has its sources in one list, which goes once to each home of its
    targets; there a target's lists are taken together in one group, so pairs that occur often are never rows. A target whose lists have over ``most`` sources in
    all is met by pairs instead, which are told apart by both ends."""
    most = most or GROUP_SOURCES
    direct = reads.select("source", F.col("via").alias("target")).filter("false") if direct is None else direct.select("source", "target")
    reads, direct = reads.filter("source is not null"), direct.filter("source is not null")
    heavy, big, total, plain = _weights(reads, writes, direct, most)
    pairs = None
    if heavy is not None:
        own = writes.join(heavy, "target", "left_semi")
        pairs = met(reads.withColumnRenamed("via", "entity").distinct(), own.withColumnRenamed("via", "entity").distinct()).select("source", "target")
        pairs = pairs.unionByName(direct.join(heavy, "target", "left_semi").select("source", "target")).filter("source != target").distinct()
        writes, direct = (df.join(heavy, "target", "left_anti") for df in (writes, direct))
        reads = reads.join(writes.select("via").distinct(), "via", "left_semi")  # a list that only heavy targets would take is not made
    at = saved(_homes(writes, direct, big), "homes")
    ordered = F.sort_array(F.collect_set("source"))  # lists in order compress better, and texts better than arrays
    lists = reads.groupBy("via").agg((F.array_join(ordered, "\n") if plain else ordered).alias("sources"))
    sent = at.filter("via is not null").repartition("via").groupBy("via", "home").agg(F.collect_list("target").alias("targets")).join(lists, "via").select("home", "targets", "sources")
    sent = sent.unionByName(at.filter("via is null").select("home", F.array("target").alias("targets"), (F.col("source") if plain else F.array("source")).alias("sources")))
    here = sent.repartition(max(1, -(-total // TASK_SOURCES)), "home").select("home", F.explode("targets").alias("target"), "sources")
    together = here.groupBy("home", "target").agg(F.collect_list("sources").alias("lists"))
    every = F.split(F.array_join("lists", "\n"), "\n") if plain else F.flatten("lists")
    found = together.select(F.explode(F.array_distinct(every)).alias("source"), "target").filter("source != target")
    return found if pairs is None else found.unionByName(pairs)


def _homes(writes: DataFrame, direct: DataFrame, big: DataFrame | None) -> DataFrame:
    """(target, via, source, home) of both: a target's home is the least hash of what leads to it, a target that nothing leads to is at home by itself.

    A home has the targets of one ``via`` at most, and of ``big`` ones (via), which have many, none."""
    led = writes.select("target", "via", F.lit(None).cast("string").alias("source"), F.hash("via").alias("near"))
    if big is not None:
        led = led.join(big.withColumn("big", F.lit(True)), "via", "left").select("target", "via", "source", F.when(F.col("big").isNull(), F.col("near")).alias("near"))
    every = led.unionByName(direct.select("target", F.lit(None).cast("string").alias("via"), "source", F.lit(None).cast("int").alias("near")))
    home = F.coalesce(F.min("near").over(Window.partitionBy("target")), F.hash("target"))  # the order by names makes the table small
    return every.select("target", "via", "source", home.alias("home"))


def _weights(reads: DataFrame, writes: DataFrame, direct: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None, int, bool]:
    """Of ``through``: (target) with over ``most`` sources, repeats included, (via) with over HOME_TARGETS targets, each None if there are none, the sources of all other targets, and
    whether no source's name has a line break. The largest numbers of rows of an end, taken by its hash and so never too small, mostly tell."""
    broken = F.col("source").contains("\n").cast("int").alias("broken")
    by = [df.select(F.lit(of).alias("of"), F.hash(of).alias("end"), *(F.lit(int(n == own)).alias(n) for n in ("r", "w", "d")), F.lit(0).alias("broken") if own == "w" else broken) for df, of, own in ((reads, "via", "r"), (writes, "via", "w"), (writes, "target", "w"), (direct, "target", "d"))]
    ends = by[0].unionByName(by[1]).unionByName(by[2]).unionByName(by[3]).groupBy("of", "end").agg(*(F.sum(n).alias(n) for n in ("r", "w", "d")), F.max("broken").alias("broken"))
    most_of = [F.max(n).alias(n) for n in ("r", "w", "d", "broken")]
    at = {r["of"]: r for r in ends.groupBy("of").agg(*most_of, F.sum(F.col("r") * F.col("w") + F.col("d")).alias("all")).collect()}  # two rows
    via, target = (at.get(of) or {"r": 0, "w": 0, "d": 0, "broken": 0, "all": 0} for of in ("via", "target"))
    big = saved(writes.groupBy("via").count().filter(F.col("count") > HOME_TARGETS).select("via"), "big") if via["w"] > HOME_TARGETS else None
    heavy, total = None, via["all"] + target["all"]
    if via["r"] * target["w"] + target["d"] > most:
        counts = reads.groupBy("via").agg(F.count(F.lit(1)).alias("n"))
        sizes = writes.join(counts, "via").select("target", "n").unionByName(direct.select("target", F.lit(1).cast("long").alias("n")))
        sizes = saved(sizes.groupBy("target").agg(F.sum("n").alias("n")), "sizes")
        heavy = saved(sizes.filter(F.col("n") > most).select("target"), "heavy")
        heavy = None if heavy.isEmpty() else heavy
        total = sizes.filter(F.col("n") <= most).agg(F.sum("n")).first()[0] or 0
    return heavy, big, total, not (via["broken"] or target["broken"])


def table_nodes(edges: DataFrame) -> DataFrame:
    """(node): the ends of ``table_view``, without its pairs. An entity's source or target counts if it meets another node."""
    source, target = is_entity(F.col("source")), is_entity(F.col("target"))
    reads = edges.filter(~source & target).select("source", F.col("target").alias("via"))
    writes = edges.filter(source & ~target).select(F.col("source").alias("via"), "target")

    # an entity with two sources and two targets shows them all; only what the others read and write is looked at by pairs
    near = lambda end, *no: [f(F.hash(end)).alias(f"{end}_{i}") for i, f in enumerate((F.min, F.max))] + [F.lit(None).cast("int").alias(n) for n in no]
    told = reads.groupBy("via").agg(*near("source", "target_0", "target_1")).unionByName(writes.groupBy("via").agg(*near("target", "source_0", "source_1")))
    told = told.groupBy("via").agg(*(F.max(c).alias(c) for c in told.columns[1:]))
    few = saved(told.filter(~F.coalesce(F.expr("source_0 < source_1 AND target_0 < target_1"), F.lit(False))).select("via"), "few")
    lone = reads.join(few, "via", "left_semi").distinct().join(writes.join(few, "via", "left_semi").distinct(), "via").filter("source != target")
    direct = edges.filter(~source & ~target).select("source", "target").unionByName(lone.select("source", "target"))
    shown = [df.join(few, "via", "left_anti").select(F.col(end).alias("node")) for df, end in ((reads, "source"), (writes, "target"))]
    return direct.select(F.explode(F.array("source", "target")).alias("node")).unionByName(shown[0]).unionByName(shown[1]).distinct()


def table_view(edges: DataFrame, prefix: str | None = None) -> DataFrame:
    """Edges between tables: the direct ones, and each source of an entity to each of its targets; with ``prefix`` only those with an end whose name begins so."""
    source, target = is_entity(F.col("source")), is_entity(F.col("target"))
    direct = edges.filter(~source & ~target).select("source", "target")
    reads = edges.filter(~source & target).select("source", F.col("target").alias("via"))
    writes = edges.filter(source & ~target).select(F.col("source").alias("via"), "target")
    if prefix is None:
        found = through(reads, writes, direct)
    else:
        # pairs outside are never made: targets inside meet all sources, the others only sources inside
        inside = lambda end: F.col(end).startswith(prefix)
        reads, writes, direct = saved(reads, "reads"), saved(writes, "writes"), saved(direct.filter(inside("source") | inside("target")), "direct")
        found = through(reads, writes.filter(inside("target")), direct.filter(inside("target")))
        found = found.unionByName(through(reads.filter(inside("source")), writes.filter(~inside("target")), direct.filter(~inside("target"))))
    return found.unionByName(direct.filter("source = target").distinct())


def pipeline_view(edges: DataFrame) -> DataFrame:
    """Edges between entities: one writes a table that another reads."""
    source, target = is_entity(F.col("source")), is_entity(F.col("target"))
    writes = edges.filter(source & ~target).select(F.col("target").alias("via"), "source")
    reads = edges.filter(~source & target).select(F.col("source").alias("via"), "target")
    return through(writes, reads)


def view(edges: DataFrame, mode: str) -> DataFrame:
    """``full``, ``table`` or ``pipeline``."""
    return {"full": lambda e: e.select("source", "target"), "table": table_view, "pipeline": pipeline_view}[mode](edges)


def degrees(nodes: DataFrame, edges: DataFrame, *, ready: bool = False) -> DataFrame:
    """(node, upstream_count, downstream_count, lineage_status) of table nodes, by all edges that end or start at them. ``ready`` edges are distinct already."""
    edges = edges.select("source", "target") if ready else edges.select("source", "target").distinct()
    ends = edges.select(F.col("target").alias("node"), F.lit(1).alias("u"), F.lit(0).alias("d")).unionByName(edges.select(F.col("source").alias("node"), F.lit(0).alias("u"), F.lit(1).alias("d")))
    counts = ends.groupBy("node").agg(F.sum("u").alias("upstream_count"), F.sum("d").alias("downstream_count"))
    out = nodes.select("node").filter(~is_entity(F.col("node"))).distinct().join(counts, "node", "left").na.fill(0)
    up, down = F.col("upstream_count") > 0, F.col("downstream_count") > 0
    status = F.when(up & down, "connected").when(down, "root").when(up, "leaf").otherwise("orphan")
    return out.withColumn("lineage_status", status)


def highlight(edges: DataFrame, node: str) -> DataFrame:
    """What is lit up for a node: its whole closure both ways; for an entity its direct neighbours."""
    hops = 1 if node.startswith("entity:") else None
    edges = saved(prepared(edges), "edges")
    return ancestors(edges, node, hops, ready=True).select("node").unionByName(descendants(edges, node, hops, ready=True).select("node")).distinct()


def isolate(edges: DataFrame, selected: str, target: str) -> DataFrame:
    """Nodes on paths from ``selected`` to ``target``, and the target."""
    edges = saved(prepared(edges), "edges")
    on = ancestors(edges, target, None, ready=True).select("node").join(descendants(edges, selected, None, ready=True).select("node"), "node", "left_semi")
    return on.unionByName(seed_of(edges, target)).distinct()


def undirected_ball(edges: DataFrame, seeds: DataFrame, max_hops: int = 6) -> DataFrame:
    """(node, depth) within some hops, whichever way edges point."""
    return reach(edges.select("source", "target").unionByName(reversed_edges(edges)), seeds, max_hops)


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): longest path from a root; edges that lead back inside a cycle are left out first (see ``acyclic``).

    Nodes are taken off in rounds, those first that no edge leads to: a node's round is its layer, and each edge is met once, when its source goes.
    Only a graph of which something is left that way is searched for cycles. Nodes are those of the edges."""
    edges = saved(prepared(edges), "edges")
    found = peeled(edges)
    if found is None:
        found = peeled(saved(acyclic(edges), "edges"))
    return found


def numbered(nodes: DataFrame) -> tuple[DataFrame, bool]:
    """Distinct ``nodes`` (node) with a number ``id`` each, and whether it is their hash; it is not if two nodes share one."""
    out = saved(nodes.select("node", F.xxhash64("node").alias("id")), "nodes")
    if out.groupBy("id").count().filter("count > 1").isEmpty():
        return out, True
    return saved(nodes.select("node", F.monotonically_increasing_id().alias("id")), "nodes"), False


def nodes_of(edges: DataFrame) -> DataFrame:
    """(node): all ends, with repeats."""
    return edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))


def by_number(edges: DataFrame, others: DataFrame | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """(node, id) of all nodes, the edges by numbers (s, t), and whether numbers are hashes: rounds over them move numbers and no names.

    ``others`` are pairs (source, target) whose nodes are numbered too."""
    nodes, hashed = numbered((nodes_of(edges) if others is None else nodes_of(edges).unionByName(nodes_of(others))).distinct())
    return nodes, saved(in_numbers(edges, nodes, hashed).select("s", "t"), "pairs"), hashed


def in_numbers(pairs: DataFrame, nodes: DataFrame, hashed: bool) -> DataFrame:
    """``pairs`` (source, target) with the numbers s and t of their ends, which are null where ``nodes`` (node, id) has none; hashes need no look there."""
    if hashed:
        return pairs.withColumns({"s": F.xxhash64("source"), "t": F.xxhash64("target")})
    ends = [nodes.select(F.col("node").alias(end), F.col("id").alias(to)) for end, to in (("source", "s"), ("target", "t"))]
    return pairs.join(ends[0], "source", "left").join(ends[1], "target", "left")


def peeled(edges: DataFrame) -> DataFrame | None:
    """(node, layer) of prepared ``edges``; None if they have a cycle."""
    nodes, pairs, _ = by_number(edges)
    layer = rounds(pairs)
    return None if layer is None else nodes.join(layer, "id").select("node", "layer")


def rounds(pairs: DataFrame) -> DataFrame | None:
    """(id, layer) of pairs (s, t): the round in which no edge from what is left leads to a node; None if that never comes for some.

    A round counts the edges from the nodes that went last down from their targets' numbers of edges; nodes that have none left go next."""
    into = pairs.groupBy(F.col("t").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    state, left = saved_with_count(pairs.select(F.col("s").alias("id")).distinct().join(into, "id", "full").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n")), "open")
    found, layer = None, 0
    while left:
        gone = state.filter("n = 0").select("id", F.lit(layer).alias("layer"))
        if gone.isEmpty():
            return None
        found = gone if found is None else found.unionByName(gone)
        less = pairs.join(gone.select(F.col("id").alias("s")), "s", "left_semi").groupBy(F.col("t").alias("id")).agg(F.count(F.lit(1)).alias("less"))
        state, left = saved_with_count(state.filter("n > 0").join(less, "id", "left").select("id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")), "open")
        layer += 1
        found = saved(found, "layers") if layer % LONG == 0 else found
    return pairs.select(F.col("s").alias("id"), F.lit(0).alias("layer")).filter("false") if found is None else found


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without predecessors or without successors are peeled off until none is left to peel."""
    core, n = saved_with_count(edges, "core")
    while n:
        inner = core.join(core.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(core.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        before = n
        core, n = saved_with_count(inner, "core")
        if n == before:
            break
    return core


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node on a cycle the smallest node that it reaches and that reaches it.

    Every round handles all components that it can at once: each node takes the smallest node that reaches it as its colour, carried forward along the
    edges; a node that has its own name as colour is the first of its component, and what reaches it backwards within the colour is the rest. These are
    taken out, the remains are trimmed, and the next round begins. All state lies in tables; nothing is collected but counts."""
    live = on_cycles(saved(prepared(edges), "edges"))
    found = live.select(F.col("source").alias("node"), F.col("source").alias("component")).filter("false")
    while not live.isEmpty():
        colour = cut(live.select(F.col("source").alias("node")).distinct().withColumn("colour", F.col("node")))
        moved = True
        while moved:
            start = colour.select("node", F.col("colour").alias("had"))
            for _ in range(ROUNDS_PER_JOB):
                carried = live.join(colour.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("least"))
                colour = colour.join(carried, "node", "left").select("node", F.least("colour", F.coalesce("least", "colour")).alias("colour"))
            colour = cut(colour)
            moved = not colour.join(start, "node").filter("colour != had").isEmpty()
        ends = colour.select(F.col("node").alias("source"), F.col("colour").alias("of")), colour.select(F.col("node").alias("target"), F.col("colour").alias("to"))
        within = live.join(ends[0], "source").join(ends[1], "target").filter("of = to").select("source", "target")
        first = colour.filter("node = colour").select("node")
        own = cut(reach(reversed_edges(within), first).select("node").join(colour, "node").withColumnRenamed("colour", "component"))
        alone = live.join(own.withColumnRenamed("node", "source"), "source").join(own.select(F.col("node").alias("target"), F.col("component").alias("other")), "target").filter("component = other").select("component").distinct()
        found = found.unionByName(own.join(alone, "component", "left_semi").select("node", "component"))
        gone = own.select("node")
        rest = live.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
        live = on_cycles(rest)
    return found


def acyclic(edges: DataFrame) -> DataFrame:
    """``edges`` without those that lead back: inside a strong component only edges that lead away from its smallest node, by hops, are kept.

    The rest is acyclic: between components there are no cycles, and inside one every kept edge goes one hop further from its first node."""
    edges = saved(prepared(edges), "edges")
    member = saved(strong_components(edges), "components")
    if member.isEmpty():
        return edges
    inner = edges.join(member.withColumnRenamed("node", "source"), "source").join(member.select(F.col("node").alias("target"), F.col("component").alias("other")), "target").filter("component = other").select("source", "target")
    inner = saved(inner, "inner")
    away = reach(inner, member.select(F.col("component").alias("node")).distinct())
    back = inner.join(away.select(F.col("node").alias("source"), F.col("depth").alias("a")), "source").join(away.select(F.col("node").alias("target"), F.col("depth").alias("b")), "target").filter("a >= b").select("source", "target")
    return edges.join(back, ["source", "target"], "left_anti")
