"""An index for repeated traces: interval labels that tell at once what a node reaches, and what reaches it.

Cycles are condensed to one node each. A spanning forest of the layered graph (every node under a predecessor of the layer above) numbers the nodes so that
a subtree is one interval of numbers. What a node reaches is then a short list of intervals: its own subtree and the lists of its successors, united from the
deepest layer upwards. A list is bounded: the longest ``most`` intervals stay exact, the rest is covered by at most as many wider ones, which may hold numbers
that are not reached. A number in an exact interval is reached, one in no interval is not, and only what lies in a wider one alone is walked to.

The index is made once (two jobs a layer); a trace is then one lookup, and a walk over the nodes that are left open. Of many pairs those that are left open are
settled together: 64 sources share a word of bits, and words go down the layers once. It tells whether, not how far. Pairs that are asked only once need no
index: ``reaching`` sends the words of all their sources down.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.plans.durable import saved, saved_with_count

#: Exact intervals of a node, and as many wider ones: every list meets all predecessors, so it is short; layers after which their tables become one, so that plans stay short.
MOST, LAYERS_A_TABLE = 1, 16
#: Sources in a word of bits.
BITS = 64


@dataclass(frozen=True)
class Index:
    """Saved tables: members (node, comp), numbers (comp, layer, pre), labels (comp, lo, hi, exact), edges (source, target) between components."""

    members: DataFrame
    numbers: DataFrame
    labels: DataFrame
    edges: DataFrame
    cyclic: bool

    def of(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (node, ...) with their component."""
        return nodes.join(self.members, "node")

    def descendants(self, node: str) -> DataFrame:
        """(node): what ``node`` reaches, itself included; without rows if no edge has it."""
        own = self.of(graph.seed_of(self.edges, node)).select("comp")
        lists = self.labels.join(F.broadcast(own), "comp").select("lo", "hi", "exact")  # the list of one node, which is bounded
        return self._settled(self.numbers.join(F.broadcast(lists), F.col("pre").between(F.col("lo"), F.col("hi"))), own, "source", "target")

    def ancestors(self, node: str) -> DataFrame:
        """(node): what reaches ``node``, itself included; without rows if no edge has it."""
        own = self.of(graph.seed_of(self.edges, node)).select("comp")
        number = self.numbers.join(F.broadcast(own), "comp").select("pre")  # one row
        return self._settled(self.labels.join(F.broadcast(number), F.col("pre").between(F.col("lo"), F.col("hi"))), own, "target", "source")

    def _settled(self, told: DataFrame, own: DataFrame, start: str, end: str) -> DataFrame:
        """The nodes of the components that ``told`` (comp, exact) is sure of, and of those among the open ones that a walk from the sure ones finds."""
        found = saved(told.groupBy("comp").agg(F.max("exact").alias("exact")), "told")
        sure = found.filter("exact").select("comp")
        open_, n = saved_with_count(found.filter("not exact").select("comp").join(own, "comp", "left_anti"), "open")
        if n:
            # behind the last sure node of a path all nodes are open: only edges into open nodes are walked
            along = self.edges.join(open_.withColumnRenamed("comp", end), end, "left_semi").select(F.col(start).alias("source"), F.col(end).alias("target"))
            seeds = sure.unionByName(own).distinct().withColumnRenamed("comp", "node")
            sure = graph.reach(saved(along, "edges"), seeds, ready=True).withColumnRenamed("node", "comp").select("comp")
        return self.members.join(sure.unionByName(own).distinct(), "comp", "left_semi").select("node")

    def reaches(self, pairs: DataFrame) -> DataFrame:
        """(source, target, reaches) of all distinct ``pairs`` (source, target) without nulls; a node reaches itself, and one that no edge has nothing else.

        Pairs that the labels leave open are settled by one pass down the layers for all their sources."""
        pairs = saved(pairs.select("source", "target").dropna().distinct(), "pairs")
        ends = [self.members.select(F.col("node").alias(end), F.col("comp").alias(to)) for end, to in (("source", "comp"), ("target", "to"))]
        asked = pairs.join(ends[0], "source").join(ends[1], "target").select("comp", "to").distinct()
        asked = saved(asked.join(self.numbers.select(F.col("comp").alias("to"), "pre"), "to").select("comp", "to", "pre"), "asked")
        told = asked.filter("comp != to").join(self.labels, "comp").filter(F.col("pre").between(F.col("lo"), F.col("hi")))
        told = saved(told.groupBy("comp", "to").agg(F.max("exact").alias("exact"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "told")
        yes = asked.filter("comp = to").select("comp", "to").unionByName(told.filter("exact").select("comp", "to"))
        open_, n = saved_with_count(told.filter("not exact"), "open")
        if n:
            yes = yes.unionByName(self._carried(open_))
        yes = yes.distinct().withColumn("yes", F.lit(True))
        told = pairs.join(ends[0], "source", "left").join(ends[1], "target", "left").join(yes, ["comp", "to"], "left")
        return told.select("source", "target", (F.coalesce("yes", F.lit(False)) | (F.col("source") == F.col("target"))).alias("reaches"))

    def _carried(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (comp, to, lo, hi) of which comp reaches to.

        Sources that may reach the same numbers are neighbours in ``lo`` and ``hi``, so they share words; a word is carried down to the layer above its last target."""
        width = pairs.groupBy("comp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        dealt = saved(width.repartitionByRange("lo", "hi", "comp").sortWithinPartitions("lo", "hi", "comp").withColumn("n", F.monotonically_increasing_id()), "dealt")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("n", F.lit(BITS)).cast("int"))
        dealt = dealt.select("comp", F.floor(F.col("n") / BITS).alias("word"), bit.alias("bit"))
        layer = self.numbers.select("comp", "layer")
        asked = saved(pairs.select("comp", "to").join(dealt, "comp").join(layer.withColumnRenamed("comp", "to").withColumnRenamed("layer", "at"), "to").select("comp", "to", "word", "bit", "at"), "asked")
        last = asked.groupBy("word").agg(F.max("at").alias("last"))
        start = saved(dealt.join(last, "word").join(layer, "comp").groupBy("comp", "word", "last", "layer").agg(F.bit_or("bit").alias("bits")), "start")
        ends = [layer.select(F.col("comp").alias(end), F.col("layer").alias(at)) for end, at in (("source", "above"), ("target", "layer"))]
        # a node takes in what all its predecessors hold when its layer comes: every edge carries a word once
        along = saved(self.edges.join(ends[0], "source").join(ends[1], "target").select("source", "target", "above", "layer"), "along")
        first, deepest = start.agg(F.min("layer")).first()[0], asked.agg(F.max("at")).first()[0]
        held = None
        for at in range(first, deepest + 1):
            here = start.filter(F.col("layer") == at).select("comp", "word", "last", "bits")
            if held is not None:
                into = along.filter((F.col("layer") == at) & (F.col("above") >= first)).select(F.col("source").alias("comp"), "target")
                here = here.unionByName(into.join(held.filter(F.col("last") >= at), "comp").select(F.col("target").alias("comp"), "word", "last", "bits"))
            here = graph.cut(here.groupBy("comp", "word", "last").agg(F.bit_or("bits").alias("bits")))
            held = here if held is None else held.unionByName(here)
            held = saved(held, "held") if (at - first + 1) % LAYERS_A_TABLE == 0 else held
        met = asked.join(held.select(F.col("comp").alias("to"), "word", "bits"), ["to", "word"])
        return met.filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("comp", "to")


def reaching(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, reaches) as ``Index.reaches`` has it, without an index: every source's bit goes down the layers once, 64 sources in a word.

    Sources with neighbouring names share a word, as they mostly feed the same nodes; that matters for the work alone, not for the answer."""
    pairs = saved(pairs.select("source", "target").dropna().distinct(), "pairs")
    edges = saved(graph.prepared(edges), "edges")
    nodes, along, hashed = graph.by_number(edges, pairs)
    layer = graph.rounds(along)
    if layer is None:  # cycles: components take the place of nodes
        members, between, layered, _ = _condensed(edges)
        nodes, hashed = members.select("node", F.col("comp").alias("id")), False
        along, layer = between.select(F.col("source").alias("s"), F.col("target").alias("t")), layered.select(F.col("node").alias("id"), "layer")
    layer = saved(layer, "layers")
    asked = graph.in_numbers(pairs, nodes, hashed)
    first = asked.filter("s != t").select("source", "s").distinct().groupBy("s").agg(F.min("source").alias("source"))
    dealt = saved(first.repartitionByRange("source", "s").sortWithinPartitions("source", "s").withColumn("n", F.monotonically_increasing_id()), "dealt")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("n", F.lit(BITS)).cast("int"))
    dealt = dealt.select("s", F.floor(F.col("n") / BITS).alias("word"), bit.alias("bit"))
    start = saved(dealt.join(layer.withColumnRenamed("id", "s"), "s").groupBy(F.col("s").alias("id"), "word", "layer").agg(F.bit_or("bit").alias("bits")), "start")
    along = saved(along.join(layer.withColumnRenamed("id", "t"), "t"), "along", ["layer"])
    top, deepest = start.agg(F.min("layer")).first()[0], layer.agg(F.max("layer")).first()[0]
    held = start.select("id", "word", "bits").filter("false")
    for at in range(top, deepest + 1) if top is not None else ():
        into = along.filter(F.col("layer") == at).select(F.col("s").alias("id"), "t")
        here = start.filter(F.col("layer") == at).select("id", "word", "bits").unionByName(into.join(held, "id").select(F.col("t").alias("id"), "word", "bits"))
        held = held.unionByName(graph.cut(here.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))))
        held = saved(held, "held") if (at - top + 1) % LAYERS_A_TABLE == 0 else held
    met = asked.join(dealt, "s", "left").join(held.withColumnRenamed("id", "t"), ["t", "word"], "left")
    yes = F.coalesce(F.col("s") == F.col("t"), F.lit(False)) | F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return met.select("source", "target", (yes | (F.col("source") == F.col("target"))).alias("reaches"))


def united(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """(*keys, lo, hi, exact): for each key at most ``most`` exact intervals, the longest, and at most ``most`` wider ones that cover the rest.

    Wider ones are parted at the largest gaps."""
    by = Window.partitionBy(*keys, "exact").orderBy("lo", "hi")
    gap = F.col("lo") - F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))

    def merged(of: DataFrame, new: Column) -> DataFrame:
        parted = of.withColumn("part", F.sum(F.when(new, 1).otherwise(0)).over(by))
        return parted.groupBy(*keys, "exact", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("part")

    whole = merged(rows.select(*keys, "lo", "hi", "exact").withColumn("gap", gap), F.col("gap").isNull() | (F.col("gap") > 1))
    longest = Window.partitionBy(*keys, "exact").orderBy((F.col("lo") - F.col("hi")), "lo")
    kept = whole.withColumn("exact", F.col("exact") & (F.row_number().over(longest) <= most))
    kept = kept.withColumn("gap", gap)
    widest = Window.partitionBy(*keys, "exact").orderBy(F.col("gap").desc_nulls_first(), "lo")
    return merged(kept.withColumn("rank", F.row_number().over(widest)), F.col("exact") | (F.col("rank") <= most)).select(*keys, "lo", "hi", "exact")


def running(rows: DataFrame, key: str, order: str, value: str, block: int) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over rows of the same key that come earlier.

    A key's rows are dealt into blocks of some ``block`` rows by the hash of ``order``: sums run over a key's blocks and inside each block, so no task sorts a hot key whole."""
    many = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = rows.join(many, key).withColumn("block", F.pmod(F.xxhash64(order), F.col("blocks"))).drop("blocks")
    dealt = saved(dealt, "dealt")
    earlier = (Window.unboundedPreceding, -1)
    sums = dealt.groupBy(key, "block").agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(Window.partitionBy(key).orderBy("block").rowsBetween(*earlier)), F.lit(0))).drop("_s")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(key, "block").orderBy(order).rowsBetween(*earlier)), F.lit(0))
    return dealt.withColumn("_in", inside).join(sums, [key, "block"]).withColumn("before", F.col("_base") + F.col("_in")).drop("_base", "_in", "block")


def _condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(node, comp) of all nodes, the distinct edges between different components, (node, layer) of the components that these have, and whether there are cycles."""
    found = graph.peeled(edges)
    if found is not None:
        layer = saved(found, "layers")
        return layer.select("node", F.col("node").alias("comp")), edges, layer, False
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    found = saved(graph.strong_components(edges), "components")
    members = saved(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "members")
    ends = [members.select(F.col("node").alias(end), F.col("comp").alias(to)) for end, to in (("source", "s"), ("target", "t"))]
    between = edges.join(ends[0], "source").join(ends[1], "target").filter("s != t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct()
    between = saved(between, "edges")
    return members, between, saved(graph.peeled(between), "layers"), True


def _forest(members: DataFrame, edges: DataFrame, layer: DataFrame) -> DataFrame:
    """(comp, layer, parent): the parent is the predecessor of the layer above with the smallest name, null for roots."""
    at = [layer.select(F.col("node").alias(end), F.col("layer").alias(to)) for end, to in (("source", "above"), ("target", "layer"))]
    over = edges.join(at[0], "source").join(at[1], "target").filter("above + 1 = layer").groupBy(F.col("target").alias("comp")).agg(F.min("source").alias("parent"))
    comps = members.select("comp").distinct().join(layer.withColumnRenamed("node", "comp"), "comp", "left").na.fill(0, ["layer"])
    return saved(comps.join(over, "comp", "left"), "forest")


def _numbered(forest: DataFrame, deepest: int, block: int) -> DataFrame:
    """(comp, layer, pre, size): numbers from 0 such that a subtree has ``size`` numbers from ``pre``."""
    below, sized = None, None
    for layer in range(deepest, -1, -1):
        here = forest.filter(F.col("layer") == layer).select("comp", "layer", "parent")
        if below is None:
            here = here.withColumn("size", F.lit(1).cast("long"))
        else:
            sums = below.filter("parent is not null").groupBy(F.col("parent").alias("comp")).agg(F.sum("size").alias("under"))
            here = here.join(sums, "comp", "left").select("comp", "layer", "parent", (F.coalesce("under", F.lit(0)) + 1).alias("size"))
        below = graph.cut(here)
        sized = below if sized is None else sized.unionByName(below)
    placed = running(sized.withColumn("under", F.coalesce("parent", F.lit(""))), "under", "comp", "size", block)
    # a number is the sum of the offsets up to the root: sums over twice as many steps in each round
    jump = saved(placed.select("comp", "layer", "size", F.col("parent").alias("up"), (F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1)).alias("pre")), "jump")
    steps = 1
    while steps <= deepest:
        over = jump.select(F.col("comp").alias("up"), F.col("up").alias("next"), F.col("pre").alias("more"))
        jump = saved(jump.join(over, "up", "left").select("comp", "layer", "size", F.col("next").alias("up"), (F.col("pre") + F.coalesce("more", F.lit(0))).alias("pre")), "jump")
        steps *= 2
    return jump.select("comp", "layer", "pre", "size")


def build(edges: DataFrame, most: int = MOST, block: int | None = None) -> Index:
    """The index of edges (source, target); nulls and self-loops are left out, repeats count once, other columns are ignored. No edges give an empty index.

    Successors of a node with over ``block`` of them are united in blocks of neighbouring numbers before they meet."""
    block = block or graph.HUB_READS
    members, between, layered, cyclic = _condensed(saved(graph.prepared(edges), "edges"))
    forest = _forest(members, between, layered)
    deepest = forest.agg(F.max("layer")).first()[0]
    if deepest is None:
        numbers = forest.select("comp", "layer", F.lit(0).cast("long").alias("pre"))
        return Index(members, numbers, numbers.select("comp", F.col("pre").alias("lo"), F.col("pre").alias("hi"), F.lit(True).alias("exact")), between, cyclic)
    numbers = saved(_numbered(forest, deepest, block), "numbers")
    own = numbers.select("comp", F.col("pre").alias("lo"), (F.col("pre") + F.col("size") - 1).alias("hi"), F.lit(True).alias("exact"), "layer")
    # edges along the forest add nothing to the subtree's interval itself, but the child's list does
    at = numbers.select(F.col("comp").alias("source"), "layer"), numbers.select(F.col("comp").alias("target"), "pre")
    degree = between.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    total = numbers.count()
    placed = between.join(degree, "source").join(at[0], "source").join(at[1], "target").withColumn("block", F.floor(F.col("pre") * F.col("blocks") / F.lit(total)))
    placed = saved(placed.select("source", "target", "layer", "block", (F.col("blocks") > 1).alias("hub")), "placed")
    hubs = not placed.filter("hub").isEmpty()
    labels = None
    for layer in range(deepest, -1, -1):
        mine = own.filter(F.col("layer") == layer).drop("layer")
        if labels is None:
            labels = graph.cut(mine)
            continue
        got = placed.filter(F.col("layer") == layer).join(labels.withColumnRenamed("comp", "target"), "target").select(F.col("source").alias("comp"), "block", "hub", "lo", "hi", "exact")
        if hubs:
            crowded = united(got.filter("hub").select("comp", "block", "lo", "hi", "exact").distinct(), ["comp", "block"], most)
            got = got.filter("not hub").select("comp", "lo", "hi", "exact").unionByName(crowded.drop("block"))
        rows = got.select("comp", "lo", "hi", "exact").unionByName(mine).distinct()
        labels = labels.unionByName(graph.cut(united(rows, ["comp"], most)))
        labels = saved(labels, "labels") if layer % LAYERS_A_TABLE == 0 else labels
    return Index(members, numbers.select("comp", "layer", "pre"), labels, between, cyclic)
