"""Cycles as lists of nodes: of small graphs in blocks by tasks, of others set at a time."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from threadloom.functions.tables import bounded, forget, store
from threadloom.operators import blocks
from threadloom.operators.graph import pairs, strong_components


def from_least(cycle: Column) -> Column:
    """The same cycle, begun at its least node."""
    k = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, k, F.size(cycle) - k + 1), F.slice(cycle, F.lit(1), k - 1))


def _inside(edges: DataFrame, only: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(nodes on cycles with their component, the edges between nodes of one component)."""
    e = store(pairs(edges), "edges")
    parts = strong_components(e).select("node", "component")
    alone = e.where("src = dst").select(F.col("src").alias("node")).join(parts, "node", "left_anti")
    nodes = parts.unionByName(alone.withColumn("component", F.col("node")))
    if only is not None:
        wanted = nodes.join(only.select("node").distinct(), "node", "left_semi").select("component").distinct()
        nodes = nodes.join(wanted, "component", "left_semi").select("node", "component")
    nodes = store(nodes, "members")
    a, b = nodes.toDF("src", "component"), nodes.toDF("dst", "other")
    return nodes, store(e.join(a, "src").join(b, "dst").where(F.col("component") == F.col("other")).select("component", "src", "dst"), "inside")


def _contracted(nodes: DataFrame, inside: DataFrame) -> DataFrame:
    """(component, src, dst, via): edges between anchors, with the nodes passed on the way.

    A node with one edge in and one out is passed, unless it is the least of its component. Which chain it is part of, and its distance
    from that chain's end, takes rounds by the logarithm of the longest chain; then each chain is put together once.
    """
    least = nodes.groupBy("component").agg(F.min("node").alias("node")).select("node")
    single = lambda c: inside.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    passed = store(single("src").join(single("dst"), "node", "left_semi").join(least, "node", "left_anti"), "passed")
    onward = passed.withColumnRenamed("node", "dst").withColumn("on", F.lit(True))
    after = inside.join(passed.withColumnRenamed("node", "src"), "src", "left_semi").join(onward, "dst", "left")
    after = store(after.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.coalesce("on", F.lit(False)).alias("on")), "after")
    hop = store(after.select("node", F.when(F.col("on"), F.col("next")).otherwise(F.col("node")).alias("end"), F.col("on").cast("long").alias("steps")), "hops")
    while True:
        further = hop.select(F.col("node").alias("end"), F.col("end").alias("to"), F.col("steps").alias("more"))
        longer = hop.join(further, "end").select("node", F.col("to").alias("end"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("to") != F.col("end")).alias("moved"))
        longer = store(longer, "hops")
        hop = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    places = F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "node")))
    chains = hop.groupBy("end").agg(F.transform(places, lambda x: x["node"]).alias("via"))
    leaves = after.where("not on").select(F.col("node").alias("end"), F.col("next").alias("dst"))
    chains = chains.join(leaves, "end").select(F.col("via")[0].alias("first"), "dst", "via")
    from_anchor = inside.join(passed.withColumnRenamed("node", "src"), "src", "left_anti")
    direct = from_anchor.join(onward, "dst", "left_anti").select("component", "src", "dst")
    around = from_anchor.withColumnRenamed("dst", "first").join(chains, "first").select("component", "src", "dst", "via")
    none = F.array().cast(around.schema["via"].dataType)
    return store(direct.withColumn("via", none).unionByName(around), "contracted")


def cycle_lists(edges: DataFrame, most: int = 20, only: DataFrame | None = None, near: str | None = None) -> DataFrame:
    """(component, place, cycle, more): of each strong component the first `most` elementary cycles, and whether it has more.

    A cycle is the list of its nodes from the least one on; cycles are ordered by their number of nodes, then by the list, so
    rotations of one cycle are one row. A self edge is a cycle of one node. With `only` (a column `node`), cycles without
    any of those nodes don't count. `near` is a hint as for strong_components.

    Groups of edges that lie apart, and else components, are solved in blocks by tasks while they have at most blocks.LARGEST edges.
    """
    done, rest = None, edges
    if near is not None:
        e = edges.where("src is not null and dst is not null").select(F.xxhash64(near).alias("group"), "src", "dst")
        closed, rest = blocks.apart(store(e, "edges"))
        done = _solved(closed, most, only)
        if rest is None:
            return done
    nodes, inside = _inside(rest, only)
    few, large = blocks.small(inside.withColumnRenamed("component", "group"))
    found = _solved(few, most, only)
    if large is not None:
        walked = large.withColumnRenamed("group", "component")
        found = found.unionByName(_walked(nodes.join(walked.select("component").distinct(), "component", "left_semi"), store(walked, "large"), most, only))
    return found if done is None else done.unionByName(found)


def _solved(e: DataFrame, most: int, only: DataFrame | None) -> DataFrame:
    """The lists of (group, src, dst), whose groups share no node and are small."""
    kind = e.schema["src"].dataType.simpleString()
    e = e.select("group", "src", "dst")
    if only is not None:
        mark = only.select(F.col("node").alias("src")).distinct().withColumn("marked", F.lit(True))
        e = e.join(mark, "src", "left").select("group", "src", "dst", F.coalesce("marked", F.lit(False)).alias("marked"))
    return store(blocks.solved(e, functools.partial(blocks.cycles, most), f"component {kind}, place int, cycle array<{kind}>, more boolean"), "cycles")


def _walked(nodes: DataFrame, inside: DataFrame, most: int, only: DataFrame | None) -> DataFrame:
    """The lists of components of (component, src, dst) with their nodes, set at a time.

    Walks start at each node that some branching happens at and visit greater ones only; chains without branches are one step. Once a
    component has more than `most` cycles, walks that can't close below the longest of the first ones end: no cycle of the
    answer is missed, and no other is kept. A component of few cycles has few branches, so its walks are few too.
    """
    steps = _contracted(nodes, inside)
    if only is None:
        steps = steps.withColumn("hit", F.lit(True))
    else:
        marked = F.collect_set(F.struct("src", "dst", "via"))
        passing = steps.select("component", "src", "dst", "via", F.explode(F.concat(F.array("src"), "via")).alias("node")).join(only.select("node").distinct(), "node", "left_semi")
        hits = passing.groupBy("component").agg(marked.alias("x")).select("component", F.explode("x").alias("x")).select("component", "x.*").withColumn("hit", F.lit(True))
        steps = store(steps.join(hits, ["component", "src", "dst", "via"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "steps")
    first = Window.partitionBy("component").orderBy(F.size("cycle"), "cycle")
    kept = lambda df: df.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most + 1)
    walk = steps.where("dst >= src").select("component", F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("seen"), F.concat(F.array("src"), "via").alias("path"), "hit")
    walk, found = store(walk, "walk"), None
    while True:
        closed = walk.where("at = start and hit").select("component", from_least(F.col("path")).alias("cycle"))
        was, found = found, store(kept(closed if found is None else found.select("component", "cycle").unionByName(closed)), "cycles")
        if was is not None:
            forget(was)
        full = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("cycle")).alias("longest")).where(F.col("n") > most).select("component", "longest")
        open_ = walk.where("at <> start").join(bounded(store(full, "full"), 64), "component", "left").where("longest is null or size(path) < longest")
        wider = open_.drop("longest").join(steps.select("component", F.col("src").alias("at"), F.col("dst").alias("to"), "via", F.col("hit").alias("also")), ["component", "at"])
        wider = wider.where("to = start or (to > start and to <> at and not array_contains(seen, to))")
        last, walk = walk, store(wider.select("component", "start", F.col("to").alias("at"), F.concat("seen", F.array("at")).alias("seen"), F.concat("path", F.array("at"), "via").alias("path"), (F.col("hit") | F.col("also")).alias("hit")), "walk")
        forget(last)
        if walk.isEmpty():
            break
    total = found.groupBy("component").agg((F.count(F.lit(1)) > most).alias("more"))
    return found.where(F.col("place") <= most).join(total, "component").select("component", "place", "cycle", "more")
