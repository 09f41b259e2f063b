"""Traversal of lineage graphs: edge tables (src, dst), set-at-a-time.

Null ends are no edges; repeated edges count once unless a function counts them; self edges and cycles are
allowed everywhere unless said otherwise.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from threadloom.functions.names import canonical_name, normalize_table_name
from threadloom.functions.tables import bounded, forget, store
from threadloom.operators import blocks

MAX_DEPTH, MAX_NODES = 7, 300
#: Orders of the nodes that a round of strong_components looks at.
ORDERS = 4
#: strong_components cuts loose ends off again while that takes out one edge in so many.
TRIM = 8


class Traversal:
    """nodes (node, depth, rank), edges (src, dst) among them; whether an unvisited neighbour was left is asked of Spark when it is wanted."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, truncated: Callable[[], bool], root_found: Callable[[], bool]):
        self.nodes, self.edges, self._truncated, self._root_found = nodes, edges, truncated, root_found

    @functools.cached_property
    def truncated(self) -> bool:
        return self._truncated()

    @functools.cached_property
    def root_found(self) -> bool:
        return self._root_found()


def pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def turned(edges: DataFrame, direction: str) -> DataFrame:
    if direction not in ("down", "up"):
        raise ValueError("direction is 'down' or 'up'")
    return edges if direction == "down" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _constant(value, kind: str) -> str:
    """A node as a SQL literal."""
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'" if isinstance(value, str) else f"cast('{text}' as {kind})"


def _list(values, kind: str) -> str:
    return ", ".join(_constant(v, kind) for v in values)


def _nodes(spark: SparkSession, kind: str, visited: dict) -> DataFrame:
    """The visited nodes as constants of the plan: no job, no Python rows."""
    rows = ", ".join(f"named_struct('node', {_constant(n, kind)}, 'depth', {d}, 'rank', {r})" for n, (d, r) in visited.items())
    return spark.range(1).select(F.expr(f"inline(array({rows}))"))


def _search(edges: DataFrame, root, directions: tuple[str, ...], max_depth: int, max_nodes: int) -> list[Traversal]:
    """A bounded search in each direction; a level of all of them is one job."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    known = edges.select("src", "dst").where("src is not null and dst is not null")
    flows = [turned(known, d) for d in directions]
    visited: list[dict] = [{root: (0, 0)} for _ in directions]
    frontiers, depth = [[root] for _ in directions], 0
    while depth < max_depth and any(f and len(v) < max_nodes for f, v in zip(frontiers, visited, strict=True)):
        depth += 1
        rounds = []
        for way, (flow, last, seen) in enumerate(zip(flows, frontiers, visited, strict=True)):
            if last and len(seen) < max_nodes:
                names = _list(last, kind)
                parent = F.expr(f"min(array_position(array({names}), src))").alias("parent")  # in order of rank
                reached = flow.where(F.expr(f"src in ({names}) and dst not in ({_list(seen, kind)})")).groupBy("dst").agg(parent)
                rounds.append(reached.orderBy("parent", "dst").limit(max_nodes - len(seen)).select(F.lit(way).alias("way"), "parent", "dst"))
        found = sorted(functools.reduce(DataFrame.unionAll, rounds).collect())
        frontiers = [[r["dst"] for r in found if r["way"] == way] for way in range(len(directions))]
        for seen, last in zip(visited, frontiers, strict=True):
            seen |= {n: (depth, len(seen) + k) for k, n in enumerate(last)}
    touching = edges.where((F.col("src") == F.lit(root)) | (F.col("dst") == F.lit(root)))
    out = []
    for flow, seen in zip(flows, visited, strict=True):
        names = _list(seen, kind)
        left, inside = flow.where(F.expr(f"src in ({names}) and dst not in ({names})")), pairs(edges.where(F.expr(f"src in ({names}) and dst in ({names})")))
        out.append(Traversal(_nodes(spark, kind, seen), inside, lambda left=left: not left.isEmpty(), lambda: not touching.isEmpty()))
    return out


def bounded_bfs(edges: DataFrame, root, direction: str = "down", max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Traversal:
    """Breadth-first, at most max_nodes nodes with the root, admitted in first-in first-out order.

    Within a level the order is (rank of the first parent, name). What the driver holds is the admitted
    nodes, at most max_nodes of them; a level is one filtered scan of the edges. Stored edges sorted by src are skipped by
    their statistics, as the filter is on plain columns. Nodes are texts or numbers.
    """
    return _search(edges, root, (direction,), max_depth, max_nodes)[0]


def bfs_both(edges: DataFrame, root, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Traversal:
    """Up and down, the lesser depth of a node, the first max_nodes by (depth, name), edges among those."""
    a, b = _search(edges, root, ("up", "down"), max_depth, max_nodes)
    merged = a.nodes.unionByName(b.nodes).groupBy("node").agg(F.min("depth").alias("depth"))
    kept = merged.orderBy("depth", "node").limit(max_nodes)
    kept = kept.withColumn("rank", F.row_number().over(Window.orderBy("depth", "node")) - 1)
    names = F.broadcast(kept.select("node"))  # at most max_nodes rows
    inside = a.edges.unionByName(b.edges).distinct()
    inside = inside.join(names, inside["src"] == names["node"], "left_semi").join(names, F.col("dst") == names["node"], "left_semi")
    return Traversal(kept, inside, lambda: a.truncated or b.truncated or merged.count() > max_nodes, lambda: a.root_found or b.root_found)


def neighbours(edges: DataFrame, nodes: list, direction: str = "down") -> DataFrame:
    """(src, dst): the distinct edges that leave the given nodes, or with 'up' those that enter them."""
    return pairs(edges).where(F.col("src" if direction == "down" else "dst").isin(nodes))


def blast_radius(edges: DataFrame, root, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row: direct (depth 1), indirect (2 and more), total, max_depth."""
    nodes = bounded_bfs(edges, root, "down", max_depth, max_nodes).nodes
    return nodes.agg(
        F.count_if(F.col("depth") == 1).alias("direct"),
        F.count_if(F.col("depth") >= 2).alias("indirect"),
        F.count_if(F.col("depth") >= 1).alias("total"),
        F.max("depth").cast("long").alias("max_depth"),
    )


def levels(edges: DataFrame, starts: DataFrame, direction: str = "down", max_depth: int | None = None, most: int | None = None) -> DataFrame:
    """(start, node, level) for every node reached from each start (a column `start`), itself at 0.

    A level joins only the rows found last with the edges; levels are written to the shared folder, and every eight become one table, so that
    a level looks at few tables however deep it is. With `most`, a start that reaches more nodes is an error at the level where it does.
    """
    flow = turned(pairs(edges), direction).toDF("from", "to")
    flow = store(flow, "edges")
    last = starts.select("start", F.col("start").alias("node")).distinct().withColumn("level", F.lit(0))
    found = last = store(last, "level")
    level = 0
    while max_depth is None or level < max_depth:
        level += 1
        reached = last.join(flow, last["node"] == flow["from"]).select("start", F.col("to").alias("node")).distinct()
        new = store(reached.join(found, ["start", "node"], "left_anti").withColumn("level", F.lit(level)), "level")
        if new.isEmpty():
            break
        found, last = found.unionByName(new), new
        if level % 8 == 0:
            found = store(found, "levels")
        if most is not None and not found.groupBy("start").count().where(F.col("count") > most).isEmpty():
            raise ValueError(f"a closure is larger than {most}")
    return found


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(src, dst) for each path of one edge or more. Path lengths double each round.

    The result is as large as the sum over nodes of what they reach: for graphs of small components.
    """
    paths = store(pairs(edges), "paths")
    size = paths.count()
    for _ in range(max_rounds):
        longer = paths.join(paths.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        paths = store(paths.unionByName(longer).distinct(), "paths")
        now = paths.count()
        if now == size:
            return paths
        size = now
    raise ValueError("paths longer than 2 to the power max_rounds")


def _least_reaching(flow: DataFrame, labels: DataFrame) -> DataFrame:
    """(way, node, label): the least label among the node and all that reach it by (u, v) edges of one way.

    Each round takes labels over edges and then jumps: what reaches a node's label reaches the node. Labels are
    (order, node), so a label names its node; rounds grow with the logarithm of the paths, mostly.
    """
    now = labels.select("way", "node", "label")
    while True:
        came = flow.join(now.select("way", F.col("node").alias("u"), F.col("label").alias("from")), ["way", "u"]).groupBy("way", F.col("v").alias("node")).agg(F.min("from").alias("from"))
        hop = now.join(came, ["way", "node"], "left").select("way", "node", F.least("label", F.coalesce("from", "label")).alias("label"), F.col("label").alias("was"))
        hop = store(hop, "labels")
        forget(now)
        far = hop.select(F.col("way").alias("far_way"), F.col("node").alias("at"), F.col("label").alias("far"))
        jumped = hop.join(far, (F.col("way") == F.col("far_way")) & (F.col("label.node") == F.col("at"))).select("way", "node", F.least("label", "far").alias("label"), "was")
        now = store(jumped.withColumn("moved", F.col("label") != F.col("was")).drop("was"), "labels")
        forget(hop)
        if now.where("moved").isEmpty():
            return now


def strong_components(edges: DataFrame, near: str | None = None) -> DataFrame:
    """(node, component, size) of the components of more than one node; the least member names one.

    `near` names a column of edges that connected edges mostly share, such as an owner. It is only a hint: groups of edges by it that
    share no node with others are solved in blocks by tasks, and all others here.
    """
    if near is None:
        return _strong_components(edges)
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.xxhash64(near).alias("group"), "src", "dst")
    closed, open_ = blocks.apart(store(e, "edges"))
    kind = edges.schema["src"].dataType.simpleString()
    found = store(blocks.solved(closed, blocks.components, f"group long, node {kind}, component {kind}, size long").drop("group"), "components")
    return found if open_ is None else found.unionByName(_strong_components(open_))


def strong_components_by(edges: DataFrame, by: str) -> DataFrame:
    """(by, node, component, size) of one graph for each value of a column; names of several graphs are different nodes."""
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.col(by).alias("group"), "src", "dst")
    few, large = blocks.small(store(e, "edges"))
    group, kind = (edges.schema[c].dataType.simpleString() for c in (by, "src"))
    found = store(blocks.solved(few, blocks.components, f"group {group}, node {kind}, component {kind}, size long"), "components")
    if large is not None:
        key = lambda c: F.struct("group", F.col(c).alias("n")).alias(c)
        rest = _strong_components(large.select(key("src"), key("dst")))
        found = found.unionByName(rest.select(F.col("node.group").alias("group"), F.col("node.n").alias("node"), F.col("component.n").alias("component"), "size"))
    return found.withColumnRenamed("group", by)


def _strong_components(edges: DataFrame) -> DataFrame:
    """Strong components set at a time.

    All nodes of a component have the same least ancestor and the same least descendant in any order of the nodes. Each
    round orders the nodes anew by a few hashes, cuts the edges between nodes that differ in any of these, and takes out the nodes
    for which the two are one node: those are whole components. No closure is built; rows never exceed nodes and edges. The first round
    looks at one order only, as that is enough where components don't lead to each other.
    """
    e = store(pairs(edges).where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")), "edges")
    done, salt, orders = None, 0, 1
    while not (e := _trimmed(e)).isEmpty():
        nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        ways = F.explode(F.array(*map(F.lit, range(2 * orders)))).alias("way")
        order = F.xxhash64("node", F.lit(salt) + F.floor(F.col("way") / 2))
        labels = nodes.select(ways, "node").withColumn("label", F.struct(order.alias("order"), F.col("node").alias("node")))
        forth, back = (F.explode(F.array(*map(F.lit, range(k, 2 * orders, 2)))).alias("way") for k in (0, 1))
        flow = e.select(forth, "u", "v").unionByName(e.select(back, F.col("v").alias("u"), F.col("u").alias("v")))
        found = _least_reaching(flow, labels)
        wide = found.groupBy("node").agg(*[F.max(F.when(F.col("way") == k, F.col("label.node"))).alias(f"w{k}") for k in range(2 * orders)])
        met = F.coalesce(*[F.when(F.col(f"w{k}") == F.col(f"w{k + 1}"), F.col(f"w{k}")) for k in range(0, 2 * orders, 2)])
        both = store(wide.select("node", met.alias("root"), F.struct(*[f"w{k}" for k in range(2 * orders)]).alias("class")), "classes")
        forget(found)
        whole = both.where("root is not null").select("node", "root")
        done = whole if done is None else done.unionByName(whole)
        open_ = both.where("root is null").select("node", "class")
        left = store(e.join(open_.toDF("u", "a"), "u").join(open_.toDF("v", "b"), "v").where("a = b").select("u", "v"), "edges")
        forget(e)
        e, salt, orders = left, salt + orders, ORDERS
    if done is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).where("false")
    named = done.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return done.join(named, "root").select("node", "component", "size")


def _trimmed(e: DataFrame) -> DataFrame:
    """(u, v) without edges that no way leads into or out of; again while that takes out one in TRIM."""
    n = e.count()
    while n:
        inner = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        less = store(inner.select("u", "v"), "edges")
        forget(e)
        e, was, n = less, n, less.count()
        if (was - n) * TRIM < was:
            break
    return e


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level), level = edges on the longest path to the node; nodes on or behind a cycle get no row."""
    edges = store(pairs(edges), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    waiting = store(nodes.join(edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("open")), "node", "left").na.fill(0, ["open"]), "waiting")
    done, level = None, 0
    while True:
        ready = store(waiting.where("open = 0").select("node", F.lit(level).alias("level")), "ready")
        if ready.isEmpty():
            return done if done is not None else ready
        done = ready if done is None else done.unionByName(ready)
        freed = edges.join(ready, edges["src"] == ready["node"]).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("freed"))
        waiting = store(waiting.where("open > 0").join(freed, "node", "left").select("node", (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open")), "waiting")
        level += 1


def _collapsible(edges: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with a flag whether dst is collapsible, those of them that start at a node that isn't)."""
    flag = kinds.where("collapsible").select(F.col("node").alias("dst")).distinct().withColumn("inner", F.lit(True))
    e = store(pairs(edges).join(flag, "dst", "left").select("src", "dst", F.coalesce("inner", F.lit(False)).alias("inner")), "edges")
    return e, e.join(flag.select(F.col("dst").alias("src")), "src", "left_anti")


def _has_inner_cycle(e: DataFrame, starts: DataFrame) -> bool:
    inside = e.where("inner").select("src", "dst").join(starts.select("src"), "src", "left_anti")
    return not inside.where("src = dst").isEmpty() or not strong_components(inside).isEmpty()


def collapse(edges: DataFrame, kinds: DataFrame, most_states: int = 1_000_000) -> DataFrame:
    """(src, dst, paths, depth): business edges through collapsible nodes, with exact path counts.

    kinds is (node, collapsible). Walks start and end at nodes that aren't collapsible; the edges of a path count;
    depth is the shortest path's. Without a cycle of collapsible nodes counts are summed a level at a time, so the number of paths
    doesn't matter. With one, paths that visit no node twice are walked and counted; beyond most_states open walks
    the pairs and depths stay exact and paths is null.
    """
    e, starts = _collapsible(edges, kinds)
    first = starts.select("src", F.col("dst").alias("at"), "inner")
    if (counted := _summed(e, first, starts)) is not None:
        return counted
    walk = store(first.withColumn("path", F.array("src", "at")), "walk")
    ends = walk.where("not inner").select("src", F.col("at").alias("dst"), F.lit(1).alias("depth"))
    depth = 1
    while True:
        open_ = walk.where("inner")
        n = open_.count()
        if not n:
            return ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("paths"), F.min("depth").cast("long").alias("depth"))
        if n > most_states:
            return _reached(e, first)
        depth += 1
        step = open_.select(F.col("src").alias("start"), "at", "path").join(e, F.col("at") == e["src"]).where(~F.array_contains("path", F.col("dst")) | ((F.col("dst") == F.col("start")) & ~F.col("inner")))
        walk = store(step.select(F.col("start").alias("src"), F.col("dst").alias("at"), "inner", F.concat("path", F.array("dst")).alias("path")), "walk")
        ends = ends.unionByName(walk.where("not inner").select("src", F.col("at").alias("dst"), F.lit(depth).alias("depth")))


def _summed(e: DataFrame, first: DataFrame, starts: DataFrame, look_at: int = 32) -> DataFrame | None:
    """Counts a level at a time; None if walks of look_at edges are still open because of a cycle."""
    walk = store(first.withColumn("paths", F.lit(1).cast("long")), "walk")
    ends, depth = walk.where("not inner").select("src", F.col("at").alias("dst"), "paths", F.lit(1).alias("depth")), 1
    while True:
        open_ = walk.where("inner")
        if open_.isEmpty():
            return ends.groupBy("src", "dst").agg(F.sum("paths").alias("paths"), F.min("depth").cast("long").alias("depth"))
        depth += 1
        if depth == look_at and _has_inner_cycle(e, starts):
            return None
        step = open_.select(F.col("src").alias("start"), "at", "paths").join(e, F.col("at") == e["src"])
        walk = store(step.groupBy(F.col("start").alias("src"), F.col("dst").alias("at"), "inner").agg(F.sum("paths").alias("paths")), "walk")
        ends = ends.unionByName(walk.where("not inner").select("src", F.col("at").alias("dst"), "paths", F.lit(depth).alias("depth")))


def _reached(e: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs and depths only: each node once a start."""
    found = last = store(first.distinct().withColumn("depth", F.lit(1)), "walk")
    depth = 1
    while True:
        depth += 1
        step = last.where("inner").select(F.col("src").alias("start"), "at").join(e, F.col("at") == e["src"]).select(F.col("start").alias("src"), F.col("dst").alias("at"), "inner").distinct()
        last = store(step.join(found.select("src", "at"), ["src", "at"], "left_anti").withColumn("depth", F.lit(depth)), "walk")
        if last.isEmpty():
            return found.where("not inner").select("src", F.col("at").alias("dst"), F.lit(None).cast("long").alias("paths"), F.col("depth").cast("long").alias("depth"))
        found = found.unionByName(last)


def path_samples(edges: DataFrame, kinds: DataFrame, most: int = 100) -> DataFrame:
    """(src, dst, place, path): of the paths that collapse() counts the first `most` a pair, by length and then by names.

    Only the first walks of a start to a node are carried on. Without a cycle of collapsible nodes `most` of them are enough: others
    continue alike and can't be among the first. With one, a kept walk may meet its own nodes where a dropped one wouldn't; a
    start is settled once it dropped nothing, or each of its pairs has `most` paths no longer than the shortest walk that it dropped. The
    others are walked again with four times the width, so no answer falls short and none is wrong; such graphs may have very many paths.
    """
    e, starts = _collapsible(edges, kinds)
    place = F.row_number().over(Window.partitionBy("src", "at").orderBy(F.size("path"), "path"))
    first = lambda ends: ends.withColumn("place", place).where(F.col("place") <= most)
    out = lambda df: df.select("src", F.col("at").alias("dst"), "place", "path")
    if not _has_inner_cycle(e, starts):
        return out(first(_walks(e, starts, most)[0]))
    pairs_ = store(_reached(e, starts.select("src", F.col("dst").alias("at"), "inner")).select("src", F.col("dst").alias("at")), "pairs")
    done, todo, width = None, starts, most
    while True:
        ends, cut = _walks(e, todo, width)
        found = store(first(ends), "paths")
        full = found.where(F.col("place") == most).select("src", "at", F.size("path").alias("last"))
        open_ = pairs_.join(cut, "src").join(full, ["src", "at"], "left").where("last is null or last > cut").select("src").distinct()
        open_ = store(open_, "unsettled")
        settled = found.join(open_, "src", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if open_.isEmpty():
            return out(done)
        todo, width = starts.join(open_, "src", "left_semi").select(*starts.columns), 4 * width


def _walks(e: DataFrame, starts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(whole paths (src, at, path), of each start that dropped walks the nodes of its shortest one), `most` open walks a start and node."""
    rank = F.row_number().over(Window.partitionBy("src", "at").orderBy("path"))
    walk = store(starts.select("src", F.col("dst").alias("at"), "inner", F.array("src", "dst").alias("path")), "walk")
    ends, cuts = walk.where("not inner"), None
    while True:
        open_ = walk.where("inner")
        if open_.isEmpty():
            break
        step = open_.select(F.col("src").alias("start"), "at", "path").join(e, F.col("at") == e["src"]).where(~F.array_contains("path", F.col("dst")) | ((F.col("dst") == F.col("start")) & ~F.col("inner")))
        wider = step.select(F.col("start").alias("src"), F.col("dst").alias("at"), "inner", F.concat("path", F.array("dst")).alias("path"))
        ranked = store(wider.withColumn("k", rank).where(F.col("k") <= most + 1), "walk")
        walk = ranked.where(F.col("k") <= most).drop("k")
        ends = ends.unionByName(walk.where("not inner"))
        dropped = ranked.where((F.col("k") > most) & F.col("inner")).select("src", F.size("path").alias("n"))
        cuts = dropped if cuts is None else cuts.unionByName(dropped)
    none = ends.select("src", F.lit(0).alias("n")).limit(0)
    return ends.select("src", "at", "path"), store((none if cuts is None else cuts).groupBy("src").agg(F.min("n").alias("cut")), "cuts")


def reaching(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, src, dst): the edges from which each target (a column `target`) can be reached."""
    up = levels(edges, targets.select(F.col("target").alias("start")), "up")
    e = pairs(edges)
    return e.join(up.select(F.col("start").alias("target"), F.col("node").alias("dst")), "dst").select("target", "src", "dst")


def program_boundary(edges: DataFrame, results: DataFrame) -> DataFrame:
    """(program, target, src): external sources of each program's result.

    edges is (program, src, dst), results (program, target). A source is external if no edge of the program that reaches
    the target writes it, and it isn't the target; a direct self edge of the target is kept.
    """
    keyed = edges.where("src is not null and dst is not null").select(F.struct("program", F.col("src").alias("n")).alias("src"), F.struct("program", F.col("dst").alias("n")).alias("dst"))
    ends = results.select(F.struct("program", F.col("target").alias("n")).alias("target"))
    inside = store(reaching(keyed, ends).select(F.col("target.program").alias("program"), F.col("target.n").alias("target"), F.col("src.n").alias("src"), F.col("dst.n").alias("dst")), "inside")
    written = inside.select("program", "target", F.col("dst").alias("src")).distinct()
    outer = inside.join(written, ["program", "target", "src"], "left_anti").where("src <> target")
    own = inside.where("src = target and dst = target")
    return outer.unionByName(own).select("program", "target", "src").distinct()


def roles(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, role)."""
    e = pairs(edges)
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    both = out.join(into, "node", "full").na.fill(0, ["out_degree", "in_degree"])
    role = F.when(F.col("in_degree") == 0, "SOURCE_ONLY").when(F.col("out_degree") == 0, "SINK_ONLY").otherwise("INTERMEDIATE")
    return both.select("node", "in_degree", "out_degree", role.alias("role"))


def sinks(edges: DataFrame, by: str = "program") -> DataFrame:
    """What a program writes and never reads; a self edge doesn't count as reading."""
    return edges.select(by, F.col("dst").alias("sink")).distinct().join(edges.where("src <> dst").select(by, F.col("src").alias("sink")), [by, "sink"], "left_anti")


def subgraph(edges: DataFrame, keep: DataFrame, suffix: str) -> DataFrame:
    """Edges inside the kept nodes (a column `node`), both ends renamed with the suffix."""
    inside = pairs(edges).join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi")
    return inside.select(F.concat("src", F.lit(suffix)).alias("src"), F.concat("dst", F.lit(suffix)).alias("dst"))


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between labels (node, label) where unlabelled nodes are passed through."""
    e = pairs(edges)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    kinds = nodes.join(labels.select("node"), "node", "left_anti").withColumn("collapsible", F.lit(True))
    short = collapse(e, kinds)
    a, b = labels.toDF("src", "src_label"), labels.toDF("dst", "dst_label")
    return short.join(a, "src").join(b, "dst").select(F.col("src_label").alias("src"), F.col("dst_label").alias("dst")).distinct()


def _weak_groups(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = both.select(F.col("src").alias("node")).distinct()
    label = store(nodes.withColumn("group", F.col("node")), "group")
    while True:
        near = both.join(label.select(F.col("node").alias("dst"), "group"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("group").alias("g"))
        hop = label.join(near, "node").select("node", F.least("group", "g").alias("group"))
        # jump: the group of the group's namesake
        jumped = hop.join(hop.select(F.col("node").alias("group"), F.col("group").alias("g2")), "group").select("node", F.least("group", "g2").alias("group"))
        now = store(jumped, "group")
        if now.join(label, ["node", "group"], "left_anti").isEmpty():
            return label
        label = now


def pack_closures(edges: DataFrame, most: int = 500) -> DataFrame:
    """(chunk, node): chunks of at most `most` rows, each with all that its nodes depend on (src depends on dst).

    Nodes of one weak group stay together where it fits; of a larger group each node that nothing depends on brings its
    closure, so that rows repeat in several chunks. Raises for a single closure larger than `most`.
    """
    e = store(pairs(edges), "edges")
    label = _weak_groups(e)
    large = label.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    whole = label.join(large, "group", "left_anti").select("group", "node")
    inside = store(label.join(large, "group", "left_semi").select("node"), "large")
    if not inside.isEmpty():
        e2 = store(e.join(inside.select(F.col("node").alias("src")), "src", "left_semi"), "edges")
        tops = inside.join(e2.where("src <> dst").select(F.col("dst").alias("node")), "node", "left_anti")
        below = levels(e2, tops.select(F.col("node").alias("start")), most=most).select(F.col("start").alias("group"), "node")
        # nodes behind no top are in or behind a cycle: each component's least member stands for it
        rest = inside.join(below.select("node"), "node", "left_anti")
        parts = strong_components(e2)
        heads = rest.join(parts.select("node", "component"), "node", "left").select(F.coalesce("component", "node").alias("start")).distinct()
        closed = store(below.unionByName(levels(e2, heads, most=most).select(F.col("start").alias("group"), "node")), "closures")
        whole = whole.unionByName(closed)
    sizes = store(whole.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "sizes")
    if not sizes.where(F.col("n") > most).isEmpty():
        raise ValueError(f"a closure is larger than {most}")
    # groups above half a chunk have one of their own; smaller ones of a bucket are packed by a running total, a task a bucket
    half, buckets = most // 2, max(64, sizes.count() // 1_000_000)
    w = Window.partitionBy("bucket").orderBy("group")
    small = sizes.where(F.col("n") <= half).withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets))).withColumn("end", F.sum("n").over(w))
    small = small.select("group", F.concat_ws("-", F.col("bucket").cast("string"), F.floor((F.col("end") - 1) / max(1, half)).cast("string")).alias("chunk"))
    alone = sizes.where(F.col("n") > half).select("group", F.concat(F.lit("g-"), F.col("group").cast("string")).alias("chunk"))
    return whole.join(small.unionByName(alone), "group").select("chunk", "node").distinct()


def dependents_of(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, start, level) and the starts that no edge has. starts is (start, place).

    A node that several starts reach belongs to the first of them by place; starts are at level 0 of their own.
    """
    e = pairs(edges)
    known = e.select(F.col("src").alias("start")).union(e.select("dst")).distinct()
    found = levels(e, starts.join(known, "start", "left_semi")).join(bounded(starts), "start")
    own = F.when(F.col("level") == 0, -1).otherwise(F.col("place"))
    first = found.groupBy("node").agg(F.min(F.struct(own.alias("own"), F.col("place"), F.col("start"), F.col("level"))).alias("f"))
    return first.select("node", "f.start", "f.level"), starts.join(known, "start", "left_anti").select("start")


def included(edges: DataFrame, choices: DataFrame) -> DataFrame:
    """(program, node): the nodes of each program's graph that its materialization takes in.

    edges is (program, src, dst), choices (program, target, choice) of audit.select_target: with a chosen target those that reach
    it and itself, if something writes it; without one all nodes of the program.
    """
    e = store(edges.where("src is not null and dst is not null").select("program", "src", "dst").distinct(), "edges")
    nodes = e.select("program", F.explode(F.array("src", "dst")).alias("node")).distinct()
    chosen = choices.where("target is not null").select("program", "target")
    written = chosen.join(e.select("program", F.col("dst").alias("target")), ["program", "target"], "left_semi")
    keyed = e.select(F.struct("program", F.col("src").alias("n")).alias("src"), F.struct("program", F.col("dst").alias("n")).alias("dst"))
    up = levels(keyed, written.select(F.struct("program", F.col("target").alias("n")).alias("start")), "up")
    reach = up.select(F.col("node.program").alias("program"), F.col("node.n").alias("node")).distinct()
    return nodes.join(chosen.select("program"), "program", "left_anti").unionByName(reach)


def program_edges(edges: DataFrame, kinds: DataFrame, choices: DataFrame) -> DataFrame:
    """(program, src, dst, paths, depth): each program's business edges inside its included nodes.

    edges is (program, src, dst), kinds (program, node, collapsible), choices as for included().
    """
    taken = store(included(edges, choices), "included")
    inside = edges.join(taken.select("program", F.col("node").alias("src")), ["program", "src"], "left_semi").join(taken.select("program", F.col("node").alias("dst")), ["program", "dst"], "left_semi")
    key = lambda c: F.struct("program", F.col(c).alias("n"))
    out = collapse(inside.select(key("src").alias("src"), key("dst").alias("dst")), kinds.select(key("node").alias("node"), "collapsible"))
    return out.select(F.col("src.program").alias("program"), F.col("src.n").alias("src"), F.col("dst.n").alias("dst"), "paths", "depth")


def bind_target(target: Column, authority: Column) -> Column:
    """A write target without a name space is the authority if that is qualified and has the same base name."""
    t, a = normalize_table_name(target), canonical_name(authority)
    return F.when(~F.contains(t, F.lit(".")) & a.isNotNull() & (F.substring_index(a, ".", -1) == t), a).otherwise(target)


def boundary_diagnostics(programs: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, diagnostic) of targets whose programs can't be projected as one group.

    programs is (program, name, step, target), edges (program, name, src, dst), all names canonical.
    AMBIGUOUS_PROGRAM: a program twice, or under two targets; DUPLICATE_STEP: no or equal steps; EDGE_PROVENANCE_MISMATCH: an edge under
    another name than its program's; RESULT_NOT_OBSERVED: nothing writes the target; RESULT_USED_AS_SOURCE: it feeds another table.
    """
    say = lambda df, what: df.select("target", F.lit(f"PROGRAM_BOUNDARY_{what}").alias("diagnostic"))
    twice = programs.groupBy("program").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("program")
    steps = programs.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("step").alias("d"))
    mine = programs.select("program", "target", F.col("name").alias("own"))
    facts = edges.join(mine, "program")
    seen = facts.groupBy("target").agg(F.count_if(F.col("dst") == F.col("target")).alias("writes"), F.count_if((F.col("src") == F.col("target")) & (F.col("dst") != F.col("target"))).alias("feeds"))
    judged = programs.select("target").distinct().join(seen, "target", "left").na.fill(0, ["writes", "feeds"])
    return (
        say(programs.join(twice, "program", "left_semi"), "AMBIGUOUS_PROGRAM")
        .unionByName(say(steps.where("d < n"), "DUPLICATE_STEP"))
        .unionByName(say(facts.where(~F.col("name").eqNullSafe(F.col("own"))), "EDGE_PROVENANCE_MISMATCH"))
        .unionByName(say(judged.where("writes = 0"), "RESULT_NOT_OBSERVED"))
        .unionByName(say(judged.where("feeds > 0"), "RESULT_USED_AS_SOURCE"))
        .distinct()
    )


def boundary_projections(programs: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, src, program, fallback): sources of each target over all its programs together.

    Targets without a diagnostic are projected: external sources of the edges that reach the target, self edges of the target, and direct
    facts of programs outside the group. Targets with one fall back to their direct edges.
    """
    bad = store(boundary_diagnostics(programs, edges).select("target").distinct(), "diagnosed")
    good = store(programs.join(bad, "target", "left_anti").select("program", F.col("target").alias("result")), "groups")
    facts = store(edges.where("src is not null and dst is not null").join(good, "program").select(F.col("result").alias("group"), "program", "src", "dst").distinct(), "facts")
    key = lambda c: F.struct("group", F.col(c).alias("n"))
    ends = good.select(F.struct(F.col("result").alias("group"), F.col("result").alias("n")).alias("target")).distinct()
    reach = reaching(facts.select(key("src").alias("src"), key("dst").alias("dst")), ends).select(F.col("target.n").alias("group"), F.col("src.n").alias("src"), F.col("dst.n").alias("dst"))
    inside = store(facts.join(reach, ["group", "src", "dst"], "left_semi"), "inside")
    outer = inside.join(inside.select("group", F.col("dst").alias("src")).distinct(), ["group", "src"], "left_anti").where(F.col("src") != F.col("group"))
    own = inside.where((F.col("src") == F.col("group")) & (F.col("dst") == F.col("group")))
    direct = edges.where("src is not null and dst is not null").select(F.col("dst").alias("target"), "src", "program")
    foreign = direct.join(good.select(F.col("result").alias("target")).distinct(), "target", "left_semi").join(good.select("program", F.col("result").alias("target")), ["program", "target"], "left_anti").select("target", "src", "program")
    name = lambda df: df.select(F.col("group").alias("target"), "src", "program")
    projected = name(outer.select("group", "src", "program")).unionByName(name(own.select("group", "src", "program"))).unionByName(foreign).withColumn("fallback", F.lit(False))
    return projected.unionByName(direct.join(bad, "target", "left_semi").withColumn("fallback", F.lit(True))).distinct()


def trace_upstream(edges: DataFrame, starts: DataFrame, stop: Column, max_depth: int = 30) -> DataFrame:
    """(start, node, level, terminal): upstream from each start; nodes where `stop` (a condition on `node`) holds are reached but not passed.

    terminal is STOP, NATURAL (nothing feeds it) or null.
    """
    e = store(pairs(edges), "edges")
    own = starts.select("start").distinct()
    direct = e.select(F.col("dst").alias("start"), F.col("src").alias("first")).join(own, "start", "left_semi")
    flow = e.select(F.col("dst").alias("node"), "src").where(~F.coalesce(stop, F.lit(False))).select(F.col("node").alias("src"), F.col("src").alias("dst"))
    beyond = levels(flow, direct.select(F.col("first").alias("start")).distinct(), "down", max_depth - 1)
    further = direct.join(beyond.select(F.col("start").alias("first"), "node", (F.col("level") + 1).alias("level")), "first").select("start", "node", "level")
    found = own.select("start", F.col("start").alias("node"), F.lit(0).alias("level")).unionByName(further).groupBy("start", "node").agg(F.min("level").alias("level"))
    fed = e.select(F.col("dst").alias("node")).distinct().withColumn("fed", F.lit(True))
    kind = F.when((F.col("level") > 0) & F.coalesce(stop, F.lit(False)), "STOP").when(F.col("fed").isNull(), "NATURAL")
    return found.join(fed, "node", "left").select("start", "node", "level", kind.alias("terminal"))
