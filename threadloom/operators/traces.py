"""Traces over jobs, tables and programs, by levels, with the way in which each branch ends.

An end is STOP (a terminal table), NATURAL (nothing leads on), CYCLE (a step back into what led here), MISSING (a job that isn't known), UNMAPPED
(a job without tables, which is passed through) or DEPTH (the bound of levels cut it).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from threadloom.functions import sqltext
from threadloom.functions.names import normalize_table_name
from threadloom.functions.tables import bounded, store
from threadloom.operators.graph import pairs, strong_components

#: Rounds of a walk after which its levels are written as one table.
COMPACT = 8


@dataclass
class Trace:
    """tables (root, table, depth), edges (root, source, target, depth), ends (root, end, name)."""

    tables: DataFrame
    edges: DataFrame
    ends: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _no(terminal: Callable[[Column], Column] | None, x: str) -> Column:
    """Whether a table isn't terminal."""
    return F.lit(True) if terminal is None else ~F.coalesce(terminal(F.col(x)), F.lit(False))


def _backward(taken: list[DataFrame]) -> DataFrame | None:
    """Of the steps (root, src, dst, again) taken so far, those that lead back into a cycle, as (b_root, b_src, b_dst); None if the last round has no
    step to something met before. Cycles are looked for among the steps of such roots only.
    """
    last = taken[-1].where("again")
    if last.isEmpty():
        return None
    roots = store(last.select("root").distinct(), "roots")
    mine = store(_union(taken).join(roots, "root", "left_semi").select("root", "src", "dst").distinct(), "taken")
    loops = strong_components(mine.select("src", "dst")).select("node", "component")
    both = last.select("root", "src", "dst").distinct().join(loops.toDF("src", "a"), "src", "left").join(loops.toDF("dst", "b"), "dst", "left")
    back = both.where((F.col("src") == F.col("dst")) | (F.col("a") == F.col("b"))).select(F.col("root").alias("b_root"), F.col("src").alias("b_src"), F.col("dst").alias("b_dst"))
    return store(back, "back")


def trace_jobs(jobs: DataFrame, needs: DataFrame, outputs: DataFrame, roots: DataFrame, terminal: Callable[[Column], Column] | None = None, direction: str = "up", max_depth: int = 30) -> Trace:
    """From the jobs of each root table over job dependencies, told as tables.

    jobs (job), needs (job, dependency), outputs (job, table), roots (root). Upstream, terminal tables end a branch. A job without
    tables passes on the table that led to it. max_depth counts jobs; depth counts tables, the least over all ways. A step to a job of
    the same strong component that was met no later than the job it leaves is a CYCLE end, not an edge.
    """
    known = jobs.select("job").where("job is not null").distinct()
    flow = needs.select("job", F.col("dependency").alias("next")) if direction == "up" else needs.select(F.col("dependency").alias("job"), F.col("job").alias("next"))
    flow = flow.where("job is not null and next is not null").distinct().join(known.withColumn("known", F.lit(True)).withColumnRenamed("job", "next"), "next", "left")
    flow = store(flow.select("job", "next", F.coalesce("known", F.lit(False)).alias("known")), "flow")
    made = store(outputs.where("table is not null").join(known, "job", "left_semi").select("job", "table").distinct(), "outputs")
    live = _no(terminal if direction == "up" else None, "table")

    begin = made.join(roots.select(F.col("root").alias("table")).distinct(), "table", "left_semi").select(F.col("table").alias("root"), "job", "table", F.lit(0).alias("depth"), F.lit(0).alias("step"))
    found = frontier = store(begin, "states")
    taken, edges, ends = [], [], [found.where(~live).select("root", F.lit("STOP").alias("end"), F.col("table").alias("name"))]
    for step in range(1, max_depth + 1):
        out = frontier.where(live).join(flow, "job")
        met = found.groupBy("root", F.col("job").alias("next")).agg(F.min("step").alias("met"))
        out = store(out.join(met, ["root", "next"], "left").withColumn("again", F.coalesce(F.col("met") <= F.col("step"), F.lit(False))), "steps")
        if out.isEmpty():
            break
        taken.append(out.select("root", F.col("job").alias("src"), F.col("next").alias("dst"), "again"))
        back = _backward(taken)
        out = store(out.join(back, [out["root"] == back["b_root"], out["job"] == back["b_src"], out["next"] == back["b_dst"], F.col("again")], "left").withColumn("back", F.col("b_root").isNotNull()).drop("b_root", "b_src", "b_dst"), "steps") if back is not None else out.withColumn("back", F.lit(False))
        ends.append(out.where("back").select("root", F.lit("CYCLE").alias("end"), F.col("next").alias("name")))
        ends.append(out.where("not known and not back").select("root", F.lit("MISSING").alias("end"), F.col("next").alias("name")))
        on = out.where("known and not back").select("root", F.col("next").alias("job"), F.col("table").alias("from"), "depth").join(made, "job", "left")
        on = store(on.select("root", "job", "from", F.coalesce("table", "from").alias("table"), (F.col("depth") + F.col("table").isNotNull().cast("int")).alias("depth"), F.col("table").isNull().alias("passed")), "reached")
        ends.append(on.where("passed").select("root", F.lit("UNMAPPED").alias("end"), F.col("job").alias("name")))
        two = ("table", "from") if direction == "up" else ("from", "table")
        edges.append(on.where("not passed and table <> from").select("root", F.col(two[0]).alias("source"), F.col(two[1]).alias("target"), "depth"))
        new = on.groupBy("root", "job", "table").agg(F.min("depth").alias("depth"))
        least = found.groupBy("root", "job", "table").agg(F.min("depth").alias("was"))
        new = new.join(least, ["root", "job", "table"], "left").where("was is null or depth < was").drop("was").withColumn("step", F.lit(step))
        frontier = store(new, "states")
        ends.append(frontier.where(~live).select("root", F.lit("STOP").alias("end"), F.col("table").alias("name")))
        found = found.unionByName(frontier)
        if step % COMPACT == 0:
            found = store(found, "states")
            taken, edges, ends = [store(_union(taken), "taken")], [store(_union(edges).distinct(), "edges")], [store(_union(ends).distinct(), "ends")]
    else:
        ends.append(frontier.where(live).join(flow, "job", "left_semi").select("root", F.lit("DEPTH").alias("end"), F.col("table").alias("name")))
    every = store(_union(edges) if edges else begin.select("root", F.col("table").alias("source"), F.col("table").alias("target"), "depth").limit(0), "edges")
    every = every.groupBy("root", "source", "target").agg(F.min("depth").alias("depth"))
    leads = every.select("root", F.col("target" if direction == "up" else "source").alias("table")).distinct()
    last = found.where(live).join(flow.select("job").distinct(), "job", "left_anti").select("root", "table").distinct().join(leads, ["root", "table"], "left_anti")
    ends.append(last.select("root", F.lit("NATURAL").alias("end"), F.col("table").alias("name")))
    return Trace(found.groupBy("root", "table").agg(F.min("depth").alias("depth")), every, _union(ends).distinct())


def _walk(flow: DataFrame, begin: DataFrame, terminal: Callable[[Column], Column], max_depth: int, roots_go_on: bool) -> Trace:
    """From (root, table, depth 0) over flow (table, next); whether tables of `begin` that are terminal are followed is said."""
    flow = store(flow.select("table", "next"), "flow")
    live = _no(terminal, "table") | (F.col("depth") == 0 if roots_go_on else F.lit(False))
    found = frontier = store(begin, "levels")
    steps, ends, depth = [], [], 0
    while depth < max_depth:
        depth += 1
        out = frontier.where(live & (F.col("depth") == depth - 1)).join(flow, "table")
        met = found.select("root", F.col("table").alias("next"), F.col("depth").alias("met"))
        out = store(out.join(met, ["root", "next"], "left"), "steps")
        if out.isEmpty():
            break
        steps.append(out.select("root", F.col("table").alias("src"), F.col("next").alias("dst"), F.lit(depth).alias("depth"), F.coalesce(F.col("met") <= F.col("depth"), F.lit(False)).alias("again")))
        frontier = store(out.where("met is null").select("root", F.col("next").alias("table")).distinct().withColumn("depth", F.lit(depth)), "levels")
        found = found.unionByName(frontier)
        if depth % COMPACT == 0:
            found, steps = store(found, "levels"), [store(_union(steps), "steps")]
    else:
        ends.append(frontier.where(live).join(flow, "table", "left_semi").select("root", F.lit("DEPTH").alias("end"), F.col("table").alias("name")))
    none = begin.select("root", F.col("table").alias("src"), F.col("table").alias("dst"), "depth", F.lit(False).alias("again")).limit(0)
    taken = _union(steps) if steps else none
    back = _backward([taken.select("root", "src", "dst", "again")])
    if back is not None:
        taken = taken.join(back, [taken["root"] == back["b_root"], taken["src"] == back["b_src"], taken["dst"] == back["b_dst"], F.col("again")], "left_anti")
        ends.append(back.select(F.col("b_root").alias("root"), F.lit("CYCLE").alias("end"), F.col("b_dst").alias("name")))
    every = taken.select("root", F.col("dst").alias("source"), F.col("src").alias("target"), "depth")
    ends.append(found.where(~live).select("root", F.lit("STOP").alias("end"), F.col("table").alias("name")))
    ends.append(found.where(live).join(flow, "table", "left_anti").select("root", F.lit("NATURAL").alias("end"), F.col("table").alias("name")))
    return Trace(found, every.distinct(), _union(ends).distinct())


def trace_schedule(edges: DataFrame, roots: DataFrame, terminal: Callable[[Column], Column], max_depth: int = 30) -> Trace:
    """J23 over a schedule map: edges (src, dst), src feeds dst; from each root (a column `root`) upstream to terminal tables."""
    flow = pairs(edges).select(F.col("dst").alias("table"), F.col("src").alias("next"))
    return _walk(flow, roots.select("root", F.col("root").alias("table"), F.lit(0).alias("depth")).distinct(), terminal, max_depth, True)


def crawl(programs: DataFrame, begin: DataFrame, terminal: Callable[[Column], Column], max_depth: int = 30) -> DataFrame:
    """(program, target, source, level): what the programs read that are reached from those of `begin` (a column `program`).

    A level takes the programs that write what the last level's programs read, and extracts the sources of their texts then: texts that no
    level reaches are never searched, and each text is searched once.
    """

    def extracted(rows: DataFrame, level: int) -> DataFrame:
        found = rows.select("program", "target", F.explode_outer(sqltext.source_tables(F.col("script"))).alias("source"))
        return store(found.withColumn("level", F.lit(level)), "facts")

    target = programs.select("program", normalize_table_name(F.col("target")).alias("target"), "script")
    facts = last = extracted(target.join(bounded(begin.select("program").distinct(), 64), "program", "left_semi"), 1)
    asked = None
    for level in range(2, max_depth + 1):
        wanted = last.where(F.col("source").isNotNull() & _no(terminal, "source")).select(F.col("source").alias("target")).distinct()
        wanted = store(wanted if asked is None else wanted.join(asked, "target", "left_anti"), "wanted")
        if wanted.isEmpty():
            break
        asked = wanted if asked is None else asked.unionByName(wanted)
        reached = target.join(bounded(wanted, 64), "target", "left_semi").join(facts.select("program").distinct(), "program", "left_anti")
        last = extracted(reached, level)
        # programs that were read before may write what is asked now; their facts are there already
        facts = facts.unionByName(last)
        if level % COMPACT == 0:
            facts, asked = store(facts, "facts"), store(asked, "wanted")
    return facts


def trace_programs(programs: DataFrame, roots: DataFrame, terminal: Callable[[Column], Column], max_depth: int = 30) -> Trace:
    """J23 by SQL text: from each program of `roots` (a column `program`) over what the texts read, upstream to terminal tables.

    programs (program, target, script). The root of a trace is the program, its first tables are those that its own text reads; further
    ones are read by any program that writes the table. A text that reads its own target adds nothing.
    """
    facts = store(crawl(programs, roots, terminal, max_depth).where("source is not null"), "facts")
    flow = facts.where("target is not null").select(F.col("target").alias("table"), F.col("source").alias("next")).distinct()
    own = facts.join(roots.select("program").distinct(), "program", "left_semi").where(~F.col("source").eqNullSafe(F.col("target")))
    begin = own.select(F.col("program").alias("root"), F.col("source").alias("table")).distinct().withColumn("depth", F.lit(0))
    t = _walk(flow, begin, terminal, max_depth - 1, False)
    # the first tables are one level below their program
    down = lambda df: df.withColumn("depth", F.col("depth") + 1)
    first = begin.select("root", F.col("table").alias("source"), F.col("root").alias("target"), F.lit(1).alias("depth"))
    return Trace(down(t.tables), first.unionByName(down(t.edges)), t.ends)


#: The order of nodes of one time in a level.
KINDS = ("root_table", "process", "table", "source_table")


def layered_graph(
    programs: DataFrame, reads: DataFrame, roots: DataFrame, known: DataFrame, times: DataFrame, terminal: Callable[[Column], Column], max_depth: int = 8, alerts: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, kind, node, level, place, seconds, alert) and edges (root, source, target) of each root table's upstream.

    programs (program, target), reads (program, source), roots (root), known (table), times (table, seconds). Tables and processes take turns:
    a table's producers are one level up, what those read one more. Reads of the own target go, and of tables that aren't known; a process
    all of whose reads go isn't shown, nor one whose target is neither known nor the root. A terminal table isn't followed. A node is
    at its least level. After max_depth further processes a table is a source_table, as is one without producer.

    Within a level nodes with a time come first, by time, then by kind and name. A process has its target's time, a source_table
    without one the earliest of the processes that it feeds. Of the terminal tables of a root the `alerts` latest are ranked.
    """
    prog = programs.where("program is not null and target is not null").select("program", "target").distinct()
    fit = known.select("table").distinct()
    wanted = reads.where("source is not null").select("program", "source").distinct()
    kept = prog.join(wanted, "program").where("source <> target").join(fit.withColumnRenamed("table", "source"), "source", "left_semi")
    kept = store(kept.select("program", "target", "source").distinct(), "reads")
    # processes that read nothing, or something that is kept
    silent = wanted.select("program").distinct().join(kept.select("program").distinct(), "program", "left_anti")
    shown = store(prog.join(silent, "program", "left_anti"), "programs")
    live = _no(terminal, "table")
    tables = store(roots.select("root", F.col("root").alias("table"), F.lit(0).alias("level")).distinct(), "levels")
    last, found_p, edges = tables, None, []
    for depth in range(max_depth + 1):
        reached = last.where(live | (F.col("level") == 0)).join(shown.withColumnRenamed("target", "table"), "table")
        reached = reached.join(fit.withColumn("fit", F.lit(True)), "table", "left").where("fit or table = root").select("root", "program", "table")
        if found_p is not None:
            again = reached.join(found_p.select("root", "program"), ["root", "program"], "left_semi")
            edges.append(again.select("root", F.col("program").alias("source"), F.col("table").alias("target"), F.lit(True).alias("out")))
            reached = reached.join(found_p.select("root", "program"), ["root", "program"], "left_anti")
        process = store(reached.withColumn("level", F.lit(2 * depth + 1)), "processes")
        if process.isEmpty():
            break
        found_p = process if found_p is None else found_p.unionByName(process)
        edges.append(process.select("root", F.col("program").alias("source"), F.col("table").alias("target"), F.lit(True).alias("out")))
        read = store(process.select("root", "program", F.col("table").alias("target")).join(kept, ["program", "target"]).select("root", "program", F.col("source").alias("table")).distinct(), "reads")
        edges.append(read.select("root", F.col("table").alias("source"), F.col("program").alias("target"), F.lit(False).alias("out")))
        last = store(read.select("root", "table").distinct().join(tables.select("root", "table"), ["root", "table"], "left_anti").withColumn("level", F.lit(2 * depth + 2)), "levels")
        tables = tables.unionByName(last)
    none = tables.select("root", F.col("table").alias("program"), "table", "level").limit(0)
    found_p = none if found_p is None else found_p
    every = store(_union(edges).distinct() if edges else none.select("root", F.col("table").alias("source"), F.col("table").alias("target"), F.lit(True).alias("out")), "edges")
    clock = times.groupBy("table").agg(F.min("seconds").alias("seconds"))
    clock = store(clock, "times")
    followed = found_p.select("root", "table").distinct().withColumn("followed", F.lit(True))
    kind = F.when(F.col("level") == 0, KINDS[0]).when(F.col("followed"), KINDS[2]).otherwise(KINDS[3])
    t = tables.join(followed, ["root", "table"], "left").withColumn("kind", kind).join(clock, "table", "left")
    p = found_p.groupBy("root", "program").agg(F.min("level").alias("level"), F.min("table").alias("table")).join(clock, "table", "left")
    feeds = every.where("not out").select("root", F.col("source").alias("table"), F.col("target").alias("program")).join(p.select("root", "program", F.col("seconds").alias("later")), ["root", "program"])
    feeds = feeds.groupBy("root", "table").agg(F.min("later").alias("later"))
    t = t.join(feeds, ["root", "table"], "left").withColumn("seconds", F.when(F.col("kind") == KINDS[3], F.coalesce("seconds", "later")).otherwise(F.col("seconds")))
    nodes = t.select("root", "kind", F.col("table").alias("node"), "level", "seconds").unionByName(p.select("root", F.lit(KINDS[1]).alias("kind"), F.col("program").alias("node"), "level", "seconds"))
    turn = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    place = F.row_number().over(Window.partitionBy("root", "level").orderBy(F.col("seconds").asc_nulls_last(), turn, "node"))
    late = nodes.where((F.col("kind") != KINDS[1]) & F.col("seconds").isNotNull() & F.coalesce(terminal(F.col("node")), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("seconds"), "node"))
    late = late.withColumn("alert", rank).where(F.col("alert") <= alerts).select("root", "kind", "node", "alert")
    return nodes.withColumn("place", place).join(late, ["root", "kind", "node"], "left").select("root", "kind", "node", "level", "place", "seconds", "alert"), every.select("root", "source", "target")
