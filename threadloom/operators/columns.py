"""Columns across statements: chains of producers, and what a star stands for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from threadloom.functions.tables import forget, store
from threadloom.operators import blocks
from threadloom.operators.graph import strong_components

#: What a chain that gives no source ends in; of several, the first here is told.
STATES = ("CYCLE", "AMBIGUOUS", "UNRESOLVED", "MISSING")


def producer_chains(definitions: DataFrame, internal: Callable[[Column], Column], near: str | None = None) -> DataFrame:
    """(table, column, state, source_table, source_column, program): where each defined column comes from in the end.

    definitions are (program, table, column, source_table, source_column, state): one row for each column that an expression
    names, with the state that its statement gave it; an expression without any has a null source. A source whose table is `internal` is
    followed to the definitions of that column, all others are ends. Several programs that define a column all count. A chain
    that meets a cycle, an ambiguous or unresolved column, or an internal column without definition resolves nothing: one bad chain decides its column,
    and ambiguity is never guessed away. The program of a source is the one that reads it.

    Every column keeps the set of what it has reached; a round puts what those reached in their place, so rounds grow with the logarithm
    of the chains. What is still open after LOOK_AT rounds is searched for cycles, whose columns are ends from then on.

    `near` names a further column that definitions of one chain mostly share. It is only a hint: groups of at most MOST_ROWS definitions
    by it that share no column with others are followed in blocks by tasks, and all others in rounds.
    """
    known = F.col("state") == "RESOLVED"
    if near is None:
        return _in_rounds(definitions, internal)
    followed = known & F.col("source_table").isNotNull() & F.col("source_column").isNotNull()
    rank = F.when(~known, F.coalesce(*[F.when(F.col("state") == s, k) for k, s in enumerate(STATES)], F.lit(STATES.index("UNRESOLVED")))).when(followed, F.lit(None)).otherwise(STATES.index("UNRESOLVED"))
    columns = ["table", "column", "source_table", "source_column", "program"]
    rows = definitions.where(F.col("table").isNotNull() & F.col("column").isNotNull())
    rows = rows.select(F.xxhash64(near).alias("group"), *columns, "state", rank.cast("int").alias("rank"), F.coalesce(internal(F.col("source_table")), F.lit(False)).alias("inner"))
    rows = store(rows, "definitions")
    ends = F.when(F.col("rank").isNull() & F.col("inner"), F.xxhash64("source_table", "source_column")).alias("src"), F.xxhash64("table", "column").alias("dst")
    closed, open_ = blocks.apart(rows.select("*", *ends), MOST_ROWS)
    kind = {c: definitions.schema[c].dataType.simpleString() for c in columns}
    schema = f"table {kind['table']}, column {kind['column']}, state string, source_table {kind['source_table']}, source_column {kind['source_column']}, program {kind['program']}"
    found = closed.select("group", *columns, "rank", "inner").repartition("group").sortWithinPartitions("group").mapInArrow(_in_blocks, schema)
    return found if open_ is None else found.unionByName(_in_rounds(open_, internal))


def _in_blocks(batches):
    """The chains of sorted (group, definition, rank of a bad state, inner), whose groups share no columns."""
    for block in blocks.whole(batches):
        group, table, column, source_table, source_column, program, rank, inner = block.columns
        _, (g,) = blocks.coded(group)
        tables, (t, st) = blocks.coded(table, source_table)
        columns, (c, sc) = blocks.coded(column, source_column)
        programs, (p,) = blocks.coded(program)
        nodes, v = np.unique((g * len(tables) + t) * len(columns) + c, return_inverse=True)
        at = (g * len(tables) + st) * len(columns) + sc
        w = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
        bad, inner = rank.fill_null(-1).to_numpy(), inner.to_numpy()
        bad = np.where((bad < 0) & inner & (nodes[w] != at), STATES.index("MISSING"), bad)
        follow, ends = np.flatnonzero((bad < 0) & inner), np.flatnonzero((bad < 0) & ~inner)
        part = blocks.tarjan(len(nodes), v[follow], w[follow])
        none = len(STATES)
        worst = np.full(len(nodes), none)
        np.minimum.at(worst, v[bad >= 0], bad[bad >= 0])
        worst[np.bincount(part)[part] > 1] = worst[v[follow[v[follow] == w[follow]]]] = STATES.index("CYCLE")
        worst, order = worst.tolist(), np.argsort(part, kind="stable").tolist()
        follow = follow[np.argsort(v[follow], kind="stable")]
        to, first = w[follow].tolist(), np.searchsorted(v[follow], np.arange(len(nodes) + 1)).tolist()
        own: dict[int, set[int]] = {}
        for x, source in zip(v[ends].tolist(), ((st[ends] * len(columns) + sc[ends]) * len(programs) + p[ends]).tolist(), strict=True):
            own.setdefault(x, set()).add(source)
        # components are numbered from the ends of chains on, so what a column reads is settled before it
        sources: list[set[int] | None] = [None] * len(nodes)
        good, counts, flat = [], [], []
        for x in order:
            reads = to[first[x] : first[x + 1]]
            for y in reads:
                if worst[y] < worst[x]:
                    worst[x] = worst[y]
            if worst[x] < none:
                continue
            found = None
            for more in [*(sources[y] for y in reads), own.get(x)]:
                if more is not None and found is not more:
                    found = more if found is None else found if more <= found else found | more
            sources[x] = found
            good.append(x)
            counts.append(len(found))
            flat += found
        worst = np.array(worst)
        bad, good, flat = np.flatnonzero(worst < none), np.repeat(np.array(good, np.int64), counts), np.array(flat, np.int64)
        node = nodes[np.concatenate([good, bad])]
        source, by = np.divmod(flat, len(programs))
        blank = lambda values, k: pa.concat_arrays([values.take(pa.array(k)), pa.nulls(len(bad), values.type)])
        state = pa.array([*STATES, "RESOLVED"]).take(pa.array(np.concatenate([np.full(len(good), none), worst[bad]])))
        table = tables.take(pa.array(node // len(columns) % len(tables))), columns.take(pa.array(node % len(columns)))
        out = *table, state, blank(tables, source // len(columns)), blank(columns, source % len(columns)), blank(programs, by)
        yield from pa.table(dict(zip(("table", "column", "state", "source_table", "source_column", "program"), out, strict=True))).to_batches()


def _in_rounds(definitions: DataFrame, internal: Callable[[Column], Column]) -> DataFrame:
    """The chains set at a time."""
    known = F.col("state") == "RESOLVED"
    source = F.when(known & F.col("source_table").isNotNull() & F.col("source_column").isNotNull(), F.struct(F.col("source_table").alias("t"), F.col("source_column").alias("c")))
    rows = definitions.select(F.struct(F.col("table").alias("t"), F.col("column").alias("c")).alias("node"), source.alias("at"), "program", F.when(~known, F.col("state")).when(source.isNull(), "UNRESOLVED").alias("bad"))
    rows = store(rows.where("node.t is not null and node.c is not null").distinct(), "definitions")
    made = rows.select(F.col("node").alias("at")).distinct().withColumn("made", F.lit(True))
    inner = F.coalesce(internal(F.col("at.t")), F.lit(False))
    kind = F.when(F.col("bad").isNotNull(), F.col("bad")).when(~inner, "SOURCE").when(F.col("made").isNull(), "MISSING")
    flow = rows.join(made, "at", "left").withColumn("end", kind).select("node", "at", "program", "end")
    flow = reach = store(flow, "flow")
    rounds = 0
    while not reach.where("end is null").isEmpty():
        rounds += 1
        if rounds == LOOK_AT:
            reach = _cut_cycles(flow, reach)
        further = reach.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("program").alias("by"), F.col("end").alias("until"))
        longer = reach.where("end is null").drop("program", "end").join(further, "at").select("node", F.col("to").alias("at"), F.col("by").alias("program"), F.col("until").alias("end"))
        was, reach = reach, store(reach.where("end is not null").unionByName(longer).distinct(), "reach")
        if was is not flow:
            forget(was)
    order = F.coalesce(*[F.when(F.col("end") == s, k) for k, s in enumerate(STATES)], F.when(F.col("end") != "SOURCE", STATES.index("UNRESOLVED")))
    worst = reach.groupBy("node").agg(F.min(order).alias("worst"))
    names = F.array(*map(F.lit, STATES))
    bad = worst.where("worst is not null").select(F.col("node.t").alias("table"), F.col("node.c").alias("column"), names[F.col("worst")].alias("state"))
    good = reach.join(worst.where("worst is null").select("node"), "node", "left_semi")
    good = good.select(F.col("node.t").alias("table"), F.col("node.c").alias("column"), F.lit("RESOLVED").alias("state"), F.col("at.t").alias("source_table"), F.col("at.c").alias("source_column"), "program").distinct()
    return good.unionByName(bad, allowMissingColumns=True)


#: Most definitions of a group that a task follows by itself; what they reach may be the square of that.
MOST_ROWS = 1000
#: Rounds, of doubled length each, after which what is left open is searched for cycles.
LOOK_AT = 6


def _cut_cycles(flow: DataFrame, reach: DataFrame) -> DataFrame:
    """A column on a cycle becomes an end for itself and for those that read it."""
    open_ = store(reach.where("end is null").select("node").distinct(), "open")
    follow = flow.where("end is null").select(F.col("node").alias("src"), F.col("at").alias("dst"))
    follow = follow.join(open_.withColumnRenamed("node", "src"), "src", "left_semi").join(open_.withColumnRenamed("node", "dst"), "dst", "left_semi")
    follow = store(follow.select("src", "dst"), "follow")
    loops = strong_components(follow).select("node").unionByName(follow.where("src = dst").select(F.col("src").alias("node"))).distinct()
    loops = store(loops.withColumn("on_cycle", F.lit(True)), "on-cycles")
    both = reach.join(loops, "node", "left").join(loops.select(F.col("node").alias("at"), F.col("on_cycle").alias("into")), "at", "left")
    end = F.when(F.col("on_cycle"), "CYCLE").when(F.col("end").isNull() & F.col("into"), "CYCLE").otherwise(F.col("end"))
    at = F.when(F.coalesce("on_cycle", F.lit(False)), F.col("node")).otherwise(F.col("at"))
    return store(both.select("node", at.alias("at"), "program", end.alias("end")).distinct(), "reach")


def expand_stars(items: DataFrame, relations: DataFrame, metadata: DataFrame) -> DataFrame:
    """(query, position, name, table, column, state): select lists with their stars written out.

    items are (query, ordinal, qualifier, column, alias), column '*' for a star; relations (query, place, alias, table, using), in order of
    the FROM clause, `using` the columns of the join that brings the relation in; metadata (table, position, column). Names compare
    without case.

    A star takes the columns of its relations in their order. Columns of a USING stand first, once, and come from every
    relation that they join: one row for each. A star over a relation without metadata is one row, UNRESOLVED; so is a qualifier that
    names no relation. A USING whose column is on the left more than once, or a name that several relations have, is AMBIGUOUS; nothing is guessed.
    """
    up = lambda c: F.upper(F.col(c))
    rel = relations.select("query", "place", up("alias").alias("alias"), up("table").alias("table"), F.transform(F.coalesce("using", F.array().cast("array<string>")), F.upper).alias("using"))
    meta = metadata.select(up("table").alias("table"), F.col("position").alias("at"), up("column").alias("column"))
    shown = store(rel.join(meta, "table", "left").select("query", "place", "alias", "table", "at", "column", "using"), "columns")
    has = shown.where("column is not null")

    # columns of USING: where they are on the left, and what they merge
    uses = rel.where("place > 1").select("query", "place", F.posexplode("using").alias("k", "column"))
    seen = has.select("query", "place", "column", F.lit(1).alias("has"), F.lit(0).alias("uses"), F.lit(None).cast("int").alias("k"))
    seen = seen.unionByName(uses.select("query", "place", "column", F.lit(0).alias("has"), F.lit(1).alias("uses"), "k"))
    seen = seen.groupBy("query", "column", "place").agg(F.sum("has").alias("has"), F.sum("uses").alias("uses"), F.min("k").alias("k"))
    seen = seen.join(uses.select("query", "column").distinct(), ["query", "column"], "left_semi")
    left = Window.partitionBy("query", "column").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    visible = F.coalesce(F.sum(F.col("has") - F.col("uses")).over(left), F.lit(0))
    merges = seen.withColumn("visible", visible).where("uses > 0").groupBy("query", "column")
    merges = merges.agg(F.max("place").alias("last"), F.max_by("k", "place").alias("k"), F.max(F.when((F.col("has") == 0) | (F.col("visible") < 1), 2).when(F.col("visible") > 1, 1).otherwise(0)).alias("fault"))
    merges = store(merges, "merges")
    whole = rel.groupBy("query").agg(F.count(F.lit(1)).alias("n")).join(shown.where("column is null").select("query").distinct().withColumn("unknown", F.lit(True)), "query", "left")
    faults = merges.groupBy("query").agg(F.max("fault").alias("fault"))
    whole = store(whole.join(faults, "query", "left").select("query", F.coalesce("unknown", F.lit(False)).alias("unknown"), F.coalesce("fault", F.lit(0)).alias("fault")), "queries")

    picked = items.select("query", "ordinal", up("qualifier").alias("qualifier"), up("column").alias("wanted"), up("alias").alias("named"))
    stars, plain = picked.where("wanted = '*'"), picked.where("wanted <> '*'")
    columns = has.join(merges.drop("fault"), ["query", "column"], "left")
    merged = F.col("last").isNotNull() & (F.col("place") <= F.col("last"))
    # a place that sorts merged columns first, the last USING before the others
    first = F.when(merged, F.struct(F.lit(0).alias("a"), (-F.col("last")).alias("b"), F.col("k").alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("place").alias("b"), F.col("at").cast("int").alias("c")))
    columns = store(columns.withColumn("key", first).select("query", "place", "alias", "table", "at", "column", "key"), "ordered")

    bare = stars.where("qualifier is null").join(whole, "query", "left")
    verdict = F.when(F.col("unknown").isNull() | F.col("unknown") | (F.col("fault") == 2), "UNRESOLVED").when(F.col("fault") == 1, "AMBIGUOUS")
    failed = bare.where(verdict.isNotNull()).select("query", "ordinal", verdict.alias("state"))
    spread = bare.where(verdict.isNull()).select("query", "ordinal").join(columns, "query").select("query", "ordinal", "key", F.col("column").alias("name"), "table", "column", F.lit("RESOLVED").alias("state"))
    of = shown.select("query", "alias", "table", "at", "column", "place")
    named = stars.where("qualifier is not null").join(of, (stars["query"] == of["query"]) & (stars["qualifier"] == of["alias"]), "left").select(stars["query"], "ordinal", "place", "table", "at", "column")
    state = F.when(F.col("column").isNull(), "UNRESOLVED").otherwise("RESOLVED")
    own = named.select("query", "ordinal", F.struct(F.lit(1).alias("a"), F.coalesce("place", F.lit(0)).alias("b"), F.coalesce(F.col("at").cast("int"), F.lit(0)).alias("c")).alias("key"), F.coalesce("column", F.concat(F.lit("STAR_"), F.col("ordinal").cast("string"))).alias("name"), F.when(F.col("column").isNotNull(), F.col("table")).alias("table"), "column", state.alias("state"))

    # plain columns: one relation has them, or all that have them are merged
    held = columns.join(merges.select("query", "column", "last"), ["query", "column"], "left").withColumn("group", F.when(F.col("place") <= F.col("last"), F.lit(0)).otherwise(F.col("place")))
    match = plain.join(held, (plain["query"] == held["query"]) & (plain["wanted"] == held["column"]) & (plain["qualifier"].isNull() | (plain["qualifier"] == held["alias"])), "left")
    match = match.select(plain["query"], "ordinal", "wanted", "named", "qualifier", "table", "column", "group")
    among = Window.partitionBy("query", "ordinal")
    match = match.withColumn("least", F.min("group").over(among)).withColumn("most", F.max("group").over(among)).join(whole, "query", "left")
    open_ = F.col("qualifier").isNull() & (F.coalesce("unknown", F.lit(True)))
    kind = F.when(F.col("column").isNull() | (open_ & F.col("least").isNotNull()), "UNRESOLVED").when(F.col("least") != F.col("most"), "AMBIGUOUS").otherwise("RESOLVED")
    sure = kind == "RESOLVED"
    single = match.select("query", "ordinal", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("key"), F.coalesce("named", "wanted").alias("name"), F.when(sure, F.col("table")).alias("table"), F.when(sure, F.col("column")).alias("column"), kind.alias("state")).distinct()
    lost = failed.select("query", "ordinal", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("key"), F.concat(F.lit("STAR_"), F.col("ordinal").cast("string")).alias("name"), F.lit(None).cast("string").alias("table"), F.lit(None).cast("string").alias("column"), "state")
    every = spread.unionByName(own).unionByName(single).unionByName(lost)
    place = F.dense_rank().over(Window.partitionBy("query").orderBy("ordinal", "key")).cast("int")
    return every.select("query", place.alias("position"), "name", "table", "column", "state").distinct()
