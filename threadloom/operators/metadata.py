"""Joins over job, plan and column metadata: receipts, layered graphs, column walks, truth metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from threadloom.functions.tables import bounded, store
from threadloom.operators.graph import levels


def receipts(plans: DataFrame, outputs: DataFrame, depends: DataFrame, prefix: str) -> DataFrame:
    """(plan, job, target): from a plan's job (plan, job), all jobs that depend on it whose output (job, target) begins with prefix."""
    down = levels(depends, plans.select(F.col("job").alias("start")), "down")
    reached = down.join(plans.withColumnRenamed("job", "start"), "start").select("plan", F.col("node").alias("job"))
    return reached.join(outputs.where(F.startswith("target", F.lit(prefix))), "job").select("plan", "job", "target").distinct()


#: Code points of the pieces by which patterns and texts meet.
GRAM = 4


def _grams(x: Column, size: int) -> Column:
    """The distinct pieces of `size` characters: one pass splits the text, so that no piece is counted off from its beginning."""
    pieces = lambda cs: F.transform(cs, lambda c, k: F.concat(c, *[F.get(cs, k + j) for j in range(1, size)]))
    whole = F.element_at(F.transform(F.array(F.filter(F.split(x, ""), lambda c: c != "")), pieces), 1)
    return F.array_compact(F.array_distinct(whole))


def containing(texts: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """(key, pattern): patterns (a column `pattern`) found in texts, whatever the case. Keys are unique.

    A pattern is looked for by one piece of it: the one that fewest patterns have. Pieces of texts that are some pattern's
    meet them in a join, and what meets is verified on the whole text; patterns shorter than a piece are pieces of their own length. Neither
    side goes through the driver, and patterns are broadcast only if they are counted few.
    """
    known = store(patterns.where("pattern <> ''").select(F.upper("pattern").alias("pattern")).distinct(), "patterns")
    size = F.least(F.length("pattern"), F.lit(GRAM))
    sizes = sorted(r[0] for r in known.select(size.alias("size")).distinct().collect())  # at most GRAM numbers
    rows = texts.where(F.col(text).isNotNull()).select(key, F.upper(text).alias("__text"))
    if not sizes:
        return rows.select(key, F.lit("").alias("pattern")).limit(0)
    pieces = F.when(size == sizes[0], _grams(F.col("pattern"), sizes[0]))
    for n in sizes[1:]:
        pieces = pieces.when(size == n, _grams(F.col("pattern"), n))
    pieces = store(known.select("pattern", F.explode(pieces).alias("gram")), "grams")
    shared = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = store(pieces.join(shared, "gram").groupBy("pattern").agg(F.min(F.struct("n", "gram")).alias("least")).select("pattern", "least.gram"), "chosen")
    grams = bounded(chosen.select("gram").distinct(), 32)
    here = rows.select(key, F.explode(F.array_distinct(F.concat(*[_grams(F.col("__text"), n) for n in sizes]))).alias("gram")).join(grams, "gram", "left_semi")
    met = store(here.join(bounded(chosen, 64), "gram").select(key, "pattern").distinct(), "met")
    return rows.join(met, key).where(F.contains("__text", F.col("pattern"))).select(key, "pattern")


def layered(job_reads: DataFrame, job_writes: DataFrame, start: DataFrame, max_depth: int = 30) -> DataFrame:
    """(start, node, kind, column): upstream over tables and processes in turn, by levels from each start table.

    reads and writes are (job, table); a job that reads what it writes isn't followed back into itself.
    """
    table, task = (lambda c: F.concat(F.lit("table:"), c)), (lambda c: F.concat(F.lit("task:"), c))
    own = job_reads.join(job_writes, ["job", "table"], "left_anti")
    up = job_writes.select(table("table").alias("src"), task("job").alias("dst")).union(own.select(task("job"), table("table")))
    found = levels(up, start.select(table("table").alias("start")), "down", max_depth)
    return found.select(F.substring_index("start", ":", -1).alias("start"), F.substring_index("node", ":", -1).alias("node"), F.substring_index("node", ":", 1).alias("kind"), F.col("level").alias("column"))


def column_walk(relations: DataFrame, start: DataFrame, max_depth: int = 30) -> DataFrame:
    """(start, node, level) downstream over columns; relations are (schema, table, column, to_schema, to_table, to_column), start (node)."""
    key = lambda *c: F.concat_ws(".", *[F.upper(F.col(x)) for x in c])
    edges = relations.select(key("schema", "table", "column").alias("src"), key("to_schema", "to_table", "to_column").alias("dst"))
    return levels(edges, start.select(F.col("node").alias("start")), "down", max_depth)


def find_start(names: DataFrame, wanted: DataFrame, most: int = 1000) -> DataFrame:
    """(wanted, match, state): an exact name, else the only name that ends with or holds it, else how many do.

    wanted is what people ask for, at most `most` of them; each name is held against them in one pass.
    """
    asked = [r[0] for r in wanted.where("wanted is not null").select("wanted").distinct().limit(most + 1).collect()]
    if len(asked) > most:
        raise ValueError(f"more than {most} starts; split them into several calls")
    held = F.filter(F.array(*map(F.lit, asked)).cast("array<string>"), lambda w: F.contains(F.upper(F.col("name")), F.upper(w)))
    hit = names.select("name", F.explode(held).alias("wanted"))
    exact = F.max(F.when(F.upper("name") == F.upper("wanted"), F.col("name")))
    ends = F.endswith(F.upper("name"), F.upper("wanted"))
    got = hit.groupBy("wanted").agg(exact.alias("exact"), F.count_if(ends).alias("n_ends"), F.min(F.when(ends, F.col("name"))).alias("ends"), F.count(F.lit(1)).alias("n"), F.min("name").alias("holds"))
    state = F.when(F.col("exact").isNotNull(), "EXACT").when(F.col("n_ends") == 1, "SUFFIX").when(F.col("n") == 1, "CONTAINS").when(F.col("n").isNull(), "NONE").otherwise("CANDIDATES")
    match = F.coalesce("exact", F.when(F.col("n_ends") == 1, F.col("ends")), F.when(F.col("n") == 1, F.col("holds")))
    return wanted.select("wanted").distinct().join(got, "wanted", "left").select("wanted", match.alias("match"), state.alias("state"), F.coalesce("n", F.lit(0)).alias("candidates"))


def terminal_targets(edges: DataFrame) -> DataFrame:
    """What is written and never read."""
    return edges.select(F.col("dst").alias("target")).distinct().join(edges.select(F.col("src").alias("target")), "target", "left_anti")


def truth_metrics(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per sample exact, missing, extra and wrong: steps (sample, position, target, sources) side by side."""
    a, b = expected.select("sample", "position", F.struct("target", "sources").alias("e")), actual.select("sample", "position", F.struct("target", "sources").alias("a"))
    both = a.join(b, ["sample", "position"], "full")
    return both.groupBy("sample").agg(
        F.count_if(F.col("e") == F.col("a")).alias("exact"),
        F.count_if(F.col("a").isNull()).alias("missing"),
        F.count_if(F.col("e").isNull()).alias("extra"),
        F.count_if(F.col("e.target") != F.col("a.target")).alias("wrong_target"),
        F.count_if((F.col("e.target") == F.col("a.target")) & (F.col("e.sources") != F.col("a.sources"))).alias("wrong_sources"),
    )


def unclassified(roles: DataFrame, business_up: DataFrame, business_down: DataFrame) -> DataFrame:
    """K8: (node, issue_type): nodes without a schema that only feed or only receive, and touch a business node that way."""
    bare = roles.where(~F.contains("node", F.lit(".")))
    source = bare.where("role = 'SOURCE_ONLY'").join(business_down, "node", "left_semi").select("node", F.lit("UNCLASSIFIED_FORMAL_SOURCE").alias("issue_type"))
    sink = bare.where("role = 'SINK_ONLY'").join(business_up, "node", "left_semi").select("node", F.lit("UNCLASSIFIED_FORMAL_SINK").alias("issue_type"))
    return source.unionByName(sink)


def definition(name: DataFrame, *kinds: DataFrame) -> DataFrame:
    """The first definition of a name among tables, views and foreign tables (each (name, ddl))."""
    out = name.select("name")
    for k, df in enumerate(kinds):
        out = out.join(df.select("name", F.col("ddl").alias(f"__{k}")), "name", "left")
    return out.select("name", F.coalesce(*[F.col(f"__{k}") for k in range(len(kinds))]).alias("ddl"))


def scope_of(environments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(environment, sql_profile, schedule_profile), NULL profiles unless exactly one pair is configured."""
    one = environments.groupBy("environment").agg(F.countDistinct("sql_profile", "schedule_profile").alias("n"), F.min("sql_profile").alias("a"), F.min("schedule_profile").alias("b"))
    got = wanted.select("environment").join(one, "environment", "left")
    return got.select("environment", F.when(F.col("n") == 1, F.col("a")).alias("sql_profile"), F.when(F.col("n") == 1, F.col("b")).alias("schedule_profile"))


def timestamp_text(x: Column) -> Column:
    """C10."""
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def latest(rows: DataFrame, by: str, value: str) -> DataFrame:
    """F6."""
    return rows.groupBy(by).agg(F.max(value).alias("latest"))


def ordered_page(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """a deterministic first page with its places."""
    top = rows.distinct().orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
