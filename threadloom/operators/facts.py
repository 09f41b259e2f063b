"""Aggregates, ranked picks and joins over lineage facts (D, E, W, R and N rows of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from threadloom.functions.names import ratio, table_aliases
from threadloom.functions.tables import bounded, store


def coverage_funnel(programs: DataFrame) -> DataFrame:
    """Per environment and profile, how many programs get how far, with ratios; flags are booleans."""
    n = F.count(F.lit(1))
    count = lambda c: F.count_if(F.col(c))
    out = programs.groupBy("environment", "profile").agg(n.alias("programs"), count("parsed").alias("parsed"), count("has_target").alias("with_target"), count("has_edges").alias("with_edges"))
    for a in ("parsed", "with_target", "with_edges"):
        out = out.withColumn(f"{a}_ratio", F.round(ratio(F.col(a), F.col("programs")), 6))
    return out


def coverage_steps(steps: DataFrame) -> DataFrame:
    """E7 below programs: per environment and profile steps, those with target, sources and edges, distinct nodes, and the ratios of each to the one before.

    steps is (environment, profile, program, target, sources array, edges): an edge count of 0 is a step without lineage.
    """
    some = lambda c: F.count_if(c)
    out = steps.groupBy("environment", "profile").agg(
        F.count(F.lit(1)).alias("steps"),
        some(F.col("target").isNotNull()).alias("targets"),
        some(F.size("sources") > 0).alias("sourced"),
        some(F.col("edges") > 0).alias("linked"),
        F.sum("edges").alias("edges"),
        F.countDistinct("target").alias("distinct_targets"),
    )
    pairs = (("target", "targets", "steps"), ("source", "sourced", "steps"), ("link", "linked", "targets"), ("edge", "edges", "linked"))
    return out.select("*", *[F.round(ratio(F.col(a), F.col(b)), 6).alias(f"{name}_ratio") for name, a, b in pairs])


def reason_histogram(programs: DataFrame, reason: Column) -> DataFrame:
    """Per environment and profile how many programs fail for which reason, those that don't left out."""
    named = programs.select("environment", "profile", reason.alias("reason")).where("reason is not null")
    return named.groupBy("environment", "profile", "reason").agg(F.count(F.lit(1)).alias("programs"))


def corpus_metrics(samples: DataFrame, by: str) -> DataFrame:
    """True and false positives, ambiguous, precision (NULL without a verdict), for each value of `by` and overall (NULL)."""
    count = lambda v: F.count_if(F.col("label") == v)
    sets = samples.groupingSets([[by], []], by).agg(count("TP").alias("tp"), count("FP").alias("fp"), count("AMBIGUOUS").alias("ambiguous"), F.count(F.lit(1)).alias("n"))
    verdicts = F.nullif(F.col("tp") + F.col("fp"), F.lit(0).cast("long"))
    return sets.withColumn("precision", F.round(F.col("tp") / verdicts, 6)).withColumn("ambiguous_rate", F.round(F.col("ambiguous") / F.nullif(F.col("n"), F.lit(0).cast("long")), 6))


def evidence(contributions: DataFrame, keys: list[str], item: str, most: int) -> DataFrame:
    """Exact counts, the first `most` distinct items in order, and whether more exist. A key's list never holds more than `most`."""
    counts = contributions.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"))  # once an item, so hot keys are spread over items
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("facts"), F.count(item).alias("distinct_items"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(item))
    first = counts.where(F.col(item).isNotNull()).withColumn("k", rank).where(F.col("k") <= most)  # the limit is applied before rows move
    first = first.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("sample"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = totals.join(first, same, "left").select(*keys, "facts", "distinct_items", F.coalesce("sample", F.lit("")).alias("sample"))
    return out.withColumn("truncated", F.col("distinct_items") > most)


def multiset_minus(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key b lacks, repeats kept."""
    return a.join(b.select(key), key, "left_anti")


def quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Inclusive P50 and P95, exact, with the value between two places interpolated.

    Distinct values are counted first and dealt to tasks by ranges of (group, value); a task runs the counts of its own range, and the
    sums of the ranges before, a row for each group in a range, are added. So one group of all rows is spread like many.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    counts = store(counts.repartitionByRange(by, value).withColumn("part", F.spark_partition_id()), "counts")
    sums = counts.groupBy(by, "part").agg(F.sum("n").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(by).alias("__by"), F.col("part").alias("__part"), before.alias("before"), F.sum("sum").over(Window.partitionBy(by)).alias("total"))
    running = counts.withColumn("run", F.sum("n").over(Window.partitionBy(by, "part").orderBy(value)))
    placed = running.join(bounded(store(sums, "sums")), F.col(by).eqNullSafe(F.col("__by")) & (F.col("part") == F.col("__part"))).withColumn("end", F.col("before") + F.col("run"))
    aggs, out = [F.max(value).alias("most")], []
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        at = (F.col("total") - 1) * p
        on = lambda k: F.max(F.when((F.col("end") - F.col("n") <= k) & (k < F.col("end")), F.col(value)))
        aggs += [on(F.floor(at)).alias(f"{name}_low"), on(F.ceil(at)).alias(f"{name}_high"), F.max(at - F.floor(at)).alias(f"{name}_part")]
        out.append(F.round(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part"), 6).alias(name))
    return placed.groupBy(by).agg(*aggs).select(by, *out, "most")


def latest_by_alias(tables: DataFrame, times: DataFrame) -> DataFrame:
    """(name, earliest): the earliest time of any alias of a table, NULL if none has one."""
    aliased = tables.select("name", F.explode(table_aliases(F.col("name"))).alias("alias"))
    return aliased.join(times.groupBy("alias").agg(F.min("seconds").alias("seconds")), "alias", "left").groupBy("name").agg(F.min("seconds").alias("earliest"))


def stratified_sample(rows: DataFrame, by: str, key: str, seed: str, n: int) -> DataFrame:
    """Of each stratum the n rows of least seeded hash."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def representative(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the least row by `order`; a grouped minimum, so that no group is sorted."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]])


def step_order(steps: DataFrame, by: str, order: list[str]) -> DataFrame:
    """W3."""
    return steps.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def slowest(rows: DataFrame, value: str, ties: list[str], n: int = 3) -> DataFrame:
    """The n largest with their ranks; a top-n that never sorts the table."""
    top = rows.orderBy(F.desc(value), *ties).limit(n)
    return top.withColumn("alert", F.row_number().over(Window.orderBy(F.desc(value), *ties)))


def status_pivot(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category totals by status and completion in per cent; categories without rows are kept."""
    count = lambda s: F.count_if(F.col("status") == s)
    got = rows.groupBy("category").agg(F.count(F.lit(1)).alias("total"), count("SUCCESS").alias("success"), count("RUNNING").alias("running"), count("FAILED").alias("failed"))
    out = categories.join(got, "category", "left").na.fill(0, ["total", "success", "running", "failed"])
    return out.withColumn("completion", F.round(ratio(F.col("success") * 100, F.col("total")), 2))


def three_way(explicit: Column, metadata: Column, derived: Column) -> Column:
    """R2: verdict and winning value of three sources."""
    values = F.array_compact(F.array(explicit, metadata, derived))
    verdict = F.when(F.size(values) == 0, "MISSING").when(F.size(values) == 1, "SINGLE_SOURCE").when(F.size(F.array_distinct(values)) == 1, "MATCH").otherwise("CONFLICT")
    return F.struct(verdict.alias("verdict"), F.coalesce(explicit, metadata, derived).alias("value"))


def source_statistics(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Rows, nulls, empties and lengths of a text column."""
    n = F.length(text)
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(text).isNull()).alias("nulls"), F.count_if(n == 0).alias("empty"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))


def decode_statistics(rows: DataFrame, by: str, content: str, most_replaced: float = 0.1) -> DataFrame:
    """Of a binary column by profile: nulls; texts that are UTF-8 as they are (valid), after some bytes are replaced (repaired) and
    only after more than most_replaced of their characters are (invalid); least, largest and total lengths, raw and decoded.

    All sums, least and largest values: they merge in any order, and no text is kept.
    """
    x = F.col(content).cast("string")
    whole = F.make_valid_utf8(x)
    marks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\ufffd"), F.lit("")))
    raw, decoded = F.octet_length(F.col(content)).cast("long"), F.length(whole).cast("long")
    valid = F.is_valid_utf8(x)
    kept = ~valid & (marks(whole) <= most_replaced * decoded)
    length = lambda c, name: [F.min(c).alias(f"{name}_least"), F.max(c).alias(f"{name}_most"), F.sum(c).alias(f"{name}_total")]
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.count_if(valid).alias("valid"), F.count_if(kept).alias("repaired"), F.count_if(~valid & ~kept).alias("invalid")]
    return rows.groupBy(by).agg(*counts, *length(raw, "raw"), *length(decoded, "decoded"))


def length_histogram(rows: DataFrame, by: str, content: str) -> DataFrame:
    """(by, measure, low, n): how many raw and decoded lengths lie from low to below its double; 0 is a bucket of its own."""
    x = F.col(content)
    measures = {"raw": F.octet_length(x), "decoded": F.length(F.make_valid_utf8(x.cast("string")))}
    low = lambda n: F.when(n == 0, F.lit(0)).otherwise(F.pow(F.lit(2), F.length(F.bin(n.cast("long"))) - 1))
    pairs_ = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), low(n).cast("long").alias("low")) for m, n in measures.items()])).alias("x")
    return rows.where(x.isNotNull()).select(by, pairs_).groupBy(by, F.col("x.measure").alias("measure"), F.col("x.low").alias("low")).agg(F.count(F.lit(1)).alias("n"))


def type_histogram(rows: DataFrame, by: str, text: str) -> DataFrame:
    """How many texts of each kind: NULL, EMPTY, SQL, MARKUP, JSON or TEXT."""
    x = F.ltrim(F.col(text))
    kind = (
        F.when(x.isNull(), "NULL")
        .when(x == "", "EMPTY")
        .when(x.rlike(r"(?i)^(SELECT|INSERT|CREATE|UPDATE|DELETE|MERGE|WITH)\b"), "SQL")
        .when(x.startswith("<"), "MARKUP")
        .when(x.rlike(r"^[\[{]"), "JSON")
        .otherwise("TEXT")
    )
    return rows.groupBy(by, kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def evidence_matrix(profiles: DataFrame, features: list[str], found: DataFrame) -> DataFrame:
    """A cell for each profile and feature, UNKNOWN where nothing was found."""
    cells = profiles.select("profile", F.explode(F.array(*map(F.lit, features))).alias("feature"))
    return cells.join(found, ["profile", "feature"], "left").na.fill("UNKNOWN", ["state"])


def overlay(base: DataFrame, local: DataFrame, key: str, value: str) -> DataFrame:
    """Local values win, new keys are added."""
    b, o = base.select(key, F.col(value).alias("__b")), local.select(key, F.col(value).alias("__o"))
    return b.join(o, key, "full").select(key, F.coalesce("__o", "__b").alias(value))


def namespace_matches(physical: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Resolve names (logical, encoded) to the one name space of the same logical target that begins them at a token boundary.

    RESOLVED with one match, UNRESOLVED with none, CONFLICT with several. Each name meets name spaces by the beginnings that it has at token
    boundaries, a few rows a name, so a logical target of very many names costs no more than others.
    """
    tokens = F.split("encoded", "_")
    begins = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda k: F.array_join(F.slice(tokens, F.lit(1), k), "_")))).alias("namespace")
    hit = physical.select("logical", "encoded").distinct().select("logical", "encoded", begins).join(namespaces.select("logical", "namespace").distinct(), ["logical", "namespace"])
    found = hit.groupBy("logical", "encoded").agg(F.countDistinct("namespace").alias("candidates"), F.min("namespace").alias("namespace"))
    out = physical.select("logical", "encoded").distinct().join(found, ["logical", "encoded"], "left").na.fill(0, ["candidates"])
    state = F.when(F.col("candidates") == 0, "UNRESOLVED").when(F.col("candidates") == 1, "RESOLVED").otherwise("CONFLICT")
    return out.select("logical", "encoded", "candidates", F.when(F.col("candidates") == 1, F.col("namespace")).alias("namespace"), state.alias("state"))


def two_hops(jobs: DataFrame, deps: DataFrame) -> DataFrame:
    """(job, unload, process): a job's dependency and that one's dependency; '' where there is none."""
    first = deps.select(F.col("job"), F.col("dep").alias("unload"))
    second = deps.select(F.col("job").alias("unload"), F.col("dep").alias("process"))
    return jobs.select("job").join(first, "job", "left").join(second, "unload", "left").select("job", F.coalesce("unload", F.lit("")).alias("unload"), F.coalesce("process", F.lit("")).alias("process"))


def path_suffix_join(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Rows whose paths end in the same n components; a and b are (id, path)."""
    tail = lambda df, name: df.select(F.col("id").alias(name), F.array_join(F.slice(F.split("path", "/"), -n, n), "/").alias("tail")).where(F.size(F.split("path", "/")) >= n)
    return tail(a, "left_id").join(tail(b, "right_id"), "tail")


def task_projection(edges: DataFrame) -> DataFrame:
    """Business edges (source, target, program) as table-to-task and task-to-table edges with counts and keys."""
    ins = edges.select(F.concat(F.lit("table:"), "source").alias("src"), F.concat(F.lit("task:"), "program").alias("dst"), "program")
    outs = edges.select(F.concat(F.lit("task:"), "program").alias("src"), F.concat(F.lit("table:"), "target").alias("dst"), "program")
    both = ins.unionByName(outs).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("facts"))
    return both.withColumn("edge_key", F.sha2(F.concat_ws("\x1f", "src", "dst"), 256))


def projection_preflight(edges: DataFrame) -> DataFrame:
    """One row: facts in, edges out, nodes, bytes of names, and the reduction in per cent."""
    out = task_projection(edges)
    size = out.agg(F.count(F.lit(1)).alias("edges"), F.sum(F.length("src") + F.length("dst")).cast("long").alias("name_bytes"), F.sum("facts").cast("long").alias("facts"))
    nodes = out.select("src").union(out.select("dst")).agg(F.countDistinct("src").alias("nodes"))
    reduction = F.round((1 - ratio(F.col("edges"), F.col("facts"))) * 100, 2)
    return size.join(F.broadcast(nodes)).withColumn("reduction", reduction)  # one row and one row


def json_fields(rows: DataFrame, column: str) -> DataFrame:
    """How often each top-level key occurs."""
    return rows.select(F.explode(F.json_object_keys(column)).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def batches_of(rows: DataFrame, key: str, size: int, parts: int | None = None) -> DataFrame:
    """Batches of at most `size` rows: numbered inside hash parts, of which there are as many as the table's rows need."""
    parts = parts or max(64, rows.count() // 1_000_000)
    w = Window.partitionBy("part").orderBy(key)
    numbered = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))).withColumn("k", F.row_number().over(w))
    return numbered.withColumn("batch", F.concat_ws("-", "part", F.floor((F.col("k") - 1) / size))).drop("part", "k")
