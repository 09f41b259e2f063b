"""Rules on DDL, scripts, reports and schedules (Q1-Q11), and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.names import is_business, is_technical, normalize_table_name
from threadloom.functions.sqltext import all_tables, created_objects, hardcoded_dates, search_tokens, source_tables, used_functions
from threadloom.operators.graph import strong_components

#: The prefix of table names in a layer.
TABLE_PREFIXES = {"DWF": "F_", "DWM": "M_", "DWA": "A_", "DWP": "P_", "DWD": "RMD_"}
TEMP_PREFIX = "TMP_"
#: Layers whose columns need comments, and those whose names need registered roots.
COMMENT_LAYERS = ("DWA", "DWD", "DWF", "DWM", "DWP")
ROOT_LAYERS = ("DM", "DWA", "DWM")
#: The domains that plans may carry.
DOMAINS = ("BATCH_DOMAIN", "DEMO_DOMAIN", "STREAM_DOMAIN")


def _parts(name: Column) -> tuple[Column, Column]:
    return F.upper(F.substring_index(name, ".", 1)), F.upper(F.substring_index(name, ".", -1))


def naming_problem(name: Column, is_temp: Column) -> Column:
    """Q4: the prefix that the table's name should have and hasn't; NULL if all is well."""
    schema, table = _parts(name)
    want = F.element_at(F.create_map(*[F.lit(v) for kv in TABLE_PREFIXES.items() for v in kv]), schema)
    expected = F.when(is_temp | (schema == "TMP"), F.lit(TEMP_PREFIX)).otherwise(want)
    return F.when(~F.startswith(table, expected), expected)


def missing_roots(tables: DataFrame, roots: DataFrame) -> DataFrame:
    """Q6: (name, root): tokens of names in the checked layers, prefix and numbers aside, that aren't registered."""
    schema, table = _parts(F.col("name"))
    bare = table
    for layer, prefix in TABLE_PREFIXES.items():
        bare = F.when((schema == layer) & F.startswith(table, F.lit(prefix)), F.substring(table, len(prefix) + 1, 1 << 20)).otherwise(bare)
    tokens = tables.where(schema.isin(*ROOT_LAYERS)).select("name", F.explode(F.split(bare, "_")).alias("root")).where("root <> ''").where(~F.col("root").rlike(r"^\d+$"))
    return tokens.distinct().join(roots.select("root"), "root", "left_anti").select("name", "root")


def missing_comments(columns: DataFrame, comments: DataFrame) -> DataFrame:
    """Q5: (table, column) of the checked layers with neither inline nor separate comment."""
    schema, _ = _parts(F.col("table"))
    bare = columns.where(schema.isin(*COMMENT_LAYERS)).where(F.coalesce(F.col("comment"), F.lit("")) == "")
    return bare.join(comments.where("comment <> ''").select("table", "column"), ["table", "column"], "left_anti").select("table", "column")




def script_rules(text: Column) -> dict[str, Column]:
    u = F.upper(text)
    squeezed = F.regexp_replace(u, r"[ \t]", "")
    has = lambda x, s: F.contains(x, F.lit(s))
    return {
        "ALTER": has(u, "ALTER"),
        "DISTINCT": has(u, "DISTINCT"),
        "EQUALS_SUBQUERY": has(squeezed, "=(SELECT"),
        "FIXED_GROUP": has(u, "TO GROUP GROUP_VERSION1"),
        "FIXED_LENGTH": has(u, "CHARACTER VARYING(") | has(u, "VARCHAR2("),
        "HARDCODED_DATE": F.size(hardcoded_dates(text)) > 0,
        "IN_SUBQUERY": has(squeezed, "IN(SELECT"),
        "LOOP": has(u, "FOR I IN"),
        "NESTED_NULL_FUNCTION": has(u, "NVL(NVL(") | has(u, "COALESCE(COALESCE("),
        "OLD_JOIN": has(u, "(+)"),
        "RECURSIVE": has(u, "RECURSIVE"),
        "TOO_LONG": F.length(text) - F.length(F.replace(text, F.lit("\n"))) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1) > 20000,
        "VARCHAR2": has(u, "VARCHAR2"),
    }


def script_issues(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule): a row for each rule that a script breaks, in one pass over the scripts."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in script_rules(F.col(text)).items()]))
    return scripts.select(key, F.explode(found).alias("rule"))


#: Which rules hold for which kind of script, what a log line says, and names that need no schema.
KIND_RULES = {
    "SQL": ("ALTER", "CREATED_FUNCTION", "CREATED_VIEW", "DISTINCT", "FIXED_GROUP", "TOO_LONG", "USED_FUNCTION"),
    "HIVE": ("ALTER", "TOO_LONG", "VARCHAR2"),
    "PYTHON": (
        "CREATED_FUNCTION", "CREATED_VIEW", "DISTINCT", "EQUALS_SUBQUERY", "FIXED_LENGTH", "HARDCODED_DATE", "IN_SUBQUERY", "LOOP", "MISSING_LOG", "NESTED_NULL_FUNCTION",
        "OLD_JOIN", "PARTITION_MISMATCH", "RECURSIVE", "UNQUALIFIED_TABLE", "USED_FUNCTION",
    ),
}
LOG_TEXT = "影响条数"
BARE_NAMES = ("AGE", "DATETIME", "DUAL", "LAST_DAY")


def kind_issues(scripts: DataFrame, key: str, text: str, functions: list[str]) -> DataFrame:
    """Q1, Q2, Q3: (key, rule) by the script's kind, from (key, text, kind, partitioned): the last says what metadata know of the target.

    functions are the names that count as used functions. A target without known state has no partition rule.
    """
    x, u = F.col(text), F.upper(text)
    step = u.rlike(r"\bDEF\s+ROLLBACK_DEAL\s*\(") & u.rlike(r"(TRUNCATE|ADD|DROP|SPLIT) PARTITION")
    bare = F.filter(source_tables(x), lambda t: ~F.contains(t, F.lit(".")) & ~t.isin(*BARE_NAMES, *[f.upper() for f in functions]))
    rules = script_rules(x) | {
        "CREATED_FUNCTION": F.size(created_objects(x, "FUNCTION")) > 0,
        "CREATED_VIEW": F.size(created_objects(x, "VIEW")) > 0,
        "MISSING_LOG": ~F.contains(x, F.lit(LOG_TEXT)),
        "PARTITION_MISMATCH": step != F.col("partitioned"),
        "UNQUALIFIED_TABLE": F.size(bare) > 0,
        "USED_FUNCTION": F.size(used_functions(x, functions)) > 0,
    }
    kinds = {n: [k for k, names in KIND_RULES.items() if n in names] for n in rules}
    found = F.array_compact(F.array(*[F.when(F.col("kind").isin(*kinds[n]) & c, F.lit(n)) for n, c in sorted(rules.items()) if kinds[n]]))
    return scripts.select(key, F.explode(found).alias("rule"))


def schedule_issues(jobs: DataFrame, deps: DataFrame, online: DataFrame) -> DataFrame:
    """Q7: (job, rule): CASE, DOMAIN, DISABLED, PRIORITY, SELF_DEPENDENCY, UNKNOWN_DEPENDENCY and OUTPUT_CLASH.

    jobs is (job, domain, enabled, priority, output), deps (job, dep), online (job) all jobs known elsewhere.
    """
    rules = {
        "CASE": F.col("job") != F.upper("job"),
        "DISABLED": ~F.col("enabled"),
        "DOMAIN": ~F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False)),
        "PRIORITY": ~F.coalesce(F.col("priority").between(1, 9), F.lit(False)),
    }
    own = jobs.select("job", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))
    self_ = deps.where("job = dep").select("job", F.lit("SELF_DEPENDENCY").alias("rule"))
    known = jobs.select(F.col("job").alias("dep")).union(online.select("job"))
    unknown = deps.join(known, "dep", "left_anti").select("job", F.lit("UNKNOWN_DEPENDENCY").alias("rule"))
    clash = jobs.join(jobs.groupBy("output").agg(F.countDistinct("job").alias("n")).where("n > 1"), "output").select("job", F.lit("OUTPUT_CLASH").alias("rule"))
    return own.unionByName(self_).unionByName(unknown).unionByName(clash).distinct()


def empty_sequences(plans: DataFrame, jobs: DataFrame) -> DataFrame:
    """Q7: (plan, seq) of sequences that hold no job; plans is (plan, seq), jobs (seq, job)."""
    return plans.select("plan", "seq").distinct().join(jobs.where("job is not null").select("seq"), "seq", "left_anti").select("plan", "seq")


def cycle_issues(deps: DataFrame, near: str | None = None) -> DataFrame:
    """Q7: (job, CYCLE) for every job on a cycle of dependencies (job, dep), one that depends on itself too; near as for strong_components."""
    edges = deps.withColumnsRenamed({"job": "src", "dep": "dst"})
    found = strong_components(edges, near).select(F.col("node").alias("job")).unionByName(edges.where("src = dst").select(F.col("src").alias("job")))
    return found.distinct().withColumn("rule", F.lit("CYCLE"))


def sheet_tables(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, class) of the tables in each line's SQL: BUSINESS, TECHNICAL or UNCLASSIFIED."""
    found = rows.select(key, F.explode(all_tables(F.col(text))).alias("table"))
    kind = F.when(is_technical(F.col("table")), "TECHNICAL").when(is_business(F.col("table")), "BUSINESS").otherwise("UNCLASSIFIED")
    return found.withColumn("class", kind)


def lineage_search(corpus: DataFrame, key: str, text: str, reached: DataFrame) -> DataFrame:
    """(key, table) of texts that name a table of a column walk (node: schema.table.column), qualified or not.

    Texts are cut into words, so the join is one of equal words and not of every text with every name.
    """
    table = F.upper(F.substring_index("node", ".", 2))
    names_ = reached.select(table.alias("table"), F.substring_index(table, ".", -1).alias("word")).distinct()
    words = corpus.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"(\w+)"), F.lit(1)))).alias("word"))
    return words.join(names_, "word").select(key, "table").distinct()


def send_search(rows: DataFrame, key: str, fields: str, targets: list[str]) -> DataFrame:
    """(key, target, n_fields) of send descriptors 'target,f1,f2' whose target is one of some, as names compare."""
    wanted = [normalize_table_name(F.lit(t)) for t in targets]
    found = rows.select(key, normalize_table_name(F.substring_index(fields, ",", 1)).alias("target"), (F.size(F.split(fields, ",")) - 1).cast("long").alias("n_fields"))
    return found.where(F.col("target").isin(*wanted)).orderBy("target", key)


def keyword_hits(rows: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """Q8: (key, word): words of a fixed dictionary that occur, whatever the case."""
    u = F.upper(F.col(text))
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(F.contains(u, F.lit(w.upper())), F.lit(w)) for w in words]))).alias("word"))


def distinct_issues(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Q9: one row for each normalized key."""
    shape = lambda c: F.upper(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " ")))
    return issues.select(*[shape(c).alias(c) for c in keys]).distinct()


def chain_summary(plans: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Q11: a left-join chain of (name, table(key, value)) from each plan, with the names of steps that found nothing."""
    out = plans.withColumn("at", F.col("plan"))
    for name, table in steps:
        out = out.join(table.select(F.col("key").alias("at"), F.col("value").alias(name)), "at", "left").withColumn("at", F.coalesce(F.col(name), F.col("at")))
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n, _ in steps]))
    return out.select("plan", *[n for n, _ in steps], F.array_join(missing, ",").alias("missing"))


def search(corpus: DataFrame, key: str, text: str, tokens: list[str], label: Column, squeeze: bool = False, exclude: Column | None = None) -> DataFrame:
    """(key, label) of rows that hold every token, without excluded rows, once each."""
    hit = corpus.where(search_tokens(F.col(text), tokens, squeeze))
    if exclude is not None:
        hit = hit.where(~exclude)
    return hit.select(F.col(key).cast("string").alias("name"), label.alias("label")).distinct()


def keyword_groups(lines: DataFrame, text: str) -> DataFrame:
    """P5: of each line the sorted distinct keywords, divided by commas or @#@."""
    words = F.filter(F.transform(F.split(F.col(text), ",|@#@"), lambda w: F.trim(w)), lambda w: w != "")
    return lines.withColumn("keywords", F.array_join(F.array_sort(F.array_distinct(words)), ","))


def has_downstream(rows: DataFrame, key: str, used: DataFrame, used_key: str) -> DataFrame:
    """P6."""
    hit = used.select(F.col(used_key).alias(key)).distinct().withColumn("__hit", F.lit(True))
    return rows.select(key).join(hit, key, "left").select(key, F.coalesce("__hit", F.lit(False)).alias("has_downstream"))
