"""Readers of programs, schedules, metadata and files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.names import canonical_name, source_hash
from threadloom.operators.reconcile import KEY

#: Encodings that texts are tried in, in this order.
ENCODINGS = ("utf-8", "gbk", "latin-1")


def program_sources(rows: DataFrame, environment: str, profile: str, name: str, code: str, target: str | None = None) -> DataFrame:
    """A1, A2: registry rows with code as program sources with their hashes; rows without a name or code go."""
    expected = canonical_name(F.col(target)) if target else F.lit(None).cast("string")
    out = rows.where(F.col(name).isNotNull() & F.col(code).isNotNull()).select(
        F.lit(environment).alias("environment"), F.lit(profile).alias("source_profile"), F.trim(F.col(name)).alias("program_name"), F.col(code).alias("script_code"), expected.alias("expected_target")
    )
    fields = {c: F.col(c) for c in out.columns}
    return out.withColumn("source_hash", source_hash(fields))


def jdbc_sources(spark: SparkSession, url: str, query: str, properties: dict[str, str], fetch_size: int = 1000, key: str | None = None, partitions: int | None = None) -> DataFrame:
    """A1, A12 against a database: the query runs there, rows come in batches, filters on the result go to the server.

    With a key (a number, date or timestamp of the query) the rows are read by `partitions` tasks, each a range of equal width
    between the least and the largest key, which the server is asked for first; rows without a key come with the first range. Without one, or
    for a result without keys, one task reads all.
    """
    source = spark.read.format("jdbc").options(url=url, fetchsize=str(fetch_size), **properties)
    text = query if query.lstrip().startswith("(") else f"({query}) q"
    if key is None:
        return source.option("dbtable", text).load()
    low, high = source.option("query", f"select min({key}) as low, max({key}) as high from {text}").load().first()
    source = spark.read.format("jdbc").options(url=url, fetchsize=str(fetch_size), **properties).option("dbtable", text)
    if low is None:
        return source.load()
    count = partitions or spark.sparkContext.defaultParallelism
    return source.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(count)).load()


def parameterized(spark: SparkSession, text: str, args: dict) -> DataFrame:
    """A12 on Spark tables."""
    return spark.sql(text, args=args)


def decoded(content: Column) -> Column:
    """Bytes as text in the first encoding that fits; latin-1 fits always."""

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        def one(data):
            for name in ENCODINGS if data is not None else ():
                try:
                    return data.decode(name)
                except UnicodeDecodeError:
                    continue
            return None

        return batch.map(one)

    return decode(content)


def classify_path(path: Column) -> tuple[Column, Column, Column]:
    """A4: (layer, target, reason) of PROJECT/1.0/DWS_X/DWS_X.TABLE/file.py; layer and target are NULL with a reason."""
    p = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda c: c != "")
    folder, file = F.try_element_at(p, F.lit(-2)), F.try_element_at(p, F.lit(-1))
    layer, table = F.substring_index(folder, ".", 1), F.substring_index(folder, ".", -1)
    reason = (
        F.when(~F.endswith(F.lower(file), F.lit(".py")), "NOT_A_PROGRAM")
        .when(F.size(p) < 4, "TOO_SHALLOW")
        .when(~folder.rlike(r"^DWS_[A-Z]+\.[A-Za-z0-9_]+$"), "FOLDER_NAME")
        .when(F.try_element_at(p, F.lit(-3)) != layer, "LAYER_MISMATCH")
    )
    ok = reason.isNull()
    plain = F.regexp_replace(layer, "^DWS_", "")
    return F.when(ok, plain), F.when(ok, F.concat(plain, F.lit("."), F.upper(table))), reason


def scan_working_copy(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root: path, size, layer, target, reason and decoded text of programs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    layer, target, reason = classify_path(F.col("path"))
    out = files.select("path", "length", "content", layer.alias("layer"), target.alias("target"), reason.alias("reason"))
    return out.withColumn("text", F.when(F.col("reason").isNull(), decoded(F.col("content")))).drop("content")


def inventory(files: DataFrame) -> DataFrame:
    """A5: per layer files and targets, with status COMPLETE if every file was placed."""
    return files.groupBy("layer").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("target").alias("targets"), F.count_if(F.col("reason").isNotNull()).alias("rejected")).withColumn(
        "status", F.when(F.col("rejected") == 0, "COMPLETE").otherwise("PARTIAL")
    )


def schedule_scope(project: Column, target: Column, projects: list[str], prefixed: list[tuple[str, str]]) -> Column:
    """C4: project in the list, or (project, prefix of the target) in the pairs."""
    out = project.isin(*projects) if projects else F.lit(False)
    for p, prefix in prefixed:
        out = out | ((project == p) & F.startswith(target, F.lit(prefix)))
    return out


def schedule_edges(rows: DataFrame, environment: str, scope: Column) -> tuple[DataFrame, DataFrame]:
    """(edges, counters): rows in scope with both names qualified, once each; and why others were rejected."""
    named = rows.select(F.lit(environment).alias("environment"), "process_name", canonical_name(F.col("target_table")).alias("target"), canonical_name(F.col("source_table")).alias("source"), F.coalesce(scope, F.lit(False)).alias("__in"))
    reason = F.when(~F.col("__in"), "OUT_OF_SCOPE").when(F.col("target").isNull(), "TARGET").when(F.col("source").isNull(), "SOURCE")
    judged = named.withColumn("reason", reason)
    good = judged.where("reason is null").groupBy(*KEY).agg(F.min("process_name").alias("process_name"))
    return good, judged.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def json_snapshot(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """JSON with a fixed schema; malformed files and missing required fields are errors."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    for c in required:
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is missing"))))
    return rows


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def two_columns(spark: SparkSession, path: str, names: tuple[str, str]) -> DataFrame:
    """Lines split at their first comma only."""
    parts = F.split("value", ",", 2)
    return spark.read.text(path).select(F.trim(parts[0]).alias(names[0]), F.trim(F.try_element_at(parts, F.lit(2))).alias(names[1]))


def headerless_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A11."""
    return spark.read.schema(schema).csv(path)


def spreadsheet(spark: SparkSession, path: str, wanted: dict[str, str], header_rows: int = 6) -> DataFrame:
    """A sheet whose header is among the first rows; rows that miss a wanted column go. Needs pandas' Excel reader."""
    raw = pd.read_excel(path, header=None, dtype=str)
    at = next((k for k in range(min(header_rows, len(raw))) if set(wanted) <= {str(v).strip() for v in raw.iloc[k]}), None)
    if at is None:
        raise ValueError(f"{path} has no header with {sorted(wanted)}")
    names = [str(v).strip() for v in raw.iloc[at]]
    body = raw.iloc[at + 1 :].set_axis(names, axis=1)[list(wanted)].rename(columns=wanted).dropna()
    return spark.createDataFrame(body, ", ".join(f"{c} string" for c in wanted.values()))


def active_rows(facts: DataFrame, batches: DataFrame) -> DataFrame:
    """The active batch's rows; an active batch without rows gives one row of nulls, none without an active batch."""
    active = batches.where("is_active").select("batch_id")
    return active.join(facts, "batch_id", "left")
