"""Shared helpers: table access, the shared scratch folder and file access from tasks."""

from __future__ import annotations

import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@functools.cache
def _test_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, from spark.checkpoint.dir; a local one only without a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = _test_folder()
    return folder.rstrip("/")


@functools.cache
def _session_folder(shared: str, app: str) -> str:
    """This application's folder for intermediate tables; Hadoop's shutdown hook removes it at the end of the session."""
    from pyspark import SparkContext

    sc, folder = SparkContext._active_spark_context, f"{shared}/threadloom/{app}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, which lives as long as the session."""
    return f"{_session_folder(shared_dir(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Hadoop's names of file systems that Arrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_fs(uri: str):
    """(file system, path) for a URI, usable inside tasks: file:, hdfs:, s3a:, gs:, abfss: and whatever fsspec knows."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.replace("file:", "file://", 1)
    scheme, mark, rest = uri.partition("://")
    if mark:
        uri = f"{_SCHEMES.get(scheme, scheme)}://{rest}"
    elif uri.startswith("dbfs:/"):
        uri = "/dbfs" + uri[5:]
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        return fs.FileSystem.from_uri(f"fsspec+{uri}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that df doesn't use, in any case of letters."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"__{name}"
        while new.lower() in used:
            new = f"_{new}"
        used.add(new.lower())
        out.append(new)
    return out


def column(name: str) -> Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(df: DataFrame, names: list[str], **added: str) -> StructType:
    """The schema of some columns of df and of added ones, as mapInArrow wants it."""
    known = {f.name: f for f in df.schema.fields}
    out = StructType([known[n] for n in names])
    for name, kind in added.items():
        out.add(name, DataType.fromDDL(kind))
    return out


def mapped(df: DataFrame, schema: StructType, f, *args) -> DataFrame:
    """mapInArrow by f(*args, names of the columns that it returns, batches), for columns of any names: inside they are numbered."""
    inner = StructType([StructField(f"c{k}", x.dataType) for k, x in enumerate(schema.fields)])
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(functools.partial(lean, f, *args, inner.names), inner).toDF(*schema.names)


def bounded(df: DataFrame, row_bytes: int, most_mb: int = 8) -> DataFrame:
    """df, marked for broadcast only where its counted rows are few enough. df must be cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= most_mb << 20 else df


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, row_bytes: int, how: str = "inner", least: int = 100_000) -> DataFrame:
    """left joined with a stored table `right`, whose rows say how many rows of left hold their key.

    A right side of counted, few rows is broadcast. Otherwise keys of more than `least` rows (at most 10,000 such
    keys, as the bound grows with the table) are dealt to several tasks, and right's rows to each of them.
    """
    n, total = right.agg(F.count(F.lit(1)), F.sum(count)).first()
    if n * row_bytes <= 8 << 20:
        return left.join(F.broadcast(right.drop(count)), key, how)
    share = max(least, int(total or 0) // 10_000)
    parts = F.ceil(F.col(count) / share)
    hot = right.where(F.col(count) > share).select(key, parts.alias("__parts")).dropDuplicates([key])
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(*left.columns), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    spread = right.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop(count)
    return dealt.join(spread, [key, "__part"], how).drop("__part")


def lean(f, *args):
    """f's batches, then the worker's unused memory is given back: workers outlive their tasks and share a machine."""
    import ctypes

    yield from f(*args)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
