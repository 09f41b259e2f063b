"""Table access and the cutting of long lineages."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where store() has put tables that are still in use.
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@functools.cache
def _session_folder(shared: str, app: str) -> str:
    """This application's folder; Hadoop's shutdown hook removes it at the end of the session."""
    sc = SparkContext._active_spark_context
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared}/threadloom/{app}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{shared}/threadloom/{app}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir), for this session; a local one without a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = _local_folder()
    return f"{_session_folder(folder.rstrip('/'), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def bounded(df: DataFrame, row_bytes: int = 100, most_mb: int = 8) -> DataFrame:
    """df, marked for broadcast only where its counted rows are few enough. df must be cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= most_mb << 20 else df


def store(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back, so that loops keep short plans and survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the table that store() wrote for df, once nothing reads it any more; other DataFrames are left alone."""
    if (path := _stored.pop(df, None)) is not None:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
