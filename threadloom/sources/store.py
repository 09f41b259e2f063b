"""A snapshot store on plain files (B1-B7): batches as partitions, and a pointer that names the active one.

A batch is written and validated under its own path first. Then a small pointer file, written under a temporary
name and renamed, makes it active; readers follow the pointer, so they see the old batch or the new one, whole.
A failure at any step before the rename leaves the old batch active.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from threadloom.functions.tables import bounded, store


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        where = self._path(f"{self.root}/active")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def active(self) -> str | None:
        """The active batch: the pointer of the highest number."""
        done = [p for p in self._pointers() if not p.startswith("_")]
        return done[-1].split("-", 1)[1] if done else None

    def publish(self, tables: dict[str, DataFrame], keys: dict[str, list[str]], batch_id: str | None = None) -> str:
        """Writes the tables as one batch, checks that keys are unique and not null, then switches to it."""
        batch_id = batch_id or uuid.uuid4().hex
        for name, df in tables.items():
            path = f"{self.root}/{name}/batch_id={batch_id}"
            df.write.mode("errorifexists").parquet(path)
            back = self.spark.read.parquet(path)
            by = keys.get(name, [])
            if by:
                bad = back.groupBy(*by).count().where(F.col("count") > 1).select(F.lit("repeated").alias("why"))
                empty = back.where(" or ".join(f"`{k}` is null" for k in by)).select(F.lit("null").alias("why"))
                if problem := bad.union(empty).first():
                    raise ValueError(f"{name}: a {problem['why']} key among {by}")
        self._switch(batch_id)
        return batch_id

    def _switch(self, batch_id: str) -> None:
        done = [p for p in self._pointers() if not p.startswith("_")]
        number = int(done[-1].split("-", 1)[0]) + 1 if done else 1
        final = self._path(f"{self.root}/active/{number:09d}-{batch_id}")
        temporary = self._path(f"{self.root}/active/_{uuid.uuid4().hex}")
        self._fs.create(temporary).close()
        if not self._fs.rename(temporary, final):
            raise OSError("another publisher was first")

    def read(self, name: str, batch_id: str | None = None) -> DataFrame:
        """A table of the active batch (A15). Without an active batch this is an error, unlike an empty batch."""
        batch = batch_id or self.active()
        if batch is None:
            raise LookupError("no active batch")
        return self.spark.read.parquet(f"{self.root}/{name}/batch_id={batch}").withColumn("batch_id", F.lit(batch))

    def carried_over(self, name: str, incoming: DataFrame, keys: list[str], scopes: DataFrame, scope_keys: list[str], complete: bool) -> DataFrame:
        """Incoming rows and the active batch's others. An old row goes only if the snapshot is complete and its scope declared."""
        if self.active() is None:
            return incoming
        old = self.read(name).drop("batch_id").join(incoming.select(*keys), keys, "left_anti")
        if complete:
            old = old.join(scopes.select(*scope_keys).distinct(), scope_keys, "left_anti")
        return old.unionByName(incoming)


class SuppressionStore:
    """Suppressions by scope, one partition each; a publish replaces the state of its own scopes and leaves the others' files alone.

    Rows are (scope columns, row_key, payload columns); `active`, `created_at` and `updated_at` are kept beside them. Nothing is ever deleted:
    what a publish doesn't name is retired, and comes back active when a later one names it again.
    """

    def __init__(self, spark: SparkSession, path: str, scope: list[str], payload: list[str]):
        self.spark, self.path, self.scope, self.payload = spark, path.rstrip("/"), scope, payload

    def _schema(self, rows: DataFrame) -> StructType:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        own = [("row_key", kinds["row_key"]), *((c, kinds[c]) for c in self.payload), ("active", BooleanType()), ("created_at", TimestampType()), ("updated_at", TimestampType())]
        return StructType([StructField(n, k) for n, k in [*own, *((c, kinds[c]) for c in self.scope)]])

    def read(self, active_only: bool = False) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.where("active") if active_only else rows

    def publish(self, rows: DataFrame, scopes: DataFrame, observed_at: str) -> dict[str, int]:
        """Publishes the rows of the declared scopes at a time; returns how many are active, retired by it and were active before.

        Rows outside the declared scopes, null keys and keys that a scope has twice are errors, found before anything is written. A declared scope
        without rows retires all it has. The new state is written in full beside the table before the partitions change.
        """
        keys, at = [*self.scope, "row_key"], F.lit(observed_at).cast("timestamp")
        declared = scopes.select(*self.scope).distinct()
        new = store(rows.select(*keys, *self.payload), "published")
        outside = new.join(declared, self.scope, "left_anti").select(F.lit("a row outside the declared scopes").alias("why"))
        empty = new.where(" or ".join(f"`{k}` is null" for k in keys)).select(F.lit("a null key").alias("why"))
        twice = new.groupBy(*keys).count().where("count > 1").select(F.lit("a repeated key").alias("why"))
        if problem := empty.unionAll(twice).unionAll(outside).first():
            raise ValueError(problem["why"])
        schema = self._schema(rows)
        try:
            old = self.spark.read.schema(schema).parquet(self.path).join(bounded(declared), self.scope, "left_semi")
            old.schema, old.isEmpty()
        except AnalysisException:  # nothing was published yet
            old = self.spark.createDataFrame([], schema)
        was = old.select(*keys, F.struct(*self.payload).alias("was"), F.col("active").alias("was_active"), "created_at", "updated_at")
        now = new.select(*keys, F.struct(*self.payload).alias("now"))
        both = was.join(now, keys, "full")
        named = F.col("now").isNotNull()
        value = F.coalesce("now", "was")
        changed = named | F.coalesce("was_active", F.lit(False))
        state = both.select(
            "row_key",
            *[value[c].alias(c) for c in self.payload],
            named.alias("active"),
            F.coalesce("created_at", at).alias("created_at"),
            F.when(changed, at).otherwise(F.col("updated_at")).alias("updated_at"),
            *self.scope,
            F.coalesce("was_active", F.lit(False)).alias("was_active"),
        )
        state = store(state, "state")
        counts = state.agg(F.count_if("active").alias("active"), F.count_if(F.col("was_active") & ~F.col("active")).alias("retired"), F.count_if("was_active").alias("active_before")).first()
        state.drop("was_active").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.scope).parquet(self.path)
        return counts.asDict()


def rebuild_mapping(rows: DataFrame, name: str, key: str, buckets: int = 64, row_group_bytes: int = 8 << 20) -> None:
    """Writes a lookup table anew: hashed by key into buckets, sorted in them, with a Bloom filter of the keys in each row group.

    A lookup by key reads only row groups whose statistics and filter allow the key, those of one bucket at most; a join on the key doesn't shuffle
    this side. Spark opens only that bucket's file where spark.sql.sources.bucketing.autoBucketedScan.enabled is false; else it also reads the others' footers.
    """
    writer = rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("parquet.bloom.filter.enabled#" + key, "true").option("parquet.block.size", str(row_group_bytes)).saveAsTable(name)


def lookup(spark: SparkSession, name: str, key: str, values: list) -> DataFrame:
    """The rows of some keys, a stated list."""
    return spark.table(name).where(F.col(key).isin(values))


def copy_table(source: DataFrame, spark: SparkSession, target: str) -> None:
    """Replaces a table of the same columns; another schema is an error."""
    if spark.catalog.tableExists(target):
        have = [(f.name, f.dataType) for f in spark.table(target).schema]
        if have != [(f.name, f.dataType) for f in source.schema]:
            raise ValueError(f"{target} has other columns")
    source.write.mode("overwrite").saveAsTable(target)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)
