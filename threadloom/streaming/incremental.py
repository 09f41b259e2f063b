"""Incremental snapshots on a stream: each micro-batch of program sources runs a partial plan and moves the states on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.snapshot import IDENTITY, incremental_plan, next_states
from threadloom.sources.store import SnapshotStore


def apply_batch(store: SnapshotStore, current: DataFrame, version: str, moment: str, batch_id: str) -> DataFrame:
    """Plans current (identity, hash) against the active states, publishes the next states, and returns the plan.

    A micro-batch is never a complete snapshot, so nothing is deleted. Running one batch_id twice changes nothing.
    """
    spark = current.sparkSession
    latest = current.groupBy(*IDENTITY).agg(F.max(F.struct("observed_at", "hash")).alias("x")).select(*IDENTITY, "x.hash")
    if store.active() is None:
        previous = spark.createDataFrame([], ", ".join(f"{c} string" for c in [*IDENTITY, "hash", "version"]) + ", first_seen timestamp, last_seen timestamp, last_changed timestamp")
    else:
        previous = store.read("states").drop("batch_id")
    plan = incremental_plan(latest, previous, version, complete=False)
    if store.active() != batch_id:
        states = next_states(plan, latest, previous, version, F.lit(moment).cast("timestamp"))
        store.publish({"states": states}, {"states": IDENTITY}, batch_id)
    return plan


def start(stream: DataFrame, root: str, checkpoint: str, version: str):
    """A query that keeps the states of a stream (identity, hash, observed_at) in a snapshot store."""

    def each(batch: DataFrame, epoch: int) -> None:
        moment = batch.agg(F.max("observed_at").cast("string")).first()[0]
        if moment is not None:
            apply_batch(SnapshotStore(batch.sparkSession, root), batch, version, moment, f"epoch{epoch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
