"""Snapshots: incremental plans, lifecycles, diffs, validation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SCOPE = ["environment", "profile"]
IDENTITY = [*SCOPE, "program"]


def incremental_plan(current: DataFrame, previous: DataFrame, version: str, complete: bool, scopes: DataFrame | None = None) -> DataFrame:
    """L1: (identity, action): NEW, UNCHANGED, CHANGED or DELETED.

    current is (identity, hash), previous (identity, hash, version). UNCHANGED needs a hash, equal, and the same version.
    Programs that are missing are DELETED only if the snapshot is complete and, with scopes given, in scope.
    """
    c = current.select(*IDENTITY, F.col("hash").alias("now"), F.lit(True).alias("__c"))
    p = previous.select(*IDENTITY, F.col("hash").alias("was"), F.col("version").alias("old"), F.lit(True).alias("__p"))
    action = (
        F.when(F.col("__p").isNull(), "NEW")
        .when(F.col("__c").isNull(), "DELETED")
        .when(F.coalesce((F.col("now") == F.col("was")) & (F.col("old") == version), F.lit(False)), "UNCHANGED")
        .otherwise("CHANGED")
    )
    out = c.join(p, IDENTITY, "full").withColumn("action", action)
    if not complete:
        out = out.where("action <> 'DELETED'")
    elif scopes is not None:
        inside = scopes.select(*SCOPE).distinct().withColumn("__in", F.lit(True))
        out = out.join(inside, SCOPE, "left").where("action <> 'DELETED' or __in")
    return out.select(*IDENTITY, "action")


def stale_versions(previous: DataFrame, version: str, scopes: DataFrame) -> DataFrame:
    """L2: scopes with a program of another version that a migration doesn't select; it must find none."""
    return previous.where(~F.col("version").eqNullSafe(F.lit(version))).select(*SCOPE).distinct().join(scopes.select(*SCOPE), SCOPE, "left_anti")


def migration_gate(previous: DataFrame, version: str, scopes: DataFrame, complete: bool, partial: bool = False) -> None:
    """L2: refuses a run over states of another pipeline version, unless it is a complete snapshot, no partial replay, and selects each stale scope."""
    if previous.where(~F.col("version").eqNullSafe(F.lit(version))).isEmpty():
        return
    if not complete or partial:
        raise ValueError(f"states of another version than {version} need a complete snapshot")
    if left := stale_versions(previous, version, scopes).first():
        raise ValueError(f"a scope of another version isn't selected: {left.asDict()}")


def next_states(plan: DataFrame, current: DataFrame, previous: DataFrame, version: str, now: Column) -> DataFrame:
    """States after a run. first_seen stays; last_changed moves for NEW and CHANGED; what the plan doesn't name is carried over."""
    p = previous.select(*IDENTITY, F.col("hash").alias("was"), F.col("version").alias("old"), "first_seen", "last_seen", "last_changed")
    c = current.select(*IDENTITY, "hash", F.lit(True).alias("__here"))
    joined = p.join(plan, IDENTITY, "full").join(c, IDENTITY, "left").where("action is null or action <> 'DELETED'")
    moved = F.col("action").isin("NEW", "CHANGED")
    return joined.select(
        *IDENTITY,
        F.when(F.col("action").isNull(), F.col("was")).otherwise(F.col("hash")).alias("hash"),
        F.when(F.col("action").isNull(), F.col("old")).otherwise(F.lit(version)).alias("version"),
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(F.col("action").isNull(), F.col("last_seen")).otherwise(now).alias("last_seen"),
        F.when(moved, now).otherwise(F.coalesce("last_changed", now)).alias("last_changed"),
    )


def issue_lifecycle(current: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """L4: (stable_key, state, first_seen, last_seen, age_days, disposition): NEW, PERSISTING or RESOLVED.

    Manual dispositions (ACCEPTED, FALSE_POSITIVE) stay; a resolved issue comes back as PERSISTING only if still active.
    """
    c = current.select("stable_key", F.lit(True).alias("__c"))
    p = previous.select("stable_key", "first_seen", F.col("last_seen").alias("__last"), F.col("disposition").alias("__d"), F.lit(True).alias("__p"))
    state = F.when(F.col("__p").isNull(), "NEW").when(F.col("__c").isNull(), "RESOLVED").otherwise("PERSISTING")
    out = c.join(p, "stable_key", "full").withColumn("state", state)
    first = F.coalesce("first_seen", now)
    last = F.when(F.col("state") == "RESOLVED", F.col("__last")).otherwise(now)
    kept = F.col("__d").isin("ACCEPTED", "FALSE_POSITIVE")
    return out.select(
        "stable_key",
        "state",
        first.alias("first_seen"),
        last.alias("last_seen"),
        F.datediff(last, first).cast("long").alias("age_days"),
        F.when(kept, F.col("__d")).when(F.col("state") == "RESOLVED", "RESOLVED").otherwise(F.coalesce("__d", F.lit("OPEN"))).alias("disposition"),
    )


def merge_override(retained: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Retained rows of keys that fresh doesn't have, and all fresh rows."""
    return retained.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def batch_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct rows with change ADDED, REMOVED or UNCHANGED."""
    tag = lambda df, what: df.withColumn("change", F.lit(what))
    return tag(after.subtract(before), "ADDED").unionByName(tag(before.subtract(after), "REMOVED")).unionByName(tag(before.intersect(after), "UNCHANGED"))


def environment_diff(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(source, target, presence) of two environments."""
    side = lambda e, c: edges.where(F.col("environment") == e).select("source", "target").distinct().withColumn(c, F.lit(True))
    both = side(a, "__a").join(side(b, "__b"), ["source", "target"], "full")
    presence = F.when(F.col("__b").isNull(), f"ONLY_{a.upper()}").when(F.col("__a").isNull(), f"ONLY_{b.upper()}").otherwise("COMMON")
    return both.select("source", "target", presence.alias("presence"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).count().where("count > 1").withColumnRenamed("count", "n")


def orphans(rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no parent."""
    return rows.join(parents.select(*keys), keys, "left_anti")


def activate(candidate: DataFrame) -> DataFrame:
    """Rows of a new batch become active, resolved ones don't."""
    return candidate.withColumn("is_active", ~F.col("disposition").eqNullSafe(F.lit("RESOLVED")))


def history(batches: DataFrame, facts: DataFrame) -> DataFrame:
    """Batches, newest first, with their row counts."""
    counts = facts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return batches.join(counts, "batch_id", "left").na.fill(0, ["n_rows"]).orderBy(F.desc("created_at"), "batch_id")


def set_disposition(issues: DataFrame, batch_id: str, stable_key: str, disposition: str) -> DataFrame:
    """Issues with one issue of one batch under a new disposition; all other rows as they were."""
    here = (F.col("batch_id") == batch_id) & (F.col("stable_key") == stable_key)
    return issues.withColumn("disposition", F.when(here, disposition).otherwise(F.col("disposition")))


def merged_edges(edges: DataFrame, most: int = 100) -> DataFrame:
    """One row for each (environment, profile, source, target, program, job): facts, paths summed, the first evidences in order."""
    keys = [*SCOPE, "source", "target", "program", "job"]
    facts = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("facts"), F.sum("paths").alias("paths"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("evidence"))
    first = edges.where("evidence is not null").select(*keys, "evidence").distinct().withColumn("k", rank).where(F.col("k") <= most)
    texts = first.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("evidence")), ",").alias("evidence"))
    same = functools.reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return facts.alias("a").join(texts.alias("b"), same, "left").select(*[f"a.{k}" for k in keys], "facts", "paths", "b.evidence")


def failure_reason(has_source: Column, parsed: Column, has_target: Column, has_edges: Column) -> Column:
    """The first reason that applies, NULL where there is none."""
    return F.when(~has_source, "NO_SOURCE").when(~parsed, "PARSE_FAILED").when(~has_target, "NO_TARGET").when(~has_edges, "NO_EDGES")
