"""Two-source reconciliation: what SQL does against what schedules say."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.names import TECHNICAL_SCHEMAS, comparison_name, parse_program_name

KEY = ["environment", "target", "source"]


def projection(edges: DataFrame, provenance: str) -> DataFrame:
    """Facts and distinct non-empty provenances of each key."""
    return edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("facts"), F.countDistinct(F.nullif(F.col(provenance), F.lit(""))).alias("provenances"))


def normalized(edges: DataFrame) -> DataFrame:
    """Names as they compare; rows with a technical or unqualified end go. No row moves."""
    out = edges.withColumns({c: comparison_name(F.col(c)) for c in ("target", "source")})
    business = lambda c: ~F.substring_index(c, ".", 1).isin(*TECHNICAL_SCHEMAS)  # noqa: E731  NULL names go too
    return out.where(business("target") & business("source"))


def reconcile(sql_side: DataFrame, schedule_side: DataFrame) -> DataFrame:
    """M1, M2: both sides' projections full-joined; status MATCH, SQL_ONLY or SCHEDULE_ONLY."""
    a = sql_side.select(*KEY, F.col("facts").alias("sql_facts"), F.col("provenances").alias("programs"))
    b = schedule_side.select(*KEY, F.col("facts").alias("schedule_facts"), F.col("provenances").alias("processes"))
    status = F.when(F.col("sql_facts").isNull(), "SCHEDULE_ONLY").when(F.col("schedule_facts").isNull(), "SQL_ONLY").otherwise("MATCH")
    return a.join(b, KEY, "full").withColumn("status", status).na.fill(0, ["sql_facts", "programs", "schedule_facts", "processes"])


def summarize(rows: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Counts of each target; requested targets (a column `target`) without rows are kept with zeros."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = rows.groupBy("target").agg(
        count("MATCH").alias("matches"),
        count("SQL_ONLY").alias("sql_only"),
        count("SCHEDULE_ONLY").alias("schedule_only"),
        count("SUPPRESSED").alias("suppressed"),
        F.countDistinct(F.when(F.col("status") != "SCHEDULE_ONLY", F.col("source"))).alias("sql_sources"),
        F.countDistinct(F.when(F.col("status").isin("MATCH", "SCHEDULE_ONLY"), F.col("source"))).alias("schedule_sources"),
    )
    if requested is not None:
        out = requested.select("target").distinct().join(out, "target", "left").na.fill(0)
    return out.withColumn("consistent", (F.col("sql_only") == 0) & (F.col("schedule_only") == 0))


def active_inventory(states: DataFrame, active_batch: str) -> DataFrame:
    """M4: (target) that programs of the active batch declare, from states (batch_id, program).

    Names that don't follow the grammar give a row of NULL, so that who asks can't take the inventory for whole.
    """
    parsed = states.where(F.col("batch_id") == active_batch).select(parse_program_name(F.col("program")).alias("p"))
    return parsed.select("p.target").distinct()


def visible(rows: DataFrame, status: str | None = None, hide_suppressed: bool = False, hide_self: bool = False) -> DataFrame:
    """Rows of display() without what the options hide."""
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if hide_suppressed:
        rows = rows.where("kind <> 'SUPPRESSED'")
    return rows.where("kind <> 'SELF'") if hide_self else rows


def in_scope(rows: DataFrame, environment: str, profile: str | None = None, targets: list[str] | None = None, programs: list[str] | None = None) -> DataFrame:
    """Rows of an environment and profile whose target is among some, or whose program is; plain filters, so that they reach the files."""
    out = rows.where(F.col("environment") == environment)
    if profile is not None:
        out = out.where(F.col("profile") == profile)
    asked = [F.col(c).isin(v) for c, v in (("target", targets), ("program", programs)) if v is not None]
    return out.where(functools.reduce(lambda a, b: a | b, asked)) if asked else out


def reconcile_active(sql_edges: DataFrame, schedule_edges: DataFrame, batches: DataFrame, stored: DataFrame, states: DataFrame, version: str) -> DataFrame:
    """M8: the active batches of both sides reconciled, with suppressions that were found from just these batches.

    sql_edges and schedule_edges are (batch_id, environment, target, source, program), batches (side, batch_id, is_active). Where an active program's
    name is malformed, nothing is suppressed: its target is unknown.
    """
    active = {r["side"]: r["batch_id"] for r in batches.where("is_active").select("side", "batch_id").collect()}  # a batch a side
    side = lambda edges, s: projection(normalized(edges.where(F.col("batch_id") == active.get(s)).drop("batch_id")), "program")
    rows = reconcile(side(sql_edges, "SQL"), side(schedule_edges, "SCHEDULE"))
    declared = active_inventory(states, active.get("SQL"))
    keys = usable_suppressions(stored, active.get("SQL"), active.get("SCHEDULE"), version).join(declared.where("target is not null").select(F.col("target").alias("source")), "source", "left_anti")
    malformed = declared.where("target is null").agg((F.count(F.lit(1)) > 0).alias("malformed"))
    return apply_suppressions(rows, keys.join(F.broadcast(malformed)).where("not malformed"))  # a flag of one row


def classify_suppressions(rows: DataFrame, active_targets: DataFrame) -> DataFrame:
    """SQL_ONLY keys whose source no active program declares as its target."""
    return rows.where("status = 'SQL_ONLY'").join(active_targets.select(F.col("target").alias("source")), "source", "left_anti").select(*KEY, F.lit("NO_INTERNAL_PROGRAM").alias("reason"))


def usable_suppressions(stored: DataFrame, sql_batch: str, schedule_batch: str, version: str) -> DataFrame:
    """M5: keys found from just these batches by this version, for this status and reason."""
    return stored.where(
        (F.col("sql_batch") == sql_batch) & (F.col("schedule_batch") == schedule_batch) & (F.col("version") == version) & (F.col("raw_status") == "SQL_ONLY") & (F.col("reason") == "NO_INTERNAL_PROGRAM")
    ).select(*KEY).distinct()


def apply_suppressions(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """M6: SQL_ONLY rows of the keys become SUPPRESSED; keys without a row have no effect."""
    marked = rows.join(keys.select(*KEY).distinct().withColumn("__hit", F.lit(True)), KEY, "left")
    return marked.withColumn("status", F.when((F.col("status") == "SQL_ONLY") & F.col("__hit"), "SUPPRESSED").otherwise(F.col("status"))).drop("__hit")


def changed_targets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Targets of the keys that are in one snapshot only."""
    a, b = before.select(*KEY), after.select(*KEY)
    return a.subtract(b).union(b.subtract(a)).select("target").distinct()


def display(rows: DataFrame) -> DataFrame:
    """M9, F2: row kind and an order in which differences come first."""
    kind = F.when(F.col("source") == F.col("target"), "SELF").when(F.col("status") == "SUPPRESSED", "SUPPRESSED").otherwise("NORMAL")
    place = F.when(F.col("status") == "SQL_ONLY", 0).when(F.col("status") == "SCHEDULE_ONLY", 1).when(F.col("status") == "SUPPRESSED", 2).otherwise(3)
    return rows.withColumn("kind", kind).withColumn("place", place).orderBy("place", *KEY)


def table_sets_diff(actual: DataFrame, configured: DataFrame, by: str) -> DataFrame:
    """(by, table, side) with side BOTH, ACTUAL or CONFIGURED."""
    a = actual.select(by, "table").distinct().withColumn("__a", F.lit(True))
    b = configured.select(by, "table").distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__a").isNull(), "CONFIGURED").when(F.col("__b").isNull(), "ACTUAL").otherwise("BOTH")
    return a.join(b, [by, "table"], "full").select(by, "table", side.alias("side"))
