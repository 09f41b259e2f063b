"""Audit detectors over program graphs.

Edges are (program, src, dst); each detector gives (program, issue_type, node). Severity and manual
dispositions come by joins with small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.names import is_business, is_technical, stable_key
from threadloom.operators.graph import levels, sinks, strong_components_by

#: Severity by issue type.
SEVERITY = {
    "TARGET_NOT_FOUND": "HIGH",
    "TARGET_MISMATCH": "HIGH",
    "CYCLE_DETECTED": "HIGH",
    "SELF_REFERENCE": "HIGH",
    "ORPHAN_BRANCH": "MEDIUM",
    "LINEAGE_BRANCH_BROKEN": "HIGH",
    "MULTI_SINK_CANDIDATE": "MEDIUM",
    "STATIC_EMPTY_QUERY": "MEDIUM",
    "UNCLASSIFIED_FORMAL_SOURCE": "MEDIUM",
    "UNCLASSIFIED_FORMAL_SINK": "MEDIUM",
    "DYNAMIC_WRITE_TARGET_UNRESOLVED": "MEDIUM",
}


def _keyed(edges: DataFrame) -> DataFrame:
    """Programs side by side in one graph: nodes are (program, name)."""
    node = lambda c: F.struct("program", F.col(c).alias("name"))
    return edges.select(node("src").alias("src"), node("dst").alias("dst"))


def _issue(rows: DataFrame, kind: str, node: str = "node") -> DataFrame:
    return rows.select("program", F.lit(kind).alias("issue_type"), F.col(node).alias("node")).distinct()


def self_references(edges: DataFrame) -> DataFrame:
    """K3."""
    return _issue(edges.where("src = dst"), "SELF_REFERENCE", "src")


def cycles(edges: DataFrame) -> DataFrame:
    """K4: an issue for each component, named by its least member."""
    return _issue(strong_components_by(edges, "program"), "CYCLE_DETECTED", "component")


def multi_sinks(edges: DataFrame) -> DataFrame:
    """K5: programs with several sinks of which not all are technical."""
    found = sinks(edges).withColumn("technical", is_technical(F.col("sink")))
    many = found.groupBy("program").agg(F.count(F.lit(1)).alias("n"), F.min("technical").alias("all_technical")).where("n > 1 and not all_technical")
    return _issue(found.join(many, "program"), "MULTI_SINK_CANDIDATE", "sink")


def target_problems(edges: DataFrame, expected: DataFrame, dynamic: DataFrame) -> DataFrame:
    """K6: an expected target (program, target) that nothing writes: MISMATCH if there is a business sink, else NOT_FOUND."""
    lost = expected.join(edges.select("program", F.col("dst").alias("target")), ["program", "target"], "left_anti").join(dynamic.select("program"), "program", "left_anti")
    business = sinks(edges).where(is_business(F.col("sink"))).select("program").distinct().withColumn("__b", F.lit(True))
    kind = F.when(F.col("__b"), "TARGET_MISMATCH").otherwise("TARGET_NOT_FOUND")
    return lost.join(business, "program", "left").select("program", kind.alias("issue_type"), F.col("target").alias("node"))


def orphan_branches(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """K7: sinks outside the ancestors of an expected target that is written."""
    written = expected.join(edges.select("program", F.col("dst").alias("target")), ["program", "target"], "left_semi")
    starts = written.select(F.struct("program", F.col("target").alias("name")).alias("start"))
    up = levels(_keyed(edges), starts, "up").select(F.col("node.program").alias("program"), F.col("node.name").alias("sink"))
    out = sinks(edges).join(written.select("program"), "program", "left_semi").join(up, ["program", "sink"], "left_anti")
    return _issue(out, "ORPHAN_BRANCH", "sink")


def broken_branches(current: DataFrame, valid_before: DataFrame, broken_before: DataFrame) -> DataFrame:
    """K9: orphans whose sink was a valid target before, or was broken already."""
    seen = valid_before.select("program", "node").union(broken_before.select("program", "node"))
    return _issue(current.join(seen, ["program", "node"], "left_semi"), "LINEAGE_BRANCH_BROKEN")


def select_target(candidates: DataFrame) -> DataFrame:
    """(program, target, choice) of candidates (program, target, authoritative, matches)."""
    grouped = candidates.groupBy("program").agg(
        F.min(F.when(F.col("authoritative"), F.col("target"))).alias("sure"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("matches").alias("hits"),
        F.min(F.when(F.col("matches"), F.col("target"))).alias("hint"),
    )
    unique = (F.col("n") > 1) & (F.col("hits") == 1)
    choice = F.when(F.col("sure").isNotNull(), "AUTHORITATIVE").when(unique, "UNIQUE_HINT").otherwise("NONE")
    return grouped.select("program", F.when(F.col("sure").isNotNull(), F.col("sure")).when(unique, F.col("hint")).alias("target"), choice.alias("choice"))


def with_policy(issues: DataFrame, manual: DataFrame) -> DataFrame:
    """Severity, stable key (I10) and disposition; manual (stable_key, disposition) verdicts win."""
    severity = F.element_at(F.create_map(*[F.lit(v) for kv in SEVERITY.items() for v in kv]), F.col("issue_type"))
    keyed = issues.withColumn("severity", severity).withColumn("stable_key", stable_key("program", "issue_type", "node"))
    kept = manual.where(F.col("disposition").isin("ACCEPTED", "FALSE_POSITIVE")).select("stable_key", F.col("disposition").alias("__d"))
    return keyed.join(kept, "stable_key", "left").withColumn("disposition", F.coalesce("__d", F.lit("OPEN"))).drop("__d")


#: Issues that belong to a branch, to a node or to a cycle; all others belong to their program.
SCOPES = {
    "ORPHAN_BRANCH": "branch",
    "LINEAGE_BRANCH_BROKEN": "branch",
    "SELF_REFERENCE": "node",
    "STATIC_EMPTY_QUERY": "node",
    "UNCLASSIFIED_FORMAL_SOURCE": "node",
    "UNCLASSIFIED_FORMAL_SINK": "node",
    "DYNAMIC_WRITE_TARGET_UNRESOLVED": "node",
    "CYCLE_DETECTED": "cycle",
}


def issue_key(environment: Column, profile: Column, program: Column, issue_type: Column, node: Column | None = None, branch: Column | None = None, cycle: Column | None = None) -> Column:
    """The SHA-256 of an issue's identity as JSON with sorted keys.

    A branch's issue is told apart by its sink, a node's by its key, a cycle's by the set of its nodes in any order and number; whatever else is given
    isn't part of the identity.
    """
    scope = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in SCOPES.items() for v in kv]), issue_type), F.lit("program"))
    fields = {"environment": environment, "issue_type": issue_type, "program_name": program, "scope": scope, "source_profile": profile}
    own = {"branch": ("branch_sink", branch), "node": ("node_key", node), "cycle": ("cycle_nodes", None if cycle is None else F.array_sort(F.array_distinct(cycle)))}

    def of(kind: str | None) -> Column:
        all_ = dict(fields)
        if kind:
            name, value = own[kind]
            all_[name] = F.lit(None).cast("array<string>" if kind == "cycle" else "string") if value is None else value
        return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(all_.items())]), {"ignoreNullFields": "false"})

    return F.sha2(F.coalesce(*[F.when(scope == k, of(k)) for k in own], of(None)), 256)
