"""Registered reconciliation and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import reconcile, snapshot
from threadloom.plans.registry import Registry
from threadloom.plans.relations import duck, relation, run

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql

_SIDES = f"""WITH s AS (SELECT environment, replace(upper(target), 'DWS_DWF.', 'DWF.') AS target, replace(upper(source), 'DWS_DWD.', 'DWD.') AS source, program FROM {duck('sql_side')} t WHERE source NOT LIKE 'DLO.%'),
    c AS (SELECT environment, replace(upper(target), 'DWS_DWF.', 'DWF.') AS target, replace(upper(source), 'DWS_DWD.', 'DWD.') AS source, program FROM {duck('sched_side')} t),
    a AS (SELECT environment, target, source, count(*) AS facts, count(DISTINCT nullif(program, '')) AS provenances FROM s GROUP BY ALL),
    b AS (SELECT environment, target, source, count(*) AS facts, count(DISTINCT nullif(program, '')) AS provenances FROM c GROUP BY ALL),
    r AS (SELECT environment, target, source, coalesce(a.facts, 0) AS sql_facts, coalesce(a.provenances, 0) AS programs, coalesce(b.facts, 0) AS schedule_facts, coalesce(b.provenances, 0) AS processes,
      CASE WHEN a.facts IS NULL THEN 'SCHEDULE_ONLY' WHEN b.facts IS NULL THEN 'SQL_ONLY' ELSE 'MATCH' END AS status FROM a FULL JOIN b USING (environment, target, source)),
    active AS (SELECT DISTINCT concat('DWD.S', CAST(s_suppkey AS VARCHAR)) AS target FROM supplier WHERE s_acctbal > 0),
    z AS (SELECT r.* REPLACE (CASE WHEN status = 'SQL_ONLY' AND source NOT IN (SELECT target FROM active) THEN 'SUPPRESSED' ELSE status END AS status) FROM r)"""


def _sides(spark, sf_dir):
    out = []
    for name in ("sql_side", "sched_side"):
        out.append(reconcile.projection(reconcile.normalized(relation(spark, sf_dir, name)), "program"))
    return out


def _rows(spark, sf_dir):
    return reconcile.reconcile(*_sides(spark, sf_dir))


def _active(spark, sf_dir):
    return run(spark, sf_dir, "select distinct concat('DWD.S', cast(s_suppkey as string)) as target from supplier where s_acctbal > 0")


def _suppressed(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return reconcile.apply_suppressions(rows, reconcile.classify_suppressions(rows, _active(spark, sf_dir)))


@query(_SIDES + " SELECT * FROM r")
def reconcile_edges(spark, sf_dir):
    return _rows(spark, sf_dir)


@query(_SIDES + " SELECT environment, target, source, facts, provenances FROM a")
def grouped_projection(spark, sf_dir):
    return _sides(spark, sf_dir)[0]


_SUMMARY = """ SELECT q.target, count(*) FILTER (WHERE status = 'MATCH') AS matches, count(*) FILTER (WHERE status = 'SQL_ONLY') AS sql_only, count(*) FILTER (WHERE status = 'SCHEDULE_ONLY') AS schedule_only,
    count(*) FILTER (WHERE status = 'SUPPRESSED') AS suppressed, count(DISTINCT source) FILTER (WHERE status <> 'SCHEDULE_ONLY') AS sql_sources, count(DISTINCT source) FILTER (WHERE status IN ('MATCH', 'SCHEDULE_ONLY')) AS schedule_sources,
    count(*) FILTER (WHERE status IN ('SQL_ONLY', 'SCHEDULE_ONLY')) = 0 AS consistent FROM (SELECT concat('DWF.P', CAST(p_partkey AS VARCHAR)) AS target FROM part) q LEFT JOIN {0} x ON x.target = q.target GROUP BY q.target"""


def _requested(spark, sf_dir):
    return run(spark, sf_dir, "select concat('DWF.P', cast(p_partkey as string)) as target from part")


@query(_SIDES + _SUMMARY.format("r"))
def reconcile_summary(spark, sf_dir):
    return reconcile.summarize(_rows(spark, sf_dir), _requested(spark, sf_dir))


@query(_SIDES + _SUMMARY.format("z"))
def reconcile_suppressed(spark, sf_dir):
    return reconcile.summarize(_suppressed(spark, sf_dir), _requested(spark, sf_dir))


@query(_SIDES + " SELECT environment, target, source, 'NO_INTERNAL_PROGRAM' AS reason FROM z WHERE status = 'SUPPRESSED'")
def suppression_classes(spark, sf_dir):
    return reconcile.classify_suppressions(_rows(spark, sf_dir), _active(spark, sf_dir))


@query(
    _SIDES
    + """ SELECT *, CASE WHEN source = target THEN 'SELF' WHEN status = 'SUPPRESSED' THEN 'SUPPRESSED' ELSE 'NORMAL' END AS kind,
    CAST(CASE status WHEN 'SQL_ONLY' THEN 0 WHEN 'SCHEDULE_ONLY' THEN 1 WHEN 'SUPPRESSED' THEN 2 ELSE 3 END AS INTEGER) AS place FROM z"""
)
def reconcile_display(spark, sf_dir):
    return reconcile.display(_suppressed(spark, sf_dir))


@query(
    f"""WITH t AS (SELECT DISTINCT environment, target, source, program FROM {duck('sql_side')} t), x AS (SELECT DISTINCT environment, target, source FROM t WHERE program <> 'G7'),
    y AS (SELECT DISTINCT environment, target, source FROM t WHERE program <> 'G6') SELECT DISTINCT target FROM ((SELECT * FROM x EXCEPT SELECT * FROM y) UNION (SELECT * FROM y EXCEPT SELECT * FROM x))"""
)
def changed_targets(spark, sf_dir):
    rows = relation(spark, sf_dir, "sql_side")
    return reconcile.changed_targets(rows.where("program <> 'G7'"), rows.where("program <> 'G6'"))


@query(
    """WITH a AS (SELECT DISTINCT l_suppkey AS program, l_partkey AS tab FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT DISTINCT l_suppkey AS program, l_partkey AS tab FROM lineitem WHERE l_linestatus = 'O')
    SELECT program, tab AS "table", CASE WHEN a.tab IS NULL THEN 'CONFIGURED' WHEN b.tab IS NULL THEN 'ACTUAL' ELSE 'BOTH' END AS side FROM (SELECT *, 1 AS k FROM a) a FULL JOIN (SELECT *, 1 AS k FROM b) b USING (program, tab)""".replace("a.tab IS NULL", "a.k IS NULL").replace("b.tab IS NULL", "b.k IS NULL")
)
def dependency_diff(spark, sf_dir):
    a = run(spark, sf_dir, "select l_suppkey as program, l_partkey as `table` from lineitem where l_returnflag <> 'R'")
    b = run(spark, sf_dir, "select l_suppkey as program, l_partkey as `table` from lineitem where l_linestatus = 'O'")
    return reconcile.table_sets_diff(a, b, "program")


# snapshots: programs are (user, event type); the day before and the day are two batches
_STATES = f"""WITH s AS (SELECT 'PROD' AS environment, event_type AS profile, CAST(user_id AS VARCHAR) AS program, hash, day FROM {duck('states')} t),
    c AS (SELECT * FROM s WHERE day = DATE '2024-01-02'), p AS (SELECT *, CASE WHEN CAST(program AS BIGINT) % 3 = 0 THEN 'v1' ELSE 'v2' END AS version FROM s WHERE day = DATE '2024-01-01'),
    p2 AS (SELECT * REPLACE (CASE WHEN CAST(program AS BIGINT) % 2 = 0 THEN coalesce((SELECT c.hash FROM c WHERE c.profile = p.profile AND c.program = p.program), hash) ELSE hash END AS hash) FROM p),
    plan AS (SELECT environment, profile, program, CASE WHEN p2.version IS NULL THEN 'NEW' WHEN c.day IS NULL THEN 'DELETED' WHEN c.hash = p2.hash AND p2.version = 'v2' THEN 'UNCHANGED' ELSE 'CHANGED' END AS action
      FROM c FULL JOIN p2 USING (environment, profile, program))"""


def _states(spark, sf_dir):
    s = relation(spark, sf_dir, "states").select(F.lit("PROD").alias("environment"), F.col("event_type").alias("profile"), F.col("user_id").cast("string").alias("program"), "hash", "day")
    now = s.where("day = date'2024-01-02'").drop("day")
    before = s.where("day = date'2024-01-01'").drop("day").withColumn("version", F.when(F.col("program").cast("long") % 3 == 0, "v1").otherwise("v2"))
    # every other program is as it was, so that some are unchanged
    same = now.select("profile", "program", F.col("hash").alias("h"))
    before = before.join(same, ["profile", "program"], "left").withColumn("hash", F.when(F.col("program").cast("long") % 2 == 0, F.coalesce("h", "hash")).otherwise(F.col("hash"))).drop("h")
    day = F.lit("2024-01-01").cast("date")
    return now, before.withColumn("first_seen", day).withColumn("last_seen", day).withColumn("last_changed", day)


@query(_STATES + " SELECT * FROM plan")
def incremental_plan(spark, sf_dir):
    now, before = _states(spark, sf_dir)
    return snapshot.incremental_plan(now, before, "v2", complete=True)


@query(_STATES + " SELECT * FROM plan WHERE action <> 'DELETED' OR profile = 'click'")
def incremental_plan_scoped(spark, sf_dir):
    now, before = _states(spark, sf_dir)
    scopes = spark.sql("select 'PROD' as environment, 'click' as profile")
    return snapshot.incremental_plan(now, before, "v2", complete=True, scopes=scopes)


@query(
    _STATES
    + """, q AS (SELECT * FROM plan WHERE action <> 'DELETED')
    SELECT environment, profile, program, CASE WHEN q.action IS NULL THEN p2.hash ELSE c.hash END AS hash, CASE WHEN q.action IS NULL THEN p2.version ELSE 'v2' END AS version,
      CASE WHEN p2.hash IS NULL THEN '2024-01-02' ELSE '2024-01-01' END AS first_seen, CASE WHEN q.action IS NULL THEN '2024-01-01' ELSE '2024-01-02' END AS last_seen,
      CASE WHEN q.action IN ('NEW', 'CHANGED') THEN '2024-01-02' ELSE '2024-01-01' END AS last_changed
    FROM p2 FULL JOIN q USING (environment, profile, program) LEFT JOIN c USING (environment, profile, program)"""
)
def program_states(spark, sf_dir):
    now, before = _states(spark, sf_dir)
    plan = snapshot.incremental_plan(now, before, "v2", complete=False)
    states = snapshot.next_states(plan, now, before, "v2", F.lit("2024-01-02").cast("date"))
    return states.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen", "last_changed")})


@query(
    f"""WITH s AS (SELECT DISTINCT sha256(concat_ws(chr(31), CAST(user_id AS VARCHAR), event_type)) AS stable_key, user_id, day FROM {duck('states')} t),
    p AS (SELECT stable_key, CASE user_id % 4 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'FALSE_POSITIVE' ELSE 'OPEN' END AS d FROM s WHERE day = DATE '2024-01-05'), c AS (SELECT stable_key, 1 AS k FROM s WHERE day = DATE '2024-01-09'),
    j AS (SELECT stable_key, d, k, CASE WHEN d IS NULL THEN 'NEW' WHEN k IS NULL THEN 'RESOLVED' ELSE 'PERSISTING' END AS state FROM p FULL JOIN c USING (stable_key))
    SELECT stable_key, state, CASE WHEN state = 'NEW' THEN '2024-01-09' ELSE '2024-01-05' END AS first_seen, CASE WHEN state = 'RESOLVED' THEN '2024-01-05' ELSE '2024-01-09' END AS last_seen,
      CAST(CASE WHEN state = 'PERSISTING' THEN 4 ELSE 0 END AS BIGINT) AS age_days,
      CASE WHEN d IN ('ACCEPTED', 'FALSE_POSITIVE') THEN d WHEN state = 'RESOLVED' THEN 'RESOLVED' ELSE coalesce(d, 'OPEN') END AS disposition FROM j"""
)
def issue_lifecycle(spark, sf_dir):
    s = relation(spark, sf_dir, "states").select(F.sha2(F.concat_ws("\x1f", F.col("user_id").cast("string"), "event_type"), 256).alias("stable_key"), "user_id", "day").distinct()
    day = F.lit("2024-01-05").cast("date")
    was = F.when(F.col("user_id") % 4 == 0, "ACCEPTED").when(F.col("user_id") % 4 == 1, "FALSE_POSITIVE").otherwise("OPEN")
    before = s.where(F.col("day") == day).select("stable_key", day.alias("first_seen"), day.alias("last_seen"), was.alias("disposition"))
    states = snapshot.issue_lifecycle(s.where("day = date'2024-01-09'"), before, F.lit("2024-01-09").cast("date"))
    return states.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


_DAYS = f"WITH s AS (SELECT DISTINCT user_id, event_type, day FROM {duck('states')} t), a AS (SELECT user_id, event_type FROM s WHERE day = DATE '2024-01-03'), b AS (SELECT user_id, event_type FROM s WHERE day = DATE '2024-01-04')"


@query(_DAYS + " SELECT *, 'ADDED' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'REMOVED' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'UNCHANGED' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def batch_diff(spark, sf_dir):
    s = relation(spark, sf_dir, "states")
    day = lambda d: s.where(f"day = date'{d}'").select("user_id", "event_type").distinct()
    return snapshot.batch_diff(day("2024-01-03"), day("2024-01-04"))


@query(_DAYS + " SELECT CAST(user_id AS VARCHAR) AS source, event_type AS target, CASE WHEN b.k IS NULL THEN 'ONLY_DEV' WHEN a.k IS NULL THEN 'ONLY_PROD' ELSE 'COMMON' END AS presence FROM (SELECT *, 1 AS k FROM a) a FULL JOIN (SELECT *, 1 AS k FROM b) b USING (user_id, event_type)")
def env_diff(spark, sf_dir):
    s = relation(spark, sf_dir, "states").where("day between date'2024-01-03' and date'2024-01-04'")
    edges = s.select(F.when(F.col("day") == F.lit("2024-01-03").cast("date"), "dev").otherwise("prod").alias("environment"), F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("target"))
    return snapshot.environment_diff(edges, "dev", "prod")


@query(
    f"""WITH s AS (SELECT user_id, event_type, hash, day FROM {duck('states')} t) SELECT user_id, event_type, hash FROM s a WHERE day = DATE '2024-01-03' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.day = DATE '2024-01-04' AND b.user_id = a.user_id AND b.event_type = a.event_type)
    UNION ALL SELECT user_id, event_type, hash FROM s WHERE day = DATE '2024-01-04'"""
)
def merge_override(spark, sf_dir):
    s = relation(spark, sf_dir, "states")
    day = lambda d: s.where(f"day = date'{d}'").select("user_id", "event_type", "hash")
    return snapshot.merge_override(day("2024-01-03"), day("2024-01-04"), ["user_id", "event_type"])


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def candidate_duplicate_keys(spark, sf_dir):
    return snapshot.duplicate_keys(run(spark, sf_dir, "select l_partkey, l_suppkey from lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def candidate_orphans(spark, sf_dir):
    rows = run(spark, sf_dir, "select o_orderkey, o_custkey from orders")
    return snapshot.orphans(rows, run(spark, sf_dir, "select c_custkey as o_custkey from customer where c_acctbal > 0"), ["o_custkey"])


@query("SELECT o_orderkey, disposition, disposition IS DISTINCT FROM 'RESOLVED' AS is_active FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'O' THEN 'OPEN' END AS disposition FROM orders)")
def active_switch(spark, sf_dir):
    return snapshot.activate(run(spark, sf_dir, "select o_orderkey, case o_orderstatus when 'F' then 'RESOLVED' when 'O' then 'OPEN' end as disposition from orders"))


@query("SELECT o_orderkey AS batch_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_at, count(l_orderkey) AS n_rows FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY ALL")
def batch_history(spark, sf_dir):
    batches = run(spark, sf_dir, "select o_orderkey as batch_id, cast(cast(o_orderdate as date) as string) as created_at from orders")
    return snapshot.history(batches, run(spark, sf_dir, "select l_orderkey as batch_id from lineitem where l_returnflag = 'R'"))
