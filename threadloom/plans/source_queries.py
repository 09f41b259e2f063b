"""Registered queries of readers, stores and scope filters: the given tables are written in other forms first and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.tables import scratch
from threadloom.operators import reconcile
from threadloom.plans.reconcile_queries import ORACLE_SQL as RECONCILED
from threadloom.plans.reconcile_queries import reconcile_edges
from threadloom.plans.registry import Registry
from threadloom.plans.relations import run
from threadloom.sources import readers, store

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql

_REGISTRY = "select p_name as name, case when p_size % 9 > 0 then concat('select ', cast(p_partkey as varchar(20)), ' from t') end as code, case when p_size % 2 = 0 then concat(' \"dws_dwf\".t', cast(p_size as varchar(20))) else 'bare' end as target from part"


@query(
    f"""WITH r AS (SELECT trim(name) AS program_name, code AS script_code, CASE WHEN target <> 'bare' THEN upper(replace(trim(target), '"', '')) END AS expected_target FROM ({_REGISTRY}) WHERE code IS NOT NULL)
    SELECT 'PROD' AS environment, 'main' AS source_profile, *, sha256(concat('{{"environment":"PROD","expected_target":', coalesce('"' || expected_target || '"', 'null'), ',"program_name":"', program_name, '","script_code":"', script_code, '","source_profile":"main"}}')) AS source_hash FROM r"""
)
def program_registry_scan(spark, sf_dir):
    """A1, A2."""
    return readers.program_sources(run(spark, sf_dir, _REGISTRY), "PROD", "main", "name", "code", "target")


_PATHS = """select p_partkey, concat('/home/P/1.0/DWS_DW', case when p_size % 5 = 0 then 'M' else 'F' end, case when p_size % 7 = 0 then '' else '/' end, '/DWS_DWF.t_', cast(p_partkey as varchar(20)), '/job', case when p_size % 3 = 0 then '.txt' else '.py' end) as path, p_type as text from part"""


@query(
    f"""WITH p AS (SELECT *, path LIKE '%.txt' AS other, path LIKE '%DWS_DWM%' AS wrong FROM ({_PATHS})) SELECT p_partkey, CASE WHEN NOT other AND NOT wrong THEN 'DWF' END AS layer, CASE WHEN NOT other AND NOT wrong THEN concat('DWF.T_', CAST(p_partkey AS VARCHAR)) END AS target,
    CASE WHEN other THEN 'NOT_A_PROGRAM' WHEN wrong THEN 'LAYER_MISMATCH' END AS reason, text FROM p"""
)
def working_copy_paths(spark, sf_dir):
    """Where files of a working copy belong, and their bytes as text."""
    layer, target, reason = readers.classify_path(F.col("path"))
    return run(spark, sf_dir, _PATHS).select("p_partkey", layer.alias("layer"), target.alias("target"), reason.alias("reason"), readers.decoded(F.col("text").cast("binary")).alias("text"))


@query(f"WITH p AS (SELECT *, path LIKE '%.txt' OR path LIKE '%DWS_DWM%' AS bad FROM ({_PATHS})) SELECT CASE WHEN NOT bad THEN 'DWF' END AS layer, count(*) AS files, count(DISTINCT CASE WHEN NOT bad THEN p_partkey END) AS targets, count(*) FILTER (WHERE bad) AS rejected, CASE WHEN count(*) FILTER (WHERE bad) = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM p GROUP BY 1")
def working_copy_inventory(spark, sf_dir):
    """A5 over paths that a table holds; scan_working_copy (A3, A13) gives them from a folder."""
    layer, target, reason = readers.classify_path(F.col("path"))
    return readers.inventory(run(spark, sf_dir, _PATHS).select("path", layer.alias("layer"), target.alias("target"), reason.alias("reason")))


_SCHEDULE = """select concat('J', cast(l_orderkey % 100 as varchar(20))) as process_name, case l_linenumber % 3 when 0 then 'P1' when 1 then 'P2' else 'P3' end as project, concat(case when l_quantity > 40 then 'dwm.p' else 'dwf.p' end, cast(l_partkey as varchar(20))) as target_table,
    case when l_suppkey % 13 = 0 then 'bare' else concat('dwd.s', cast(l_suppkey as varchar(20))) end as source_table from lineitem"""
_JUDGED = f"SELECT *, CASE WHEN NOT (project = 'P1' OR (project = 'P2' AND starts_with(target_table, 'dwf.'))) THEN 'OUT_OF_SCOPE' WHEN source_table = 'bare' THEN 'SOURCE' END AS reason FROM ({_SCHEDULE})"


def _schedule(spark, sf_dir):
    return readers.schedule_edges(run(spark, sf_dir, _SCHEDULE), "PROD", readers.schedule_scope(F.col("project"), F.col("target_table"), ["P1"], [("P2", "dwf.")]))


@query(f"SELECT 'PROD' AS environment, upper(target_table) AS target, upper(source_table) AS source, min(process_name) AS process_name FROM ({_JUDGED}) WHERE reason IS NULL GROUP BY 2, 3")
def schedule_relation_scan(spark, sf_dir):
    """A6, C4."""
    return _schedule(spark, sf_dir)[0]


@query(f"SELECT reason, count(*) AS n FROM ({_JUDGED}) GROUP BY reason")
def schedule_rejects(spark, sf_dir):
    """Counters."""
    return _schedule(spark, sf_dir)[1]


@query("SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def json_lines_scan(spark, sf_dir):
    """A14."""
    path = scratch(spark, "jsonl")
    run(spark, sf_dir, "select o_orderkey, o_orderpriority, o_orderstatus from orders").write.json(path)
    return readers.json_lines(spark, path, "o_orderkey long, o_orderpriority string, o_orderstatus string")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS job, concat(o_orderpriority, ',', o_orderstatus) AS rest FROM orders")
def first_comma_scan(spark, sf_dir):
    """Lines with more commas than columns."""
    path = scratch(spark, "lines")
    run(spark, sf_dir, "select concat(cast(o_orderkey as string), ', ', o_orderpriority, ',', o_orderstatus) as value from orders").write.text(path)
    return readers.two_columns(spark, path, ("job", "rest"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def headerless_scan(spark, sf_dir):
    """A11."""
    path = scratch(spark, "csv")
    run(spark, sf_dir, "select o_orderkey, o_orderstatus from orders").write.csv(path)
    return readers.headerless_csv(spark, path, "o_orderkey long, o_orderstatus string")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def parameterized_fetch(spark, sf_dir):
    """A12."""
    run(spark, sf_dir, "select * from orders").createOrReplaceTempView("fetch_orders")
    return readers.parameterized(spark, "select o_orderkey from fetch_orders where o_orderstatus = :status and o_totalprice > :least", {"status": "F", "least": 1000})


def _published(spark, sf_dir):
    """A store with a batch of all orders and then an active one of those that aren't F."""
    snapshots = store.SnapshotStore(spark, scratch(spark, "snapshots"))
    rows = run(spark, sf_dir, "select o_orderkey, o_custkey, o_orderstatus from orders")
    snapshots.publish({"orders": rows}, {"orders": ["o_orderkey"]}, "one")
    snapshots.publish({"orders": rows.where("o_orderstatus <> 'F'")}, {"orders": ["o_orderkey"]}, "two")
    return snapshots


@query("SELECT o_orderkey, o_custkey, o_orderstatus, 'two' AS batch_id FROM orders WHERE o_orderstatus <> 'F'")
def active_snapshot_scan(spark, sf_dir):
    """Readers see the batch that was made active last."""
    return _published(spark, sf_dir).read("orders")


@query(
    """WITH i AS (SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus FROM orders WHERE o_custkey % 3 = 0), o AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F')
    SELECT * FROM i UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM i) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
)
def carried_over_rows(spark, sf_dir):
    """Incoming rows beside the active batch's, without those of declared scopes that are absent."""
    snapshots = _published(spark, sf_dir)
    incoming = run(spark, sf_dir, "select o_orderkey, o_custkey, 'X' as o_orderstatus from orders where o_custkey % 3 = 0")
    scopes = run(spark, sf_dir, "select c_custkey as o_custkey from customer where c_acctbal < 0")
    snapshots.publish({"orders": snapshots.carried_over("orders", incoming, ["o_orderkey"], scopes, ["o_custkey"], True)}, {"orders": ["o_orderkey"]}, "three")
    return snapshots.read("orders").drop("batch_id")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def report_round_trip(spark, sf_dir):
    """B10."""
    path = scratch(spark, "report")
    store.write_report(run(spark, sf_dir, "select o_orderpriority as priority, count(*) as n from orders group by 1"), path)
    return spark.read.schema("priority string, n long").option("header", "true").csv(path)


_ROWS = "select case when l_linestatus = 'O' then 'PROD' else 'DEV' end as environment, l_returnflag as profile, concat('T', cast(l_partkey as varchar(20))) as target, concat('G', cast(l_suppkey as varchar(20))) as program, l_orderkey from lineitem"


@query(f"SELECT * FROM ({_ROWS}) WHERE environment = 'PROD' AND profile = 'R' AND (target IN ('T1', 'T2', 'T77') OR program IN ('G3', 'G4'))")
def scoped_rows(spark, sf_dir):
    """C1, C2, C3."""
    return reconcile.in_scope(run(spark, sf_dir, _ROWS), "PROD", "R", ["T1", "T2", "T77"], ["G3", "G4"])


@query(f"SELECT * FROM ({RECONCILED["reconcile_edges"]}) WHERE status = 'SQL_ONLY' AND source <> target")
def visible_rows(spark, sf_dir):
    """What a reader who hides matches and rows of a table to itself sees."""
    return reconcile.visible(reconcile.display(reconcile_edges(spark, sf_dir)), status="SQL_ONLY", hide_suppressed=True, hide_self=True).drop("kind", "place")


@query(f"SELECT batch_id, o_orderkey, n FROM (SELECT 2 AS batch_id) b LEFT JOIN (SELECT o_orderkey % 3 AS batch_id, o_orderkey, count(*) AS n FROM orders GROUP BY ALL) USING (batch_id)")
def active_batch_rows(spark, sf_dir):
    """A15, D1, D2 on tables: a left join from the active batch."""
    batches = run(spark, sf_dir, "select distinct cast(o_orderkey % 3 as int) as batch_id, o_orderkey % 3 = 2 as is_active from orders")
    facts = run(spark, sf_dir, "select cast(o_orderkey % 3 as int) as batch_id, o_orderkey, count(*) as n from orders group by all")
    return readers.active_rows(facts, batches)

