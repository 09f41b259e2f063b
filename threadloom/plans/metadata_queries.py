"""Registered queries over job, plan and column metadata, and more scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import names, sqltext
from threadloom.operators import extract, graph, metadata
from threadloom.plans.registry import Registry
from threadloom.plans.relations import duck, relation, run

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_chain')} t), p AS (SELECT concat('PLAN', CAST(o_custkey AS VARCHAR)) AS plan, min(o_orderkey) AS job FROM orders GROUP BY o_custkey),
    w AS (SELECT plan, job FROM p UNION SELECT w.plan, e.dst FROM w JOIN e ON e.src = w.job) SELECT plan, job, concat('DWF.', o_orderpriority) AS target FROM w JOIN orders ON o_orderkey = job WHERE o_orderstatus = 'F'"""
)
def plan_receipts(spark, sf_dir):
    plans = run(spark, sf_dir, "select concat('PLAN', cast(o_custkey as string)) as plan, min(o_orderkey) as job from orders group by o_custkey")
    outputs = run(spark, sf_dir, "select o_orderkey as job, concat(case when o_orderstatus = 'F' then 'DWF.' else 'DWD.' end, o_orderpriority) as target from orders")
    return metadata.receipts(plans, outputs, relation(spark, sf_dir, "edges_chain"), "DWF.")


@query("SELECT doc_id, pattern FROM documents, (SELECT upper(n_name) AS pattern FROM nation UNION SELECT 'LICENSE' UNION SELECT 'HAND') p WHERE contains(upper(text), pattern)")
def substring_join(spark, sf_dir):
    patterns = run(spark, sf_dir, "select upper(n_name) as pattern from nation union select 'LICENSE' union select 'HAND'")
    return metadata.containing(run(spark, sf_dir, "select doc_id, text from documents"), "doc_id", "text", patterns)


_READS = "select distinct concat('J', cast(l_orderkey % 60 as varchar(20))) as job, concat('T', cast((l_orderkey % 60) * 2 + l_linenumber % 3 as varchar(20))) as tab from lineitem where l_linenumber < 4"
_WRITES = "select distinct concat('J', cast(l_orderkey % 60 as varchar(20))) as job, concat('T', cast(l_orderkey % 60 as varchar(20))) as tab from lineitem"


@query(
    f"""WITH RECURSIVE r AS ({_READS}), w AS ({_WRITES}), own AS (SELECT * FROM r EXCEPT SELECT * FROM w), e AS (SELECT concat('table:', tab) AS a, concat('task:', job) AS b FROM w UNION SELECT concat('task:', job), concat('table:', tab) FROM own),
    g AS (SELECT concat('table:T', k) AS start, concat('table:T', k) AS node, 0 AS level FROM (SELECT unnest(['1', '7']) AS k) UNION SELECT g.start, e.b, g.level + 1 FROM g JOIN e ON e.a = g.node WHERE g.level < 30)
    SELECT split_part(start, ':', 2) AS start, split_part(node, ':', 2) AS node, split_part(node, ':', 1) AS kind, CAST(min(level) AS INTEGER) AS "column" FROM g GROUP BY g.start, g.node"""
)
def layered_upstream(spark, sf_dir):
    reads, writes = (run(spark, sf_dir, t).withColumnRenamed("tab", "table") for t in (_READS, _WRITES))
    start = spark.sql("select explode(array('T1', 'T7')) as table")
    return metadata.layered(reads, writes, start)


_COLUMNS = "select distinct 's' as schema_name, concat('t', cast(l_suppkey % 30 as varchar(20))) as a, concat('c', cast(l_linenumber as varchar(20))) as b, concat('t', cast(l_suppkey % 30 + 1 + l_partkey % 3 as varchar(20))) as c, concat('c', cast((l_linenumber * 3) % 7 as varchar(20))) as d from lineitem where l_suppkey % 30 < 27"


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT upper(concat('s.', a, '.', b)) AS src, upper(concat('s.', c, '.', d)) AS dst FROM ({_COLUMNS})), g AS (SELECT 'S.T0.C1' AS node, 0 AS level UNION SELECT e.dst, g.level + 1 FROM g JOIN e ON e.src = g.node WHERE g.level < 30)
    SELECT 'S.T0.C1' AS start, node, CAST(min(level) AS INTEGER) AS level FROM g GROUP BY node"""
)
def column_walk(spark, sf_dir):
    rows = run(spark, sf_dir, _COLUMNS).select(F.col("schema_name").alias("schema"), F.col("a").alias("table"), F.col("b").alias("column"), F.col("schema_name").alias("to_schema"), F.col("c").alias("to_table"), F.col("d").alias("to_column"))
    return metadata.column_walk(rows, spark.sql("select 'S.T0.C1' as node"))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT unnest([(SELECT min(p_name) FROM part), upper((SELECT max(p_name) FROM part)), 'a', 'nothing like it']) AS wanted),
    h AS (SELECT wanted, max(CASE WHEN upper(name) = upper(wanted) THEN name END) AS exact, count(*) FILTER (WHERE ends_with(upper(name), upper(wanted))) AS n_ends, min(name) FILTER (WHERE ends_with(upper(name), upper(wanted))) AS ends, count(*) AS n, min(name) AS holds FROM w JOIN n ON contains(upper(name), upper(wanted)) GROUP BY wanted)
    SELECT DISTINCT wanted, coalesce(exact, CASE WHEN n_ends = 1 THEN ends END, CASE WHEN n = 1 THEN holds END) AS match, CASE WHEN exact IS NOT NULL THEN 'EXACT' WHEN n_ends = 1 THEN 'SUFFIX' WHEN n = 1 THEN 'CONTAINS' WHEN n IS NULL THEN 'NONE' ELSE 'CANDIDATES' END AS state, coalesce(n, 0) AS candidates FROM w LEFT JOIN h USING (wanted)"""
)
def start_resolution(spark, sf_dir):
    wanted = run(spark, sf_dir, "select min(p_name) as wanted from part union all select upper(max(p_name)) from part union all select 'a' union all select 'nothing like it'")
    return metadata.find_start(run(spark, sf_dir, "select distinct p_name as name from part"), wanted)


@query(f"WITH e AS (SELECT src, dst FROM {duck('edges_tree')} t) SELECT DISTINCT dst AS target FROM e WHERE dst NOT IN (SELECT src FROM e)")
def terminal_targets(spark, sf_dir):
    return metadata.terminal_targets(relation(spark, sf_dir, "edges_tree"))


_TRUTH = "select o_custkey as sample, o_orderkey as position, o_orderstatus as target, o_orderpriority as sources from orders"


@query(
    f"""WITH e AS (SELECT * FROM ({_TRUTH}) WHERE position % 5 <> 0), a AS (SELECT sample, position, CASE WHEN position % 7 = 0 THEN 'X' ELSE target END AS target, CASE WHEN position % 3 = 0 THEN 'Y' ELSE sources END AS sources FROM ({_TRUTH}) WHERE position % 4 <> 0)
    SELECT sample, count(*) FILTER (WHERE e.target = a.target AND e.sources = a.sources) AS exact, count(*) FILTER (WHERE a.target IS NULL) AS missing, count(*) FILTER (WHERE e.target IS NULL) AS extra, count(*) FILTER (WHERE e.target <> a.target) AS wrong_target,
    count(*) FILTER (WHERE e.target = a.target AND e.sources <> a.sources) AS wrong_sources FROM e FULL JOIN a USING (sample, position) GROUP BY sample"""
)
def extraction_truth(spark, sf_dir):
    rows = run(spark, sf_dir, _TRUTH)
    actual = rows.where("position % 4 <> 0").withColumn("target", F.when(F.col("position") % 7 == 0, "X").otherwise(F.col("target"))).withColumn("sources", F.when(F.col("position") % 3 == 0, "Y").otherwise(F.col("sources")))
    return metadata.truth_metrics(rows.where("position % 5 <> 0"), actual)


@query(f"SELECT DISTINCT node, issue_type FROM (SELECT dst AS node, 'UNCLASSIFIED_FORMAL_SINK' AS issue_type FROM {duck('edges_supply')} t WHERE CAST(substr(src, 2) AS BIGINT) % 2 = 0 UNION ALL SELECT src, 'UNCLASSIFIED_FORMAL_SOURCE' FROM {duck('edges_supply')} t WHERE CAST(substr(dst, 2) AS BIGINT) % 100 = 0)")
def unclassified_nodes(spark, sf_dir):
    e = relation(spark, sf_dir, "edges_supply")
    number = lambda c: F.substring(c, 2, 30).cast("long")
    up, down = e.where(number("src") % 2 == 0).select(F.col("dst").alias("node")), e.where(number("dst") % 100 == 0).select(F.col("src").alias("node"))
    return metadata.unclassified(graph.roles(e), up, down)


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_size % 2 = 0 THEN p_type WHEN p_size % 3 = 0 THEN p_brand END AS ddl FROM part")
def object_definitions(spark, sf_dir):
    rows = run(spark, sf_dir, "select cast(p_partkey as string) as name, p_size, p_type, p_brand from part")
    tables, views = rows.where("p_size % 2 = 0").select("name", F.col("p_type").alias("ddl")), rows.where("p_size % 3 = 0").select("name", F.col("p_brand").alias("ddl"))
    return metadata.definition(rows, tables, views)


@query("WITH o AS (SELECT n_name AS environment, count(DISTINCT c_mktsegment) AS n, min(c_mktsegment) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9700 GROUP BY 1) SELECT n_name AS environment, CASE WHEN n = 1 THEN s END AS sql_profile, CASE WHEN n = 1 THEN lower(s) END AS schedule_profile FROM nation LEFT JOIN o ON environment = n_name")
def scope_resolution(spark, sf_dir):
    known = run(spark, sf_dir, "select n_name as environment, c_mktsegment as sql_profile, lower(c_mktsegment) as schedule_profile from customer join nation on n_nationkey = c_nationkey where c_acctbal > 9700")
    return metadata.scope_of(known, run(spark, sf_dir, "select n_name as environment from nation"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at_text FROM events")
def timestamp_projection(spark, sf_dir):
    return run(spark, sf_dir, "select event_id, ts from events").select("event_id", metadata.timestamp_text(F.col("ts")).alias("at_text"))


@query("SELECT *, CAST(row_number() OVER (ORDER BY l_shipmode, l_partkey) AS INTEGER) AS place FROM (SELECT DISTINCT l_returnflag AS l_shipmode, l_partkey FROM lineitem) ORDER BY l_shipmode, l_partkey LIMIT 50")
def ordered_page(spark, sf_dir):
    return metadata.ordered_page(run(spark, sf_dir, "select l_returnflag as l_shipmode, l_partkey from lineitem"), ["l_shipmode", "l_partkey"], 50)


_MIXED = """select p_partkey, concat('create or replace view v', cast(p_size as varchar(9)), ' as select nvl(a, b) from dwf.x', cast(p_size as varchar(9)), ' join 表', cast(p_size as varchar(9)), ' using (k); create temp table tmp_', cast(p_size as varchar(9)), ' (a int) distribute by hash(a, b', cast(p_size as varchar(9)), ')') as script,
    case when p_size % 2 = 0 then concat('[\"t', cast(p_size as varchar(9)), '\", \"f1\", \"f2\"]') else concat('t', cast(p_size as varchar(9)), ', f1') end as unload, concat('-outfile:1:outfile=', p_brand, ':0 schkey=K', cast(p_size as varchar(9))) as params from part"""


@query("SELECT p_partkey, concat('DWF.X', CAST(p_size AS VARCHAR)) AS tables, concat('V', CAST(p_size AS VARCHAR)) AS views, concat('TMP_', CAST(p_size AS VARCHAR)) AS temps, 'NVL' AS functions, concat('a, b', CAST(p_size AS VARCHAR)) AS hash_key FROM part")
def script_objects(spark, sf_dir):
    x = F.col("script")
    return run(spark, sf_dir, _MIXED).select(
        "p_partkey",
        F.array_join(sqltext.quick_tables(x), ",").alias("tables"),
        F.array_join(sqltext.created_objects(x, "VIEW"), ",").alias("views"),
        F.array_join(sqltext.created_objects(x, "TABLE"), ",").alias("temps"),
        F.array_join(sqltext.used_functions(x, ["nvl", "decode"]), ",").alias("functions"),
        sqltext.distribution_key(x).alias("hash_key"),
    )


@query("SELECT p_partkey, concat('T', CAST(p_size AS VARCHAR)) AS target, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_fields, CASE WHEN p_size % 2 = 0 THEN 'f1,f2' ELSE 'f1' END AS fields, p_brand AS outfile, concat('K', CAST(p_size AS VARCHAR)) AS schkey FROM part")
def unload_descriptors(spark, sf_dir):
    out = run(spark, sf_dir, _MIXED).select("p_partkey", sqltext.unload_descriptor(F.col("unload")).alias("u"), sqltext.job_parameter(F.col("params"), "outfile").alias("outfile"), sqltext.job_parameter(F.col("params"), "schkey").alias("schkey"))
    return out.select("p_partkey", "u.*", "outfile", "schkey")


@query("SELECT p_partkey, concat('N', CAST(p_size AS VARCHAR)) AS namespace, concat('X', CAST(p_size AS VARCHAR)) AS logical, concat('J', CAST(p_size AS VARCHAR)) AS program, concat('d/', CAST(p_size AS VARCHAR), '_JOB_J', CAST(p_size AS VARCHAR), '_DAY.py') AS tail FROM part")
def name_parts(spark, sf_dir):
    rows = run(spark, sf_dir, "select p_partkey, concat('PLAN_SA_RECV_N', cast(p_size as string), '_SRC_DAY') as plan, concat('dwf.f_x', cast(p_size as string)) as target, concat('/a/d/', cast(p_size as string), '_JOB_J', cast(p_size as string), '_DAY.py') as path from part")
    return rows.select("p_partkey", names.receive_namespace(F.col("plan"), F.lit("src")).alias("namespace"), names.logical_target(F.col("target")).alias("logical"), names.program_file_name(F.col("path")).alias("program"), names.last_components(F.col("path"), 2).alias("tail"))


@query("SELECT p_partkey, 0 AS block, concat('DWD.Y', CAST(p_size AS VARCHAR)) AS sources FROM part WHERE p_size % 2 = 0")
def static_empty_queries(spark, sf_dir):
    """K2: blocks that can't give a row, with their sources."""
    rows = run(spark, sf_dir, "select p_partkey, concat('insert into t select a from dwd.y', cast(p_size as string), ' where b > 0 and ', case when p_size % 2 = 0 then 'false' else '1 = 1' end) as script from part")
    return extract.blocks(rows, ["p_partkey"], "script").where("statically_false").select("p_partkey", "block", "sources")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 3 = 0")
def dynamic_targets(spark, sf_dir):
    """Statements whose written name holds a placeholder."""
    rows = run(spark, sf_dir, "select l_orderkey, l_linenumber, concat('insert into dwf.', case when l_linenumber % 3 = 0 then '{name}' else 't' end, ' select 1') as script from lineitem")
    return rows.where(sqltext.has_dynamic_target(F.col("script"))).select("l_orderkey", "l_linenumber")
