"""Registered queries on facts: aggregates, ranked picks, joins, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import names
from threadloom.operators import facts
from threadloom.plans.registry import Registry
from threadloom.plans.relations import duck, relation, run

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql

_PROGRAMS = """SELECT o_orderstatus AS environment, o_orderpriority AS profile, o_orderkey % 7 <> 0 AS parsed, o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS has_target, o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AND o_totalprice > 50000 AS has_edges FROM orders"""


@query(f"SELECT environment, profile, count(*) AS programs, count(*) FILTER (WHERE parsed) AS parsed, count(*) FILTER (WHERE has_target) AS with_target, count(*) FILTER (WHERE has_edges) AS with_edges, round(count(*) FILTER (WHERE parsed) / count(*), 6) AS parsed_ratio, round(count(*) FILTER (WHERE has_target) / count(*), 6) AS with_target_ratio, round(count(*) FILTER (WHERE has_edges) / count(*), 6) AS with_edges_ratio FROM ({_PROGRAMS}) GROUP BY ALL")
def coverage_funnel(spark, sf_dir):
    return facts.coverage_funnel(run(spark, sf_dir, _PROGRAMS.replace("FROM orders", "from orders")))


_SAMPLES = "SELECT l_returnflag AS issue_type, CASE WHEN l_linenumber = 1 THEN 'AMBIGUOUS' WHEN l_quantity > 20 THEN 'TP' ELSE 'FP' END AS label from lineitem"


@query(f"""SELECT issue_type, count(*) FILTER (WHERE label = 'TP') AS tp, count(*) FILTER (WHERE label = 'FP') AS fp, count(*) FILTER (WHERE label = 'AMBIGUOUS') AS ambiguous, count(*) AS n,
    round(count(*) FILTER (WHERE label = 'TP') / nullif(count(*) FILTER (WHERE label IN ('TP', 'FP')), 0), 6) AS precision, round(count(*) FILTER (WHERE label = 'AMBIGUOUS') / count(*), 6) AS ambiguous_rate FROM ({_SAMPLES}) GROUP BY GROUPING SETS ((issue_type), ())""")
def corpus_metrics(spark, sf_dir):
    return facts.corpus_metrics(run(spark, sf_dir, _SAMPLES), "issue_type")


@query("SELECT l_suppkey, count(*) AS facts, count(DISTINCT l_partkey) AS distinct_items, array_to_string(list_slice(list_sort(list(DISTINCT l_partkey)), 1, 5), ',') AS sample, count(DISTINCT l_partkey) > 5 AS truncated FROM lineitem GROUP BY l_suppkey")
def evidence_samples(spark, sf_dir):
    return facts.evidence(run(spark, sf_dir, "select l_suppkey, l_partkey from lineitem"), ["l_suppkey"], "l_partkey", 5)


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def multiset_difference(spark, sf_dir):
    return facts.multiset_minus(run(spark, sf_dir, "select l_partkey, l_orderkey from lineitem"), run(spark, sf_dir, "select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45"), "l_partkey")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag")
def quantiles(spark, sf_dir):
    return facts.quantiles(run(spark, sf_dir, "select l_returnflag, l_extendedprice from lineitem"), "l_returnflag", "l_extendedprice")


@query("SELECT part, max(last) AS last FROM (SELECT l_partkey AS part, max(CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS last FROM lineitem GROUP BY 1 UNION ALL SELECT o_custkey AS part, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) FROM orders GROUP BY 1) GROUP BY part")
def schedule_times(spark, sf_dir):
    a = run(spark, sf_dir, "select l_partkey as part, cast(cast(l_shipdate as date) as string) as t from lineitem")
    b = run(spark, sf_dir, "select o_custkey as part, cast(cast(o_orderdate as date) as string) as t from orders")
    return a.unionByName(b).groupBy("part").agg(F.max("t").alias("last"))


@query("SELECT o_custkey, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey")
def min_status(spark, sf_dir):
    return run(spark, sf_dir, "select o_custkey, o_orderstatus from orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("status"))


_CATEGORY = "SELECT o_orderpriority AS category, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status from orders where o_totalprice > 1000"


@query(f"""WITH r AS ({_CATEGORY}), c AS (SELECT DISTINCT o_orderpriority AS category FROM orders UNION SELECT 'UNUSED')
    SELECT category, count(status) AS total, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'FAILED') AS failed,
      round(CASE WHEN count(status) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE status = 'SUCCESS') * 100 / count(status) END, 2) AS completion FROM c LEFT JOIN r USING (category) GROUP BY category""")
def status_pivot(spark, sf_dir):
    categories = run(spark, sf_dir, "select distinct o_orderpriority as category from orders union select 'UNUSED'")
    return facts.status_pivot(run(spark, sf_dir, _CATEGORY), categories)


@query("SELECT doc_id, lang, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('seed-1|', CAST(doc_id AS VARCHAR))), doc_id) AS rank FROM documents) WHERE rank <= 10")
def stratified_sample(spark, sf_dir):
    return facts.stratified_sample(run(spark, sf_dir, "select doc_id, lang from documents"), "lang", "doc_id", "seed-1", 10)


@query("SELECT o_custkey, o_totalprice, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1")
def representative_row(spark, sf_dir):
    return facts.representative(run(spark, sf_dir, "select o_custkey, o_totalprice, o_orderkey, o_orderstatus from orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS INTEGER) AS position FROM conversations")
def step_order(spark, sf_dir):
    return facts.step_order(run(spark, sf_dir, "select conv_id, turn, role from conversations"), "conv_id", [F.desc("turn"), "role"])


@query("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS alert FROM orders QUALIFY alert <= 3")
def slowest_three(spark, sf_dir):
    return facts.slowest(run(spark, sf_dir, "select o_orderkey, o_totalprice from orders"), "o_totalprice", ["o_orderkey"])


@query(
    """WITH t AS (SELECT concat(CASE WHEN s_suppkey % 3 = 0 THEN 'DWS_' ELSE '' END, 'TAB', CAST(s_suppkey AS VARCHAR)) AS name FROM supplier),
    a AS (SELECT DISTINCT name, unnest([name, regexp_replace(name, '^DWS_', ''), CASE WHEN name LIKE 'DWS!_%' ESCAPE '!' THEN name ELSE concat('DWS_', name) END]) AS alias FROM t),
    s AS (SELECT concat(CASE WHEN l_partkey % 2 = 0 THEN 'DWS_' ELSE '' END, 'TAB', CAST(l_suppkey AS VARCHAR)) AS alias, min(l_linenumber * 3600 + l_partkey % 60) AS seconds FROM lineitem WHERE l_quantity > 40 AND l_suppkey % 4 <> 0 GROUP BY 1)
    SELECT name, min(seconds) AS earliest FROM a LEFT JOIN s USING (alias) GROUP BY name"""
)
def alias_join(spark, sf_dir):
    tables = run(spark, sf_dir, "select concat(case when s_suppkey % 3 = 0 then 'DWS_' else '' end, 'TAB', cast(s_suppkey as string)) as name from supplier")
    times = run(spark, sf_dir, "select concat(case when l_partkey % 2 = 0 then 'DWS_' else '' end, 'TAB', cast(l_suppkey as string)) as alias, l_linenumber * 3600 + l_partkey % 60 as seconds from lineitem where l_quantity > 40 and l_suppkey % 4 <> 0")
    return facts.latest_by_alias(tables, times)


@query(
    """WITH p AS (SELECT DISTINCT concat('L', CAST(l_suppkey % 20 AS VARCHAR)) AS logical, concat('N', CAST(l_suppkey % 7 AS VARCHAR), CASE WHEN l_linenumber % 2 = 0 THEN '_X' ELSE 'X' END, '_', CAST(l_partkey % 50 AS VARCHAR)) AS encoded FROM lineitem),
    n AS (SELECT DISTINCT concat('L', CAST(s_suppkey % 20 AS VARCHAR)) AS logical, unnest([concat('N', CAST(s_suppkey % 7 AS VARCHAR)), concat('N', CAST(s_suppkey % 5 AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN '_X' ELSE 'X' END)]) AS namespace FROM supplier),
    h AS (SELECT p.logical, p.encoded, count(DISTINCT namespace) AS candidates, min(namespace) AS namespace FROM p JOIN n ON p.logical = n.logical AND (starts_with(encoded, concat(namespace, '_')) OR encoded = namespace) GROUP BY ALL)
    SELECT p.logical, p.encoded, coalesce(candidates, 0) AS candidates, CASE WHEN candidates = 1 THEN namespace END AS namespace, CASE WHEN candidates IS NULL THEN 'UNRESOLVED' WHEN candidates = 1 THEN 'RESOLVED' ELSE 'CONFLICT' END AS state FROM p LEFT JOIN h USING (logical, encoded)"""
)
def metadata_resolution(spark, sf_dir):
    p = run(spark, sf_dir, "select distinct concat('L', cast(l_suppkey % 20 as string)) as logical, concat('N', cast(l_suppkey % 7 as string), case when l_linenumber % 2 = 0 then '_X' else 'X' end, '_', cast(l_partkey % 50 as string)) as encoded from lineitem")
    n = run(spark, sf_dir, "select distinct concat('L', cast(s_suppkey % 20 as string)) as logical, explode(array(concat('N', cast(s_suppkey % 7 as string)), concat('N', cast(s_suppkey % 5 as string), case when s_suppkey % 2 = 0 then '_X' else 'X' end))) as namespace from supplier")
    return facts.namespace_matches(p, n)


_DEPS = "select distinct o_orderkey % 700 as job, o_custkey % 900 as dep from orders"


@query(f"WITH j AS (SELECT DISTINCT CAST(o_orderkey % 700 AS VARCHAR) AS job FROM orders), d AS (SELECT CAST(job AS VARCHAR) AS job, CAST(dep AS VARCHAR) AS dep FROM ({_DEPS})) SELECT j.job, coalesce(a.dep, '') AS unload, coalesce(b.dep, '') AS process FROM j LEFT JOIN d a ON a.job = j.job LEFT JOIN d b ON b.job = a.dep")
def two_hop_chain(spark, sf_dir):
    deps = run(spark, sf_dir, _DEPS).select(F.col("job").cast("string"), F.col("dep").cast("string"))
    return facts.two_hops(run(spark, sf_dir, "select distinct cast(o_orderkey % 700 as string) as job from orders"), deps)


@query(
    """WITH a AS (SELECT o_orderkey AS id, concat('/x/', CAST(o_custkey % 50 AS VARCHAR), '/', o_orderstatus, '/', CAST(o_orderkey % 9 AS VARCHAR)) AS path FROM orders),
    b AS (SELECT c_custkey AS id, concat('/y/z/', CAST(c_custkey % 50 AS VARCHAR), '/O/', CAST(c_nationkey % 9 AS VARCHAR)) AS path FROM customer WHERE c_acctbal > 9000),
    s AS (SELECT id, array_to_string(string_split(path, '/')[-3:], '/') AS tail FROM a), t AS (SELECT id, array_to_string(string_split(path, '/')[-3:], '/') AS tail FROM b)
    SELECT s.tail, s.id AS left_id, t.id AS right_id FROM s JOIN t USING (tail)"""
)
def path_suffix_join(spark, sf_dir):
    a = run(spark, sf_dir, "select o_orderkey as id, concat('/x/', cast(o_custkey % 50 as string), '/', o_orderstatus, '/', cast(o_orderkey % 9 as string)) as path from orders")
    b = run(spark, sf_dir, "select c_custkey as id, concat('/y/z/', cast(c_custkey % 50 as string), '/O/', cast(c_nationkey % 9 as string)) as path from customer where c_acctbal > 9000")
    return facts.path_suffix_join(a, b, 3)


_EDGES = "select concat('DWD.S', cast(l_suppkey as varchar(20))) as source, concat('DWF.P', cast(l_partkey as varchar(20))) as target, concat('G', cast(l_orderkey % 100 as varchar(20))) as program from lineitem"
_TASKS = f"""WITH e AS ({_EDGES}), b AS (SELECT concat('table:', source) AS src, concat('task:', program) AS dst FROM e UNION ALL SELECT concat('task:', program), concat('table:', target) FROM e),
    p AS (SELECT src, dst, count(*) AS facts FROM b GROUP BY ALL)"""


@query(_TASKS + " SELECT src, dst, facts, sha256(concat_ws(chr(31), src, dst)) AS edge_key FROM p")
def task_projection(spark, sf_dir):
    return facts.task_projection(run(spark, sf_dir, _EDGES))


@query(_TASKS + " SELECT count(*) AS edges, CAST(sum(length(src) + length(dst)) AS BIGINT) AS name_bytes, CAST(sum(facts) AS BIGINT) AS facts, (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM p UNION ALL SELECT dst FROM p)) AS nodes, round((1 - count(*) / sum(facts)) * 100, 2) AS reduction FROM p")
def projection_preflight(spark, sf_dir):
    return facts.projection_preflight(run(spark, sf_dir, _EDGES))


@query("SELECT field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY field")
def json_field_profile(spark, sf_dir):
    return facts.json_fields(run(spark, sf_dir, "select props from events"), "props")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS nulls, count(*) FILTER (WHERE text = '') AS empty, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents GROUP BY lang")
def source_statistics(spark, sf_dir):
    return facts.source_statistics(run(spark, sf_dir, "select lang, text from documents"), "lang", "text")


@query(
    """SELECT o_orderkey, CASE WHEN n = 0 THEN 'MISSING' WHEN n = 1 THEN 'SINGLE_SOURCE' WHEN d = 1 THEN 'MATCH' ELSE 'CONFLICT' END AS verdict, coalesce(a, b, c) AS value FROM (
    SELECT *, len(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS n, len(list_distinct(list_filter([a, b, c], lambda x: x IS NOT NULL))) AS d FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS a, CASE WHEN o_custkey % 2 = 0 THEN 'F' END AS b, CASE WHEN o_custkey % 5 = 0 THEN 'O' END AS c FROM orders))"""
)
def evidence_verdicts(spark, sf_dir):
    rows = run(spark, sf_dir, "select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderstatus end as a, case when o_custkey % 2 = 0 then 'F' end as b, case when o_custkey % 5 = 0 then 'O' end as c from orders")
    return rows.select("o_orderkey", facts.three_way(F.col("a"), F.col("b"), F.col("c")).alias("v")).select("o_orderkey", "v.*")


@query("WITH f AS (SELECT user_id AS profile, event_type AS feature, 'PRESENT' AS state FROM events WHERE value > 90 GROUP BY 1, 2) SELECT p.profile, x.feature, coalesce(f.state, 'UNKNOWN') AS state FROM (SELECT DISTINCT user_id AS profile FROM events) p CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS feature) x LEFT JOIN f USING (profile, feature)")
def evidence_matrix(spark, sf_dir):
    found = run(spark, sf_dir, "select user_id as profile, event_type as feature, 'PRESENT' as state from events where value > 90 group by 1, 2")
    return facts.evidence_matrix(run(spark, sf_dir, "select distinct user_id as profile from events"), ["click", "error", "purchase", "signup", "view"], found)


@query("SELECT coalesce(b.k, o.k) AS k, coalesce(o.v, b.v) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0) b FULL JOIN (SELECT o_custkey AS k, max(o_orderpriority) AS v FROM orders WHERE o_custkey % 4 = 0 GROUP BY 1) o ON b.k = o.k")
def overlay_merge(spark, sf_dir):
    base = run(spark, sf_dir, "select c_custkey as k, c_mktsegment as v from customer where c_custkey % 3 <> 0")
    return facts.overlay(base, run(spark, sf_dir, "select o_custkey as k, max(o_orderpriority) as v from orders where o_custkey % 4 = 0 group by 1"), "k", "v")


_NAMES = "select l_orderkey, l_linenumber, concat(case l_linenumber % 4 when 0 then '005' when 1 then ' 005' else '5' end, ':dws_dwf.t', cast(l_partkey as varchar(20)), ':', cast(l_suppkey as varchar(20)), case when l_quantity > 25 then ':00' when l_quantity > 20 then ':x' else '' end) as name from lineitem"


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN four THEN t END AS target, CASE WHEN marked THEN t END AS hint, CASE WHEN four AND CAST(p[3] AS INTEGER) > 0 THEN CAST(p[3] AS INTEGER) END AS step, CASE WHEN four THEN p[4] END AS suffix,
      concat_ws(',', CASE WHEN NOT marked THEN 'PROGRAM_NAME_MARKER_INVALID,PROGRAM_NAME_TARGET_INVALID' END, CASE WHEN marked AND NOT four THEN 'PROGRAM_NAME_FORMAT_UNSUPPORTED,PROGRAM_NAME_INCOMPLETE,PROGRAM_NAME_STEP_MISSING' END, CASE WHEN four THEN 'PROGRAM_NAME_TARGET_RESOLVED' END, CASE WHEN four AND CAST(p[3] AS INTEGER) = 0 THEN 'PROGRAM_NAME_STEP_INVALID' END, CASE WHEN four AND p[4] <> '00' THEN 'PROGRAM_NAME_SUFFIX_NONSTANDARD' END) AS diagnostics
    FROM (SELECT *, p[1] = '005' AS marked, p[1] = '005' AND len(p) = 4 AS four, replace(upper(p[2]), 'DWS_DWF.', 'DWF.') AS t FROM (SELECT l_orderkey, l_linenumber, string_split(trim(name), ':') AS p FROM ({_NAMES})))"""
)
def program_name_parse(spark, sf_dir):
    rows = run(spark, sf_dir, _NAMES)
    out = rows.select("l_orderkey", "l_linenumber", names.parse_program_name(F.col("name")).alias("p")).select("l_orderkey", "l_linenumber", "p.*")
    return out.withColumn("diagnostics", F.array_join("diagnostics", ","))


@query("SELECT p_partkey, sha256(concat_ws(chr(31), 'PROD', p_brand, p_type, CAST(p_partkey AS VARCHAR))) AS key FROM part")
def stable_keys(spark, sf_dir):
    rows = run(spark, sf_dir, "select p_partkey, p_brand, p_type from part")
    return rows.select("p_partkey", names.stable_key(F.lit("PROD"), "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("key"))


@query("""SELECT p_partkey, sha256(concat('{"brand":', CAST(to_json(p_brand) AS VARCHAR), ',"size":', CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'null' END, ',"type":', CAST(to_json(p_type) AS VARCHAR), '}')) AS hash FROM part""")
def source_hashes(spark, sf_dir):
    rows = run(spark, sf_dir, "select p_partkey, p_brand, p_type, case when p_size % 2 = 0 then p_size end as p_size from part")
    return rows.select("p_partkey", names.source_hash({"type": F.col("p_type"), "brand": F.col("p_brand"), "size": F.col("p_size")}).alias("hash"))


_TIMES = "select event_id, concat(cast(cast(ts as date) as varchar(20)), case when event_id % 2 = 0 then 'T' else ' ' end, '10:20:30', case event_id % 3 when 0 then '.5' when 1 then '.123456' else '' end, case event_id % 5 when 0 then 'Z' when 1 then '+08' when 2 then '+0800' when 3 then '-03:00' else '' end) as t from events"


@query(f"SELECT event_id, CASE WHEN event_id % 5 < 4 THEN epoch_us(CAST(regexp_replace(regexp_replace(t, '([+-]\\d\\d)(\\d\\d)$', '\\1:\\2'), '([+-]\\d\\d)$', '\\1:00') AS TIMESTAMPTZ)) END AS micros FROM ({_TIMES})".replace("event_id % 5 < 4 THEN", "event_id % 5 < 4 THEN"))
def timestamp_normalize(spark, sf_dir):
    return run(spark, sf_dir, _TIMES).select("event_id", F.unix_micros(names.normalize_timestamp_text(F.col("t"))).alias("micros"))


_CLOCK = "select event_id, concat(cast(event_id % 30 as varchar(5)), ':', lpad(cast(event_id % 70 as varchar(5)), 2, '0'), case when event_id % 2 = 0 then ':07' else '' end) as t from events"


@query(f"SELECT event_id, CASE WHEN event_id % 70 < 60 THEN CAST((event_id % 30) * 3600 + (event_id % 70) * 60 + CASE WHEN event_id % 2 = 0 THEN 7 ELSE 0 END AS INTEGER) END AS seconds FROM ({_CLOCK})")
def schedule_seconds(spark, sf_dir):
    return run(spark, sf_dir, _CLOCK).select("event_id", names.schedule_seconds(F.col("t")).alias("seconds"))


@query(f"SELECT DISTINCT replace(replace(upper(target), 'DWS_DWF.', 'DWF.'), 'DWS_DWD.', 'DWD.') AS name, TRUE AS business FROM {duck('sql_side')} t")
def comparison_names(spark, sf_dir):
    rows = relation(spark, sf_dir, "sql_side").select(names.comparison_name(F.col("target")).alias("name")).distinct()
    return rows.withColumn("business", names.is_business(F.col("name")))
