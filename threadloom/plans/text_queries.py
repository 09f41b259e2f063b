"""Registered queries on texts: extraction, search, rules, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import sqltext
from threadloom.operators import audit, lint
from threadloom.plans.registry import Registry
from threadloom.plans.relations import duck, relation, run

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql

_S = duck("scripts")


@query(f"SELECT l_orderkey, l_linenumber, concat('DWF.S', regexp_extract(script, 'DWF[.]S(\\d+)', 1), ',DWD.SEED,DWF.R', l_linenumber) AS sources FROM {_S} t".replace("concat('DWF.S', regexp_extract(script, 'DWF[.]S(\\d+)', 1), ',DWD.SEED,DWF.R', l_linenumber)", "concat('DWD.SEED,DWF.S', regexp_extract(script, 'DWF[.]S(\\d+)', 1), ',DWF.R', CAST(l_linenumber AS VARCHAR))"))
def source_tables(spark, sf_dir):
    return relation(spark, sf_dir, "scripts").select("l_orderkey", "l_linenumber", F.array_join(sqltext.source_tables(F.col("script")), ",").alias("sources"))


@query(
    f"""SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(m, '(?i)\\b(?:FROM|JOIN|USING)\\s+([A-Za-z0-9_.]+)', 1), regexp_extract_all(m, '(?i)\\bINSERT\\s+INTO\\s+([A-Za-z0-9_.]+)', 1)), lambda x: upper(x)), lambda x: NOT starts_with(x, 'C') AND x <> 'DUAL'))), ',') AS tables
    FROM (SELECT *, regexp_replace(script, '''[^'']*''', '''''', 'g') AS m FROM {_S} t)"""
)
def sql_tables(spark, sf_dir):
    return relation(spark, sf_dir, "scripts").select("l_orderkey", "l_linenumber", F.array_join(sqltext.all_tables(F.col("script")), ",").alias("tables"))


@query(f"SELECT l_orderkey, l_linenumber, concat('C', CAST(l_linenumber AS VARCHAR)) AS ctes FROM {_S} t")
def cte_names(spark, sf_dir):
    return relation(spark, sf_dir, "scripts").select("l_orderkey", "l_linenumber", F.array_join(sqltext.cte_names(F.col("script")), ",").alias("ctes"))


_STATEMENTS = """select l_orderkey, l_linenumber, concat(case l_linenumber % 7 when 0 then 'insert overwrite table dwf.t' when 1 then 'CREATE TEMP TABLE IF NOT EXISTS tmp_' when 2 then 'create or replace view v.x' when 3 then 'MERGE INTO dwm.m'
    when 4 then 'update dwm.u' when 5 then 'select ''insert into fake'' from s' else 'vacuum ' end, cast(l_partkey as varchar(20)), ' set a = 1') as script from lineitem"""


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 'INSERT_OVERWRITE' WHEN 1 THEN 'CREATE_TABLE' WHEN 2 THEN 'CREATE_VIEW' WHEN 3 THEN 'MERGE' WHEN 4 THEN 'UPDATE' WHEN 5 THEN 'SELECT' ELSE 'UNKNOWN' END AS statement_type,
    CASE WHEN l_linenumber % 7 < 5 THEN upper(regexp_extract(script, '(?i)(?:table if not exists|table|view|into|update) ([a-z_.0-9]+) set', 1)) END AS target, CASE WHEN l_linenumber % 7 = 0 THEN 'OVERWRITE' END AS insert_mode, l_linenumber % 7 = 1 AS is_temporary FROM ({_STATEMENTS})"""
)
def statement_class(spark, sf_dir):
    return run(spark, sf_dir, _STATEMENTS).select("l_orderkey", "l_linenumber", sqltext.statement_class(F.col("script")).alias("c")).select("l_orderkey", "l_linenumber", "c.*")


_PAIRS = "select p_partkey, concat('INSERT INTO dwf.t (a, b', case when p_size % 2 = 0 then ', c' else '' end, ') SELECT x.a1, b', cast(p_size as varchar(10)), case when p_size % 3 = 0 then ', max(z)' when p_size % 2 = 0 then ', c9' else '' end, ' FROM s x') as script from part"


@query(
    f"""SELECT p_partkey, t AS target, s AS source FROM (SELECT p_partkey, unnest(CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN [['a', 'x.a1'], ['b', concat('b', CAST(p_size AS VARCHAR))]] WHEN p_size % 2 = 0 THEN [['a', 'x.a1'], ['b', concat('b', CAST(p_size AS VARCHAR))], ['c', 'c9']]
    WHEN p_size % 3 = 0 THEN [] ELSE [['a', 'x.a1'], ['b', concat('b', CAST(p_size AS VARCHAR))]] END) AS p, p[1] AS t, p[2] AS s FROM part)"""
)
def insert_column_pairs(spark, sf_dir):
    return run(spark, sf_dir, _PAIRS).select("p_partkey", F.explode(sqltext.insert_pairs(F.col("script"))).alias("q")).select("p_partkey", "q.target", "q.source")


_J = duck("jobs")


@query(f"SELECT job, CASE WHEN regexp_extract(deps, '^33:(JOB_\\d+)', 1) = regexp_extract(deps, 'X[|]33:(JOB_\\d+)', 1) THEN regexp_extract(deps, '^33:(JOB_\\d+)', 1) ELSE concat(regexp_extract(deps, '^33:(JOB_\\d+)', 1), ',', regexp_extract(deps, 'X[|]33:(JOB_\\d+)', 1)) END AS deps FROM {_J} t")
def dependency_list(spark, sf_dir):
    return relation(spark, sf_dir, "jobs").select("job", F.array_join(sqltext.dependency_list(F.col("deps")), ",").alias("deps"))


_DATES = "select l_orderkey, l_linenumber, concat('where d >= ''', cast(cast(l_shipdate as date) as varchar(20)), ''' and e < ''', case when l_linenumber % 2 = 0 then '20230231' else '19990430' end, ''' or f = ''18991231'' or g = ''', replace(cast(cast(l_shipdate as date) as varchar(20)), '-', ''), '''') as script from lineitem"


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_concat([CAST(CAST(l_shipdate AS DATE) AS VARCHAR)], CASE WHEN l_linenumber % 2 = 0 THEN [] ELSE ['1999-04-30'] END))), ',') AS dates FROM lineitem")
def hardcoded_dates(spark, sf_dir):
    return run(spark, sf_dir, _DATES).select("l_orderkey", "l_linenumber", F.array_join(sqltext.hardcoded_dates(F.col("script")), ",").alias("dates"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS breaks, CASE WHEN text IS NULL OR NOT contains(text, chr(10)) THEN 'Unknown' WHEN ends_with(split_part(text, chr(10), 1), chr(13)) THEN 'DOS' ELSE 'Unix' END AS line_ending FROM documents")
def line_endings(spark, sf_dir):
    from threadloom.functions.names import line_ending

    return run(spark, sf_dir, "select doc_id, text from documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n")))).alias("breaks"), line_ending(F.col("text")).alias("line_ending"))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, lang AS label FROM documents WHERE contains(upper(text), 'THE') AND contains(upper(text), 'HAND') AND source <> 'src0'")
def search_all_tokens(spark, sf_dir):
    return lint.search(run(spark, sf_dir, "select doc_id, lang, text, source from documents"), "doc_id", "text", ["the", "Hand"], F.col("lang"), exclude=F.col("source") == "src0")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS name, 'document' AS label FROM documents WHERE contains(regexp_replace(upper(text), '\\s', '', 'g'), 'THEAND') UNION SELECT CAST(page_id AS VARCHAR), 'page' FROM pages WHERE contains(regexp_replace(upper(html), '\\s', '', 'g'), 'THEAND')"""
)
def search_union(spark, sf_dir):
    a = lint.search(run(spark, sf_dir, "select doc_id, text from documents"), "doc_id", "text", ["theand"], F.lit("document"), squeeze=True)
    return a.unionByName(lint.search(run(spark, sf_dir, "select page_id, html from pages"), "page_id", "html", ["theand"], F.lit("page"), squeeze=True))


@query("SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50 AND l_linenumber = 7) AS has_downstream FROM supplier")
def has_downstream(spark, sf_dir):
    return lint.has_downstream(run(spark, sf_dir, "select s_suppkey from supplier"), "s_suppkey", run(spark, sf_dir, "select l_suppkey from lineitem where l_quantity = 50 and l_linenumber = 7"), "l_suppkey")


@query("SELECT doc_id, word FROM documents, (SELECT unnest(['license', 'password', 'token', 'worthless']) AS word) w WHERE contains(upper(text), upper(word))")
def sensitive_keywords(spark, sf_dir):
    return lint.keyword_hits(run(spark, sf_dir, "select doc_id, text from documents"), "doc_id", "text", ["license", "password", "token", "worthless"])


_DDL = "select p_partkey, concat(case p_size % 6 when 0 then 'DWF.F_' when 1 then 'dwm.m_' when 2 then 'DWA.X_' when 3 then 'DWD.RMD_' when 4 then 'TMP.' else 'ODS.' end, replace(upper(p_type), ' ', '_'), '_', cast(p_size as varchar(10))) as name, p_size % 10 = 5 as is_temp from part"


@query(f"SELECT p_partkey, CASE WHEN (is_temp OR name LIKE 'TMP.%') AND split_part(upper(name), '.', 2) NOT LIKE 'TMP!_%' ESCAPE '!' THEN 'TMP_' WHEN is_temp OR name LIKE 'TMP.%' THEN NULL WHEN name LIKE 'DWA.X%' THEN 'A_' END AS expected FROM ({_DDL})")
def ddl_naming(spark, sf_dir):
    return run(spark, sf_dir, _DDL).select("p_partkey", lint.naming_problem(F.col("name"), F.col("is_temp")).alias("expected"))


@query(
    f"""WITH n AS (SELECT DISTINCT name FROM ({_DDL})), t AS (SELECT DISTINCT name, unnest(string_split(regexp_replace(split_part(upper(name), '.', 2), CASE WHEN upper(name) LIKE 'DWM.%' THEN '^M_' ELSE '^A_' END, ''), '_')) AS root FROM n WHERE upper(name) LIKE 'DWM.%' OR upper(name) LIKE 'DWA.%')
    SELECT name, root FROM t WHERE root <> '' AND NOT regexp_full_match(root, '\\d+') AND root NOT IN (SELECT upper(n_name) FROM nation UNION SELECT 'X')"""
)
def term_roots_missing(spark, sf_dir):
    return lint.missing_roots(run(spark, sf_dir, _DDL).select("name").distinct(), run(spark, sf_dir, "select upper(n_name) as root from nation union select 'X'"))


_SCRIPT = """select l_orderkey * 10 + l_linenumber as id, concat('select ', case when l_linenumber % 2 = 0 then 'distinct ' else '' end, case when l_linenumber % 3 = 0 then 'nvl( nvl(a, b), c)' else 'coalesce(coalesce(a, b), c)' end, ' from t where x = ( select 1) and y in (select 2)',
    case when l_quantity > 30 then ' and d = ''20240101''' else '' end, case when l_returnflag = 'R' then ' and a.k = b.k (+)' else '' end) as script from lineitem"""


@query(
    f"""WITH s AS (SELECT * FROM ({_SCRIPT})) SELECT id, rule FROM (SELECT id, unnest(['EQUALS_SUBQUERY', 'IN_SUBQUERY', CASE WHEN contains(script, 'distinct') THEN 'DISTINCT' END, CASE WHEN contains(script, 'coalesce(coalesce(') THEN 'NESTED_NULL_FUNCTION' END, CASE WHEN contains(script, '20240101') THEN 'HARDCODED_DATE' END, CASE WHEN contains(script, '(+)') THEN 'OLD_JOIN' END]) AS rule FROM s) WHERE rule IS NOT NULL"""
)
def script_rules(spark, sf_dir):
    return lint.script_issues(run(spark, sf_dir, _SCRIPT), "id", "script")


_JOBS = "select concat(case when o_orderkey % 50 = 0 then 'j' else 'J' end, cast(o_orderkey as varchar(20))) as job, case when o_custkey % 9 = 0 then 'OTHER' else 'BATCH_DOMAIN' end as domain, o_orderstatus <> 'P' as enabled, cast(substr(o_orderpriority, 1, 1) as int) * 2 as priority, concat('T', cast(o_orderkey % 7000 as varchar(20))) as output from orders"
_JOB_DEPS = "select concat(case when o_orderkey % 50 = 0 then 'j' else 'J' end, cast(o_orderkey as varchar(20))) as job, concat(case when o_orderkey % 50 = 0 then 'j' else 'J' end, cast(case when o_orderkey % 11 = 0 then o_orderkey else o_custkey * 3 end as varchar(20))) as dep from orders"


@query(
    f"""WITH j AS (SELECT * FROM ({_JOBS})), d AS (SELECT * FROM ({_JOB_DEPS})), o AS (SELECT concat('J', CAST(c_custkey AS VARCHAR)) AS job FROM customer WHERE c_custkey % 2 = 0)
    SELECT job, 'CASE' AS rule FROM j WHERE job <> upper(job) UNION SELECT job, 'DISABLED' FROM j WHERE NOT enabled UNION SELECT job, 'DOMAIN' FROM j WHERE domain = 'OTHER' UNION SELECT job, 'PRIORITY' FROM j WHERE priority > 9
    UNION SELECT job, 'SELF_DEPENDENCY' FROM d WHERE job = dep UNION SELECT job, 'UNKNOWN_DEPENDENCY' FROM d WHERE dep NOT IN (SELECT job FROM j UNION SELECT job FROM o)
    UNION SELECT job, 'OUTPUT_CLASH' FROM j WHERE output IN (SELECT output FROM j GROUP BY output HAVING count(DISTINCT job) > 1)"""
)
def schedule_rules(spark, sf_dir):
    online = run(spark, sf_dir, "select concat('J', cast(c_custkey as string)) as job from customer where c_custkey % 2 = 0")
    return lint.schedule_issues(run(spark, sf_dir, _JOBS), run(spark, sf_dir, _JOB_DEPS), online)


@query(
    """SELECT p.plan, s.seq, j.job, concat_ws(',', CASE WHEN s.seq IS NULL THEN 'seq' END, CASE WHEN j.job IS NULL THEN 'job' END) AS missing FROM (SELECT CAST(c_custkey AS VARCHAR) AS plan FROM customer) p
    LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS k, CAST(min(o_orderkey) AS VARCHAR) AS seq FROM orders GROUP BY 1) s ON s.k = p.plan
    LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS k, max(l_returnflag) AS job FROM lineitem WHERE l_quantity > 30 GROUP BY 1) j ON j.k = coalesce(s.seq, p.plan)"""
)
def wide_chain_summary(spark, sf_dir):
    seq = run(spark, sf_dir, "select cast(o_custkey as string) as key, cast(min(o_orderkey) as string) as value from orders group by 1")
    job = run(spark, sf_dir, "select cast(l_orderkey as string) as key, max(l_returnflag) as value from lineitem where l_quantity > 30 group by 1")
    return lint.chain_summary(run(spark, sf_dir, "select cast(c_custkey as string) as plan from customer"), [("seq", seq), ("job", job)])


_P = f"WITH RECURSIVE e AS (SELECT program, src, dst FROM {duck('program_edges')} t)"


@query(_P + " SELECT DISTINCT program, 'SELF_REFERENCE' AS issue_type, src AS node FROM e WHERE src = dst")
def self_reference(spark, sf_dir):
    return audit.self_references(relation(spark, sf_dir, "program_edges"))


_SINKS = ", s AS (SELECT DISTINCT program, dst AS sink FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.program = e.program AND x.src = e.dst AND x.src <> x.dst))"


@query(_P + _SINKS + " SELECT program, 'MULTI_SINK_CANDIDATE' AS issue_type, sink AS node FROM s WHERE program IN (SELECT program FROM s GROUP BY program HAVING count(*) > 1)")
def multi_sink(spark, sf_dir):
    return audit.multi_sinks(relation(spark, sf_dir, "program_edges"))


@query(
    _P
    + _SINKS
    + """, t AS (SELECT concat('G', CAST(s_suppkey AS VARCHAR)) AS program, concat('T', CAST(s_suppkey % 97 AS VARCHAR)) AS target FROM supplier), w AS (SELECT t.* FROM t WHERE EXISTS (SELECT 1 FROM e WHERE e.program = t.program AND e.dst = t.target)),
    up AS (SELECT program, target AS node FROM w UNION SELECT up.program, e.src FROM up JOIN e ON e.program = up.program AND e.dst = up.node)
    SELECT program, 'ORPHAN_BRANCH' AS issue_type, sink AS node FROM s WHERE program IN (SELECT program FROM w) AND NOT EXISTS (SELECT 1 FROM up WHERE up.program = s.program AND up.node = s.sink)"""
)
def orphan_branches(spark, sf_dir):
    expected = run(spark, sf_dir, "select concat('G', cast(s_suppkey as string)) as program, concat('T', cast(s_suppkey % 97 as string)) as target from supplier")
    return audit.orphan_branches(relation(spark, sf_dir, "program_edges"), expected)


@query(
    _P
    + """, t AS (SELECT concat('G', CAST(s_suppkey AS VARCHAR)) AS program, concat('T', CAST(s_suppkey % 120 AS VARCHAR)) AS target FROM supplier)
    SELECT program, 'TARGET_NOT_FOUND' AS issue_type, target AS node FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.program = t.program AND e.dst = t.target) AND program NOT IN (SELECT concat('G', CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_suppkey % 10 = 0)"""
)
def target_problems(spark, sf_dir):
    expected = run(spark, sf_dir, "select concat('G', cast(s_suppkey as string)) as program, concat('T', cast(s_suppkey % 120 as string)) as target from supplier")
    dynamic = run(spark, sf_dir, "select concat('G', cast(s_suppkey as string)) as program from supplier where s_suppkey % 10 = 0")
    return audit.target_problems(relation(spark, sf_dir, "program_edges"), expected, dynamic)


@query(
    _P
    + """, i AS (SELECT DISTINCT program, 'SELF_REFERENCE' AS issue_type, src AS node, 'HIGH' AS severity, sha256(concat_ws(chr(31), program, 'SELF_REFERENCE', src)) AS stable_key FROM e WHERE src = dst)
    SELECT *, CASE WHEN program LIKE '%7' THEN 'ACCEPTED' ELSE 'OPEN' END AS disposition FROM i"""
)
def audit_policy(spark, sf_dir):
    issues = audit.self_references(relation(spark, sf_dir, "program_edges"))
    manual = audit.with_policy(issues, spark.createDataFrame([], "stable_key string, disposition string")).where("program like '%7'").select("stable_key", F.lit("ACCEPTED").alias("disposition"))
    return audit.with_policy(issues, manual)
