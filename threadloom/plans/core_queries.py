"""Registered queries of the SQL grammar on mixed statements, of program compositions and of small operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import names, sqltext
from threadloom.operators import audit, extract, facts, graph, lint, metadata, reconcile, snapshot
from threadloom.plans.registry import Registry
from threadloom.plans.relations import duck, relation, run

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql

# -- statements of many shapes; the expected facts are put together from the row's own names, not read from the text

_S = "cast(l_suppkey as varchar(20))"
_T = "cast(l_partkey as varchar(20))"
_NAMES = f"concat('dwf.t', {_T}) as t, concat('dwd.s', {_S}) as s, concat('DWM.r', cast(l_linenumber as varchar(20))) as r, concat('c', {_S}) as c"
_SHAPES = [
    """concat('insert into "', split_part(t, '.', 1), '"."', split_part(t, '.', 2), '" (a) select x, ''it''''s from lies'' from `', split_part(s, '.', 1), '`.`', split_part(s, '.', 2), '` -- from hidden')""",
    """concat('INSERT OVERWRITE TABLE [dwf].[', split_part(t, '.', 2), '] select extract(day from d), trim(both ''x'' from y) from ', s, ' x join ', r, ' on x.k = k')""",
    """concat('create temp table if not exists tmp_', c, ' as with ', c, ' as (select 1 from ', s, '), d (k) as materialized (select k from ', c, ') select * from d left join ', r, ' using (k)')""",
    """concat('create or replace view ', t, ' as select * from only ', s, ' where a in (select b from ', r, ')')""",
    """concat('merge into dwf . ', split_part(t, '.', 2), ' using ', s, ' s on 1 = 1 /* from ', r, ' */ when matched then update set a = 1')""",
    """concat('update only ', t, ' set a = 1 from ', s, ' where exists (select 1 from ', r, ')')""",
    """concat('select ''insert into fake'' from ', s, ' cross join generate_series(1, 2) g, lateral (select 1 from ', r, ') l')""",
    """concat('insert into {schema}.', split_part(t, '.', 2), ' select * from ', s)""",
    """concat('delete from ', t, ' where k in (select k from ', s, ')')""",
    """concat('truncate table ', t)""",
    """concat('create materialized view ', t, ' as select * from ', s, ' union all select * from dwd.', split_part(r, '.', 2), '; ')""",
    """concat('insert into ', t, ' select * from ', s, ' join $stage#1 on true join {dynamic} on true')""",
    """concat('insert into ', t, ' select ''it', chr(92), '''s from lies'' as x from ', s, ' where y = ''from hidden''')""",
    """concat('select "a--b", `c/*d` from ', s, ' join ', r, ' on 1 = 1')""",
    """concat('create table ', t, ' as select extract(day from max(coalesce(d, e))), substring(trim(both x from y) from 2) from ', s)""",
    """concat('delete from ', r, '; insert into ', t, ' select * from ', s, '; drop table if exists tmp_', c)""",
]
_STATEMENTS = f"select id, shape, t, s, r, c, case shape {' '.join(f'when {k} then {v}' for k, v in enumerate(_SHAPES))} end as script from (select l_orderkey * 10 + l_linenumber as id, (l_partkey + l_linenumber) % {len(_SHAPES)} as shape, {_NAMES} from lineitem) x"
_UP = f"(SELECT id, shape, upper(t) AS t, upper(s) AS s, upper(r) AS r, upper(c) AS c FROM ({_STATEMENTS}))"


def _mixed(spark, sf_dir):
    return run(spark, sf_dir, _STATEMENTS)


@query(
    f"""SELECT id, CASE shape WHEN 0 THEN s WHEN 1 THEN concat(s, ',', r) WHEN 2 THEN concat(s, ',', r) WHEN 3 THEN concat(s, ',', r) WHEN 4 THEN s WHEN 5 THEN concat(s, ',', r) WHEN 6 THEN concat(s, ',', r) WHEN 7 THEN s WHEN 8 THEN concat(t, ',', s) WHEN 9 THEN ''
    WHEN 10 THEN concat(s, ',DWD.', split_part(r, '.', 2)) WHEN 11 THEN concat(s, ',$STAGE#1') WHEN 13 THEN concat(s, ',', r) WHEN 15 THEN concat(r, ',', s) ELSE s END AS sources FROM {_UP}"""
)
def mixed_sources(spark, sf_dir):
    """H6, H7."""
    return _mixed(spark, sf_dir).select("id", F.array_join(sqltext.source_tables(F.col("script")), ",").alias("sources"))


@query(
    f"""SELECT id, array_to_string(list_sort(CASE shape WHEN 0 THEN [t, s] WHEN 1 THEN [t, s, r] WHEN 2 THEN ['TMP_' || c, s, r] WHEN 3 THEN [t, s, r] WHEN 4 THEN [t, s] WHEN 5 THEN [t, s, r] WHEN 6 THEN [s, r] WHEN 7 THEN [s] WHEN 8 THEN [t, s] WHEN 9 THEN [t]
    WHEN 10 THEN [t, s, 'DWD.' || split_part(r, '.', 2)] WHEN 11 THEN [t, s, '$STAGE#1'] WHEN 13 THEN [s, r] WHEN 15 THEN [t, s, r, 'TMP_' || c] ELSE [t, s] END), ',') AS tables FROM {_UP}"""
)
def mixed_tables(spark, sf_dir):
    """H14."""
    return _mixed(spark, sf_dir).select("id", F.array_join(sqltext.all_tables(F.col("script")), ",").alias("tables"))


@query(
    f"""SELECT id, CASE shape WHEN 0 THEN 'INSERT_INTO' WHEN 1 THEN 'INSERT_OVERWRITE' WHEN 2 THEN 'CREATE_TABLE' WHEN 3 THEN 'CREATE_VIEW' WHEN 4 THEN 'MERGE' WHEN 5 THEN 'UPDATE' WHEN 9 THEN 'UNKNOWN' WHEN 10 THEN 'CREATE_VIEW' WHEN 11 THEN 'INSERT_INTO' WHEN 12 THEN 'INSERT_INTO' WHEN 14 THEN 'CREATE_TABLE' WHEN 15 THEN 'INSERT_INTO' ELSE 'SELECT' END AS statement_type,
    CASE WHEN shape IN (0, 1, 3, 4, 5, 10, 11, 12, 14, 15) THEN t WHEN shape = 2 THEN 'TMP_' || c END AS target, CASE WHEN shape IN (0, 11, 12, 15) THEN 'INTO' WHEN shape = 1 THEN 'OVERWRITE' END AS insert_mode, shape = 2 AS is_temporary FROM {_UP}"""
)
def mixed_classes(spark, sf_dir):
    """H4."""
    return _mixed(spark, sf_dir).select("id", sqltext.statement_class(F.col("script")).alias("k")).select("id", "k.*")


@query(f"SELECT id, CASE WHEN shape = 2 THEN c || ',D' ELSE '' END AS ctes, CASE WHEN shape = 7 THEN 'INSERT' END AS dynamic_target FROM {_UP}")
def mixed_ctes(spark, sf_dir):
    """H5, H10."""
    return _mixed(spark, sf_dir).select("id", F.array_join(sqltext.cte_names(F.col("script")), ",").alias("ctes"), sqltext.dynamic_target(F.col("script")).alias("dynamic_target"))


@query(f"SELECT id, shape IN (6, 13) AS read_only FROM {_UP}")
def read_only_statements(spark, sf_dir):
    """C8."""
    return _mixed(spark, sf_dir).select("id", sqltext.is_read_only(F.col("script")).alias("read_only"))


_PREDICATES = """select l_orderkey * 10 + l_linenumber as id, concat(case when l_partkey % 3 = 0 then '(a.x = b.x) AND ' else '' end, cast(l_suppkey % 4 as varchar(9)), case when l_linenumber % 2 = 0 then ' = ' else ' <> ' end, cast(l_partkey % 4 as varchar(9)), '.0',
    case l_linenumber when 3 then ' or b' when 4 then ' and not true' when 5 then ' and TRUE = FALSE' when 6 then ' and f(x and 1 = 2)' else ' and y = ''1 = 2''' end) as predicate from lineitem"""


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber IN (3, 6) THEN false WHEN l_linenumber IN (4, 5) THEN true ELSE (l_suppkey % 4 = l_partkey % 4) = (l_linenumber % 2 = 1) END AS is_false FROM lineitem")
def false_predicates(spark, sf_dir):
    """C7."""
    return run(spark, sf_dir, _PREDICATES).select("id", sqltext.is_statically_false(F.col("predicate")).alias("is_false"))


_DEFINITIONS = """select p_partkey, concat('-- create table no (a int)', chr(10), 'create ', case p_size % 4 when 0 then 'global temporary ' when 1 then 'unlogged ' when 2 then 'temp ' else '' end, 'table ', case when p_size % 3 = 0 then 'if not exists ' else '' end, '"dwf".t', cast(p_partkey as varchar(20)),
    case when p_size % 5 = 0 then ' as select 1' else ' (a int comment ''create table x (b int)'')' end, '; create table dwm.u (a int); alter table only dwm.v', cast(p_size as varchar(9)), ' add b int; ALTER TABLE dwa.w drop a') as ddl from part"""


@query(
    f"""SELECT p_partkey, concat(CASE WHEN contains(ddl, ' as select') THEN '' ELSE concat('DWF.T', p_partkey, CASE WHEN contains(ddl, 'temp') THEN ':true' ELSE ':false' END, ',') END, 'DWM.U:false') AS defined, concat('DWA.W,DWM.V', regexp_extract(ddl, 'dwm[.]v([0-9]+)', 1)) AS altered FROM ({_DEFINITIONS})"""
)
def defined_objects(spark, sf_dir):
    """Tables with their temporary flag, and what is altered."""
    defined = F.transform(sqltext.defined_tables(F.col("ddl")), lambda t: F.concat(t["name"], F.lit(":"), t["temporary"].cast("string")))
    return run(spark, sf_dir, _DEFINITIONS).select("p_partkey", F.array_join(defined, ",").alias("defined"), F.array_join(sqltext.altered_tables(F.col("ddl")), ",").alias("altered"))


_E_LAYER = "select p_partkey, concat(case p_size % 5 when 0 then 'DWE.X' when 1 then 'dws_dwe.X' when 2 then 'DWS_DWP.DWE_X' when 3 then 'DWE_X' else 'DWP.DWE_X' end, cast(p_partkey as varchar(20))) as name from part"


@query(
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE p_size % 5 WHEN 0 THEN ['DWE.X' || k, 'X' || k, 'DWS_DWE.X' || k, 'DWP.DWE_X' || k, 'DWE_X' || k] WHEN 1 THEN ['DWS_DWE.X' || k, 'X' || k, 'DWE.X' || k, 'DWP.DWE_X' || k]
    WHEN 2 THEN ['DWS_DWP.DWE_X' || k, 'DWE_X' || k, 'DWP.DWE_X' || k, 'DWS_DWE.X' || k, 'DWE.X' || k] WHEN 3 THEN ['DWE_X' || k, 'DWS_DWE_X' || k, 'DWS_DWE.X' || k, 'DWE.X' || k] ELSE ['DWP.DWE_X' || k, 'DWE_X' || k, 'DWS_DWP.DWE_X' || k, 'DWS_DWE.X' || k, 'DWE.X' || k] END)), ',') AS aliases
    FROM (SELECT p_partkey, p_size, CAST(p_partkey AS VARCHAR) AS k FROM part)"""
)
def layer_aliases(spark, sf_dir):
    """Forms of the E layer."""
    return run(spark, sf_dir, _E_LAYER).select("p_partkey", F.array_join(F.array_sort(names.table_aliases(F.col("name"))), ",").alias("aliases"))


_COMMENTED = "select p_partkey, concat('a', cast(p_size as varchar(9)), ' -- note ', p_name, chr(10), '/* ', p_type, ' */ b ''-- kept ', p_brand, '''') as script from part"


@query(f"SELECT p_partkey, concat('a', p_size, ' ', repeat(' ', length('-- note ') + length(p_name)), chr(10), repeat(' ', length(p_type) + 6), ' b ''-- kept ', p_brand, '''') AS stripped FROM part")
def comments_stripped(spark, sf_dir):
    """H2."""
    return extract.uncommented(run(spark, sf_dir, _COMMENTED), ["p_partkey"], "script")


_NESTED = """select p_partkey, concat('insert into t select a from dwd.x', cast(p_size as varchar(9)), ' where a in (select b from dwf.y where c in (select d from dwm.z where 1 = ', case when p_size % 3 = 0 then '2' else '1' end, ') and ',
    case when p_size % 2 = 0 then 'false' else '2 > 1' end, ') union all select e from dwa.w', case when p_size % 5 = 0 then ' where false' else '' end) as script from part"""


@query(
    """SELECT p_partkey, array_to_string(list_sort(list_concat([concat('DWD.X', p_size)], CASE WHEN p_size % 2 = 0 THEN [] WHEN p_size % 3 = 0 THEN ['DWF.Y'] ELSE ['DWF.Y', 'DWM.Z'] END, CASE WHEN p_size % 5 = 0 THEN [] ELSE ['DWA.W'] END)), ',') AS sources FROM part"""
)
def live_sources(spark, sf_dir):
    """H9 at any depth: a block counts unless it or a block around it is statically empty."""
    return extract.live_sources(run(spark, sf_dir, _NESTED), ["p_partkey"], "script")


_PROGRAMS = """select p_partkey, p_size % 7 as shape, case p_size % 7 when 0 then concat('sql = "select 1 from a', cast(p_size as varchar(9)), '"', chr(10), 'run_sql(sql)', chr(10), 'sql = "select 2 from b"', chr(10), 'run_sql(sql)')
    when 1 then 'run_sql(make())' when 2 then 'print(1)' when 3 then concat('def f(:', chr(10), ' x = \"\"\"select 3 from c', cast(p_size as varchar(9)), '\"\"\"') when 4 then concat('insert into t select 1 from d', cast(p_size as varchar(9))) when 5 then ' '
    else 'db.execute(f"insert into {name} select 1 from e")' end as script from part"""


@query(
    f"""SELECT p_partkey, CASE shape WHEN 0 THEN 'SUCCESS' WHEN 3 THEN 'SUCCESS' WHEN 4 THEN 'SUCCESS' ELSE 'UNRESOLVED' END AS status, CASE shape WHEN 0 THEN 'HIGH' WHEN 3 THEN 'CONSERVATIVE' WHEN 4 THEN 'HIGH' ELSE 'NONE' END AS confidence,
    CASE shape WHEN 0 THEN 'CANDIDATE_FOUND' WHEN 1 THEN 'SQL_ARGUMENT_DYNAMIC' WHEN 2 THEN 'NO_SQL_CANDIDATE' WHEN 3 THEN 'PYTHON_PARSE_RECOVERED' WHEN 4 THEN 'RAW_SQL' WHEN 5 THEN 'EMPTY_SCRIPT' ELSE 'SQL_ARGUMENT_DYNAMIC' END AS reason,
    CAST(CASE shape WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS INTEGER) AS candidates FROM ({_PROGRAMS})"""
)
def analysis_envelopes(spark, sf_dir):
    """H13, H12."""
    return extract.envelopes(run(spark, sf_dir, _PROGRAMS), ["p_partkey"], "script")


@query(
    """SELECT p_partkey, k AS position, CASE k WHEN 0 THEN concat('select 1 from a', p_size) ELSE 'select 2 from b' END AS statement, 'CALL' AS reason FROM part, (SELECT unnest([0, 1]) AS k) WHERE p_size % 7 = 0
    UNION ALL SELECT p_partkey, 0, concat('select 3 from c', p_size), 'RECOVERED' FROM part WHERE p_size % 7 = 3 UNION ALL SELECT p_partkey, 0, concat('insert into t select 1 from d', p_size), 'RAW' FROM part WHERE p_size % 7 = 4
    UNION ALL SELECT p_partkey, 0, 'insert into {} select 1 from e', 'CALL' FROM part WHERE p_size % 7 = 6"""
)
def python_bindings(spark, sf_dir):
    """A name stands for what it was bound to last before the call."""
    return extract.programs_sql(run(spark, sf_dir, _PROGRAMS), ["p_partkey"], "script")


_DESCENT = """select p_partkey, concat(case when p_size % 2 = 0 then concat('WITH c AS (SELECT x.k AS a, y.v AS b FROM dwd.s', cast(p_size as varchar(9)), ' x, dwd.r y) ') else '' end, 'INSERT INTO dwf.t (a, b, d) SELECT q.a, q.b, w FROM ',
    case when p_size % 2 = 0 then 'c q' else concat('(SELECT k a, sum(v) AS b FROM (SELECT z.k, v FROM dwd.s', cast(p_size as varchar(9)), ' z) i) q') end, case when p_size % 3 = 0 then ' JOIN dwm.m ON q.a = m.a' else '' end) as script from part"""


@query(
    """SELECT p_partkey, 'DWF.T' AS target, n AS target_column, CASE WHEN n = 'A' THEN concat('DWD.S', p_size) WHEN n = 'B' AND p_size % 2 = 0 THEN 'DWD.R' END AS source, CASE WHEN n = 'A' THEN 'K' WHEN n = 'B' AND p_size % 2 = 0 THEN 'V' WHEN n = 'D' THEN 'W' END AS source_column,
    CASE WHEN n = 'A' OR (n = 'B' AND p_size % 2 = 0) THEN 'RESOLVED' WHEN n = 'D' AND p_size % 3 = 0 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS state FROM part, (SELECT unnest(['A', 'B', 'D']) AS n)"""
)
def column_descent(spark, sf_dir):
    """Columns through CTEs and subqueries."""
    return extract.column_lineage(run(spark, sf_dir, _DESCENT), ["p_partkey"], "script")


_BOOK = "select p_partkey as line, concat('select * from dwf.a', cast(p_size as varchar(9)), ' join dlo.b', cast(p_size % 3 as varchar(9)), ' on true join bare on true') as script from part"


@query("SELECT p_partkey AS line, t AS \"table\", CASE WHEN t LIKE 'DLO%' THEN 'TECHNICAL' WHEN t LIKE 'DWF%' THEN 'BUSINESS' ELSE 'UNCLASSIFIED' END AS class FROM part, LATERAL (SELECT unnest([concat('DWF.A', p_size), concat('DLO.B', p_size % 3), 'BARE']) AS t) u")
def workbook_tables(spark, sf_dir):
    """Tables and their class for each line of a sheet."""
    return lint.sheet_tables(run(spark, sf_dir, _BOOK), "line", "script")


# -- names

_JSON = """select p_partkey, concat('{"b": ', cast(p_size as varchar(9)), ', "a": {"d": "', p_brand, '", "c": null}}') as text from part"""


@query("SELECT p_partkey, concat('{\"a\":{\"c\":null,\"d\":\"', p_brand, '\"},\"b\":', p_size, '}') AS json FROM part")
def canonical_json(spark, sf_dir):
    """I12."""
    return run(spark, sf_dir, _JSON).select("p_partkey", names.canonical_json(F.col("text")).alias("json"))


@query("SELECT page_id, sha256(array_to_string(list_slice(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda c: c <> ''), -2, -1), '/')) AS hash FROM pages")
def address_hashes(spark, sf_dir):
    """I19."""
    return run(spark, sf_dir, "select page_id, url from pages").select("page_id", names.path_hash(F.col("url")).alias("hash"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[一-鿿]') UNION ALL SELECT -p_partkey FROM part WHERE p_size % 2 = 0")
def cjk_texts(spark, sf_dir):
    """I20."""
    rows = run(spark, sf_dir, "select doc_id, text from documents union all select -p_partkey, concat('x', case when p_size % 2 = 0 then '表' else 't' end) from part")
    return rows.where(names.has_cjk(F.col("text"))).select("doc_id")


@query(f"SELECT l_orderkey, l_linenumber, concat('DWM.T', l_partkey, ',DWD.SEED,DWF.S', l_suppkey, ',DWF.R', l_linenumber) AS layers, concat('DWF.S', l_suppkey, ',DWF.R', l_linenumber) AS upstream FROM lineitem")
def qualified_names(spark, sf_dir):
    """H17, H18."""
    x = F.col("script")
    upstream = sqltext.upstream_tables(x, F.lit("DWM.T1"), ("DWF",))
    return relation(spark, sf_dir, "scripts").select("l_orderkey", "l_linenumber", F.array_join(F.filter(sqltext.layer_names(x), lambda t: ~t.startswith("Z")), ",").alias("layers"), F.array_join(upstream, ",").alias("upstream"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN concat('DWF.F_', p_size) WHEN p_size % 3 = 1 THEN 'other' ELSE 'DWM.F_X' END AS bound FROM part"""
)
def bound_targets(spark, sf_dir):
    """J7."""
    rows = run(spark, sf_dir, "select p_partkey, case p_size % 3 when 0 then concat('f_', cast(p_size as string)) when 1 then 'other' else 'DWM.F_X' end as target, concat('dwf.f_', cast(p_size as string)) as authority from part")
    return rows.select("p_partkey", graph.bind_target(F.col("target"), F.col("authority")).alias("bound"))


# -- graphs of programs

_E = f"WITH RECURSIVE e AS (SELECT DISTINCT program, src, dst FROM {duck('program_edges')} t)"
_CHOICES = "select concat('G', cast(s_suppkey as varchar(20))) as program, case when s_suppkey % 3 > 0 then concat('T', cast(s_suppkey % 97 as varchar(20))) end as target from supplier"
_INCLUDED = f"""{_E}, ch AS ({_CHOICES}), up AS (SELECT program, target AS node FROM ch WHERE target IS NOT NULL AND EXISTS (SELECT 1 FROM e WHERE e.program = ch.program AND e.dst = ch.target) UNION SELECT up.program, e.src FROM up JOIN e ON e.program = up.program AND e.dst = up.node),
    n AS (SELECT program, src AS node FROM e UNION SELECT program, dst FROM e), i AS (SELECT * FROM up UNION SELECT n.* FROM n WHERE program NOT IN (SELECT program FROM ch WHERE target IS NOT NULL))"""


@query(_INCLUDED + " SELECT program, node FROM i")
def included_nodes(spark, sf_dir):
    """J14."""
    return graph.included(relation(spark, sf_dir, "program_edges"), run(spark, sf_dir, _CHOICES))


@query(
    _INCLUDED
    + """, x AS (SELECT e.* FROM e JOIN i a ON a.program = e.program AND a.node = e.src JOIN i b ON b.program = e.program AND b.node = e.dst), pw AS (SELECT program, src, dst AS pos, [src, dst] AS path FROM x WHERE src NOT IN ('T3', 'T13')
      UNION ALL SELECT pw.program, pw.src, x.dst, list_append(path, x.dst) FROM pw JOIN x ON x.program = pw.program AND x.src = pw.pos WHERE pw.pos IN ('T3', 'T13') AND (NOT list_contains(path, x.dst) OR (x.dst = pw.src AND x.dst NOT IN ('T3', 'T13'))))
    SELECT program, src, pos AS dst, count(*) AS paths, CAST(min(len(path)) - 1 AS BIGINT) AS depth FROM pw WHERE pos NOT IN ('T3', 'T13') GROUP BY ALL"""
)
def program_business_edges(spark, sf_dir):
    """Two temporary nodes, which may feed each other and themselves."""
    edges = relation(spark, sf_dir, "program_edges")
    nodes = edges.select("program", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return graph.program_edges(edges, nodes.withColumn("collapsible", F.col("node").isin("T3", "T13")), run(spark, sf_dir, _CHOICES))


@query(f"SELECT DISTINCT src, dst FROM {duck('edges_tree')} t WHERE dst IN ('DWM.P000000012', 'DWM.P000000099', 'none')")
def neighbour_edges(spark, sf_dir):
    """J5."""
    return graph.neighbours(relation(spark, sf_dir, "edges_tree"), ["DWM.P000000012", "DWM.P000000099", "none"], "up")


@query(_E + """, w AS (SELECT program, src, dst FROM e WHERE src <> dst UNION SELECT w.program, w.src, e.dst FROM w JOIN e ON e.program = w.program AND e.src = w.dst AND e.src <> e.dst), m AS (SELECT a.program, a.src AS node, min(a.dst) AS other FROM w a JOIN w b ON a.program = b.program AND a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY ALL)
    SELECT DISTINCT program, 'CYCLE_DETECTED' AS issue_type, least(node, other) AS node FROM m""")
def cycle_issues(spark, sf_dir):
    """K4."""
    return audit.cycles(relation(spark, sf_dir, "program_edges"))


_GROUPS = "select concat('J', cast(o_orderkey as varchar(20))) as program, concat('005:DWF.T', cast(o_custkey as varchar(20))) as name, case when o_custkey % 11 = 0 then 1 else row_number() over (partition by o_custkey order by o_orderkey) end as step, concat('T', cast(o_custkey as varchar(20))) as target from orders"
_FACTS = """select concat('J', cast(l_orderkey as varchar(20))) as program, case when o_custkey % 13 = 0 and l_linenumber = 1 then 'odd' else concat('005:DWF.T', cast(o_custkey as varchar(20))) end as name, case when l_linenumber = 1 then concat('S', cast(l_suppkey as varchar(20))) else concat('M', cast(o_custkey as varchar(20)), '_', cast(l_linenumber - 1 as varchar(20))) end as src,
    case when l_linenumber = 3 then concat('T', cast(o_custkey as varchar(20))) else concat('M', cast(o_custkey as varchar(20)), '_', cast(l_linenumber as varchar(20))) end as dst from lineitem join orders on o_orderkey = l_orderkey"""
_DIAGNOSED = f"""WITH RECURSIVE p AS ({_GROUPS}), e AS ({_FACTS}), f AS (SELECT e.*, p.target, p.name AS own FROM e JOIN p USING (program)), d AS (
      SELECT target, 'PROGRAM_BOUNDARY_DUPLICATE_STEP' AS diagnostic FROM p GROUP BY target HAVING count(DISTINCT step) < count(*)
      UNION SELECT target, 'PROGRAM_BOUNDARY_EDGE_PROVENANCE_MISMATCH' FROM f WHERE name <> own
      UNION SELECT target, 'PROGRAM_BOUNDARY_RESULT_NOT_OBSERVED' FROM p WHERE target NOT IN (SELECT target FROM f WHERE dst = target)
      UNION SELECT target, 'PROGRAM_BOUNDARY_RESULT_USED_AS_SOURCE' FROM f WHERE src = target AND dst <> target)"""


def _groups(spark, sf_dir):
    return run(spark, sf_dir, _GROUPS), run(spark, sf_dir, _FACTS)


@query(_DIAGNOSED + " SELECT target, diagnostic FROM d")
def boundary_problems(spark, sf_dir):
    """J16."""
    return graph.boundary_diagnostics(*_groups(spark, sf_dir))


@query(
    _DIAGNOSED
    + """, g AS (SELECT DISTINCT target AS grp, program, src, dst FROM f WHERE target NOT IN (SELECT target FROM d)), up AS (SELECT DISTINCT grp, grp AS node FROM g UNION SELECT up.grp, g.src FROM up JOIN g ON g.grp = up.grp AND g.dst = up.node), i AS (SELECT DISTINCT g.* FROM g JOIN up ON up.grp = g.grp AND up.node = g.dst)
    SELECT DISTINCT grp AS target, src, program, FALSE AS fallback FROM i WHERE src <> grp AND NOT EXISTS (SELECT 1 FROM i j WHERE j.grp = i.grp AND j.dst = i.src) UNION SELECT grp, src, program, FALSE FROM i WHERE src = grp AND dst = grp
    UNION SELECT e.dst, e.src, e.program, FALSE FROM e WHERE e.dst IN (SELECT target FROM p) AND e.dst NOT IN (SELECT target FROM d) AND NOT EXISTS (SELECT 1 FROM p WHERE p.program = e.program AND p.target = e.dst) UNION SELECT e.dst, e.src, e.program, TRUE FROM e WHERE e.dst IN (SELECT target FROM d)"""
)
def boundary_groups(spark, sf_dir):
    """With fallback to direct edges."""
    return graph.boundary_projections(*_groups(spark, sf_dir))


_STARTS = "select o_orderkey as start, cast(o_orderkey % 5 * 1000000 + o_orderkey as bigint) as place from orders where o_orderpriority like '1%'"


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_chain')} t), k AS (SELECT src AS n FROM e UNION SELECT dst FROM e), s AS (SELECT * FROM ({_STARTS}) WHERE start IN (SELECT n FROM k)), w AS (SELECT start, start AS node, 0 AS level FROM s UNION SELECT w.start, e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node),
    m AS (SELECT start, node, min(level) AS level FROM w GROUP BY ALL) SELECT node, start, CAST(level AS INTEGER) AS level FROM m JOIN s USING (start) QUALIFY row_number() OVER (PARTITION BY node ORDER BY CASE WHEN level = 0 THEN -1 ELSE place END, place) = 1"""
)
def dependents_first_start(spark, sf_dir):
    """J19."""
    return graph.dependents_of(relation(spark, sf_dir, "edges_chain"), run(spark, sf_dir, _STARTS))[0]


@query(f"WITH e AS (SELECT * FROM {duck('edges_chain')} t) SELECT start FROM ({_STARTS}) WHERE start NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def dependents_not_found(spark, sf_dir):
    """J19."""
    return graph.dependents_of(relation(spark, sf_dir, "edges_chain"), run(spark, sf_dir, _STARTS))[1]


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_chain')} t), st AS (SELECT o_orderkey AS n FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT max(o_orderkey) AS start FROM orders GROUP BY o_custkey),
    w AS (SELECT start, start AS node, 0 AS level FROM s UNION SELECT w.start, e.src, w.level + 1 FROM w JOIN e ON e.dst = w.node WHERE w.level < 30 AND (w.level = 0 OR w.node NOT IN (SELECT n FROM st)))
    SELECT start, node, CAST(min(level) AS INTEGER) AS level, CASE WHEN min(level) > 0 AND node IN (SELECT n FROM st) THEN 'STOP' WHEN node NOT IN (SELECT dst FROM e) THEN 'NATURAL' END AS terminal FROM w GROUP BY start, node"""
)
def trace_to_layer(spark, sf_dir):
    """Upstream from each customer's last job to the first finished ones."""
    starts = run(spark, sf_dir, "select max(o_orderkey) as start from orders group by o_custkey")
    status = run(spark, sf_dir, "select o_orderkey as n, o_orderstatus as s from orders")
    chain = relation(spark, sf_dir, "edges_chain")
    marked = lambda df, c: df.join(status, df[c] == status["n"]).withColumn(c, F.struct(F.col(c).alias("n"), F.col("s"))).drop("n", "s")
    edges = marked(marked(chain.select("src", "dst"), "src"), "dst")
    found = graph.trace_upstream(edges, marked(starts, "start"), F.col("node.s") == "F")
    return found.select(F.col("start.n").alias("start"), F.col("node.n").alias("node"), "level", "terminal")


_LAYERS = """(select distinct concat('S', cast(l_suppkey as varchar(20))) as src, concat('A', cast(l_partkey % 50 as varchar(20))) as dst from lineitem union select distinct concat('A', cast(l_partkey % 50 as varchar(20))), concat('R', cast(l_suppkey % 7 as varchar(20))) from lineitem where l_linenumber = 1)"""


@query(
    f"""WITH e AS (SELECT DISTINCT src, dst FROM {_LAYERS} t), w AS (SELECT a.src, a.dst AS mid, b.dst FROM e a JOIN e b ON b.src = a.dst WHERE a.src LIKE 'S%' AND a.dst LIKE 'A%')
    SELECT src, dst, CAST(row_number() OVER (PARTITION BY src, dst ORDER BY mid) AS INTEGER) AS place, concat_ws('>', src, mid, dst) AS path FROM w QUALIFY place <= 3"""
)
def path_examples(spark, sf_dir):
    """J13."""
    edges = run(spark, sf_dir, f"select src, dst from {_LAYERS} t")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    found = graph.path_samples(edges, nodes.withColumn("collapsible", F.col("node").startswith("A")), most=3)
    return found.select("src", "dst", "place", F.array_join("path", ">").alias("path"))


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM {duck('edges_chain')} t), n AS (SELECT src AS n FROM e UNION SELECT dst FROM e) SELECT count(*) AS nodes, TRUE AS within, 0 AS cut_edges FROM n")
def chunk_rules(spark, sf_dir):
    """What must hold of chunks: every node is there, none has more than 500 rows, no dependency is cut."""
    edges = relation(spark, sf_dir, "edges_chain")
    chunks = graph.pack_closures(edges, 500)
    sizes = chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") <= 500).alias("within"))
    nodes = chunks.agg(F.countDistinct("node").alias("nodes"))
    need = chunks.withColumnRenamed("node", "src").join(graph.pairs(edges), "src").select("chunk", F.col("dst").alias("node"))
    cut = need.join(chunks, ["chunk", "node"], "left_anti").agg(F.count(F.lit(1)).alias("cut_edges"))
    return nodes.join(F.broadcast(sizes)).join(F.broadcast(cut))  # one row each


# -- audits, snapshots, reconciliation

_SINKS = "select distinct concat('G', cast(l_suppkey as varchar(20))) as program, concat('T', cast(l_partkey as varchar(20))) as node, l_returnflag, l_linenumber from lineitem"


@query(f"SELECT DISTINCT program, 'LINEAGE_BRANCH_BROKEN' AS issue_type, node FROM ({_SINKS}) WHERE l_returnflag = 'R' AND (program, node) IN (SELECT (program, node) FROM ({_SINKS}) WHERE l_returnflag = 'A' OR l_linenumber = 7)")
def broken_branches(spark, sf_dir):
    """K9."""
    rows = run(spark, sf_dir, _SINKS)
    return audit.broken_branches(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), rows.where("l_linenumber = 7"))


_CANDIDATES = "select l_orderkey as program, concat('T', cast(l_partkey as varchar(20))) as target, l_linenumber = 1 and l_returnflag = 'R' as authoritative, l_quantity > 35 as matches from lineitem"


@query(
    f"""WITH g AS (SELECT program, min(CASE WHEN authoritative THEN target END) AS sure, count(*) AS n, count(*) FILTER (WHERE matches) AS hits, min(CASE WHEN matches THEN target END) AS hint FROM ({_CANDIDATES}) GROUP BY program)
    SELECT program, coalesce(sure, CASE WHEN n > 1 AND hits = 1 THEN hint END) AS target, CASE WHEN sure IS NOT NULL THEN 'AUTHORITATIVE' WHEN n > 1 AND hits = 1 THEN 'UNIQUE_HINT' ELSE 'NONE' END AS choice FROM g"""
)
def target_choices(spark, sf_dir):
    """K10."""
    return audit.select_target(run(spark, sf_dir, _CANDIDATES))


@query("SELECT DISTINCT o_orderpriority AS environment, o_orderstatus AS profile FROM orders WHERE o_custkey % 9 = 0 AND o_orderstatus <> 'F'")
def stale_scopes(spark, sf_dir):
    """L2: scopes of another version that a migration to F's scopes leaves behind."""
    states = run(spark, sf_dir, "select o_orderpriority as environment, o_orderstatus as profile, case when o_custkey % 9 = 0 then 'old' else 'new' end as version from orders")
    return snapshot.stale_versions(states, "new", states.where("profile = 'F'").select("environment", "profile").distinct())


_JOBS = "select 'PROD' as environment, o_orderstatus as profile, concat('S', cast(o_custkey % 40 as varchar(20))) as source, concat('T', cast(o_orderkey % 30 as varchar(20))) as target, concat('G', cast(o_custkey % 3 as varchar(20))) as program, case when o_orderkey % 2 = 0 then 'J1' end as job, 1 + o_orderkey % 4 as paths, concat('e', cast(o_orderkey % 6 as varchar(20))) as evidence from orders"


@query(f"SELECT environment, profile, source, target, program, job, count(*) AS facts, CAST(sum(paths) AS BIGINT) AS paths, array_to_string(list_slice(list_sort(list_distinct(list(evidence))), 1, 2), ',') AS evidence FROM ({_JOBS}) GROUP BY ALL")
def merged_job_edges(spark, sf_dir):
    """L6."""
    return snapshot.merged_edges(run(spark, sf_dir, _JOBS), most=2)


_ISSUES = "select case when o_orderkey % 2 = 0 then 'b2' else 'b1' end as batch_id, concat('k', cast(o_custkey as varchar(20))) as stable_key, o_orderkey, 'OPEN' as disposition from orders"


@query(f"SELECT batch_id, stable_key, o_orderkey, CASE WHEN batch_id = 'b2' AND stable_key = 'k7' THEN 'ACCEPTED' ELSE disposition END AS disposition FROM ({_ISSUES})")
def disposition_update(spark, sf_dir):
    """L10."""
    return snapshot.set_disposition(run(spark, sf_dir, _ISSUES), "b2", "k7", "ACCEPTED")


_FLAGS = "select o_orderpriority as environment, o_orderstatus as profile, o_orderkey % 11 > 0 as has_source, o_orderkey % 7 > 0 as parsed, o_custkey % 5 > 0 as has_target, o_custkey % 3 > 0 as has_edges from orders"


@query(f"SELECT environment, profile, reason, count(*) AS programs FROM (SELECT *, CASE WHEN NOT has_source THEN 'NO_SOURCE' WHEN NOT parsed THEN 'PARSE_FAILED' WHEN NOT has_target THEN 'NO_TARGET' WHEN NOT has_edges THEN 'NO_EDGES' END AS reason FROM ({_FLAGS})) WHERE reason IS NOT NULL GROUP BY ALL")
def failure_reasons(spark, sf_dir):
    """E7, L11."""
    return facts.reason_histogram(run(spark, sf_dir, _FLAGS), snapshot.failure_reason(*map(F.col, ("has_source", "parsed", "has_target", "has_edges"))))


_STEPS = "select l_linestatus as environment, l_returnflag as profile, l_orderkey as program, case when l_linenumber > 1 then concat('T', cast(l_partkey as varchar(20))) end as target, l_suppkey % 4 as n, case when l_linenumber > 2 then l_suppkey % 3 else 0 end as edges from lineitem"


@query(
    f"""SELECT environment, profile, count(*) AS steps, count(target) AS targets, count(*) FILTER (WHERE n > 0) AS sourced, count(*) FILTER (WHERE edges > 0) AS linked, CAST(sum(edges) AS BIGINT) AS edges, count(DISTINCT target) AS distinct_targets, round(count(target) / count(*), 6) AS target_ratio,
    round(count(*) FILTER (WHERE n > 0) / count(*), 6) AS source_ratio, round(count(*) FILTER (WHERE edges > 0) / count(target), 6) AS link_ratio, round(sum(edges) / count(*) FILTER (WHERE edges > 0), 6) AS edge_ratio FROM ({_STEPS}) GROUP BY ALL"""
)
def coverage_steps(spark, sf_dir):
    """E7."""
    return facts.coverage_steps(run(spark, sf_dir, _STEPS).withColumn("sources", F.array_repeat(F.lit("s"), F.col("n").cast("int"))))


_DECLARED = "select case when o_orderkey % 3 = 0 then 'old' else 'sql1' end as batch_id, concat('005:dws_dwf.p', cast(o_custkey as varchar(20)), case when o_custkey % 10 = 0 then '' else ':1:00' end) as program from orders"


@query(f"SELECT DISTINCT CASE WHEN program LIKE '%:1:00' THEN upper(replace(split_part(program, ':', 2), 'dws_', '')) END AS target FROM ({_DECLARED}) WHERE batch_id = 'sql1'")
def active_inventory(spark, sf_dir):
    """M4."""
    return reconcile.active_inventory(run(spark, sf_dir, _DECLARED), "sql1")


_STORED = "select 'PROD' as environment, concat('DWF.P', cast(l_partkey as varchar(20))) as target, concat('DWD.S', cast(l_suppkey as varchar(20))) as source, case when l_linenumber = 7 then 'other' else 'sql1' end as sql_batch, 'sched1' as schedule_batch, 'v1' as version, 'SQL_ONLY' as raw_status, case when l_tax > 0.07 then 'OTHER' else 'NO_INTERNAL_PROGRAM' end as reason from lineitem where l_quantity > 10"


@query(f"SELECT DISTINCT environment, target, source FROM ({_STORED}) WHERE sql_batch = 'sql1' AND reason = 'NO_INTERNAL_PROGRAM'")
def usable_suppressions(spark, sf_dir):
    """M5."""
    return reconcile.usable_suppressions(run(spark, sf_dir, _STORED), "sql1", "sched1", "v1")


_NAMED = "replace(upper(target), 'DWS_DWF.', 'DWF.') AS target, replace(upper(source), 'DWS_DWD.', 'DWD.') AS source"


@query(
    f"""WITH a AS (SELECT environment, {_NAMED}, count(*) AS facts, count(DISTINCT nullif(program, '')) AS p FROM {duck('sql_side')} t WHERE program NOT LIKE '%7' AND source NOT LIKE 'DLO.%' GROUP BY ALL),
    b AS (SELECT environment, {_NAMED}, count(*) AS facts, count(DISTINCT nullif(program, '')) AS p FROM {duck('sched_side')} t WHERE program NOT LIKE '%7' GROUP BY ALL),
    k AS (SELECT DISTINCT environment, target, source FROM ({_STORED}) WHERE sql_batch = 'sql1' AND reason = 'NO_INTERNAL_PROGRAM' AND source NOT IN (SELECT concat('DWD.S', CAST(s_suppkey AS VARCHAR)) FROM supplier WHERE s_acctbal > 0))
    SELECT environment, target, source, coalesce(a.facts, 0) AS sql_facts, coalesce(a.p, 0) AS programs, coalesce(b.facts, 0) AS schedule_facts, coalesce(b.p, 0) AS processes,
      CASE WHEN a.facts IS NULL THEN 'SCHEDULE_ONLY' WHEN b.facts IS NOT NULL THEN 'MATCH' WHEN k.target IS NOT NULL THEN 'SUPPRESSED' ELSE 'SQL_ONLY' END AS status FROM a FULL JOIN b USING (environment, target, source) LEFT JOIN k USING (environment, target, source)"""
)
def reconcile_active_batches(spark, sf_dir):
    """M8."""
    sides = []
    for name, batch in (("sql_side", "sql1"), ("sched_side", "sched1")):
        sides.append(relation(spark, sf_dir, name).withColumn("batch_id", F.when(F.col("program").endswith("7"), "old").otherwise(batch)))
    batches = run(spark, sf_dir, "select explode(array(struct('SQL' as side, 'sql1' as batch_id, true as is_active), struct('SQL' as side, 'old' as batch_id, false as is_active), struct('SCHEDULE' as side, 'sched1' as batch_id, true as is_active))) as b from region where r_regionkey = 0").select("b.*")
    states = run(spark, sf_dir, "select 'sql1' as batch_id, concat('005:dwd.s', cast(s_suppkey as string), ':1:00') as program from supplier where s_acctbal > 0")
    return reconcile.reconcile_active(*sides, batches, run(spark, sf_dir, _STORED), states, "v1")


# -- rules, searches, batches

_COLUMNS = "select concat(case when l_suppkey % 2 = 0 then 'DWF.T' else 'ODS.T' end, cast(l_partkey as varchar(20))) as tab, concat('C', cast(l_linenumber as varchar(20))) as col, case when l_quantity > 25 then 'note' end as note, l_returnflag from lineitem"


@query(f"SELECT DISTINCT tab AS \"table\", col AS \"column\" FROM ({_COLUMNS}) WHERE tab LIKE 'DWF%' AND note IS NULL AND (tab, col) NOT IN (SELECT (tab, col) FROM ({_COLUMNS}) WHERE l_returnflag = 'R')")
def comments_missing(spark, sf_dir):
    """Q5."""
    rows = run(spark, sf_dir, _COLUMNS).select(F.col("tab").alias("table"), F.col("col").alias("column"), F.col("note").alias("comment"), "l_returnflag")
    return lint.missing_comments(rows, rows.where("l_returnflag = 'R'").withColumn("comment", F.lit("x"))).distinct()


@query("SELECT DISTINCT concat('FILE ', CAST(l_partkey AS VARCHAR)) AS file, l_returnflag AS rule FROM lineitem")
def issues_distinct(spark, sf_dir):
    """Q9."""
    rows = run(spark, sf_dir, "select concat(case when l_linenumber % 2 = 0 then ' file   ' else 'File ' end, cast(l_partkey as string), ' ') as file, lower(l_returnflag) as rule from lineitem")
    return lint.distinct_issues(rows, ["file", "rule"])


@query("SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderstatus, o_orderpriority, concat('k', CAST(o_custkey % 5 AS VARCHAR))])), ',') AS keywords FROM orders")
def keyword_groups(spark, sf_dir):
    """P5."""
    rows = run(spark, sf_dir, "select o_orderkey, concat(o_orderstatus, ', ', o_orderpriority, '@#@', 'k', cast(o_custkey % 5 as string), ',,', o_orderstatus) as line from orders")
    return lint.keyword_groups(rows, "line").select("o_orderkey", "keywords")


@query("SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS items, TRUE AS within FROM orders")
def item_batches(spark, sf_dir):
    """What must hold of batches: every item is in one of at most 100."""
    batched = facts.batches_of(run(spark, sf_dir, "select o_orderkey from orders"), "o_orderkey", 100)
    sizes = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("d"))
    return sizes.agg(F.sum("n").alias("rows"), F.sum("d").alias("items"), (F.max("n") <= 100).alias("within"))


_RELATIONS = "select distinct concat('T', cast(l_suppkey % 30 as varchar(20))) as a, concat('C', cast(l_linenumber as varchar(20))) as b, concat('T', cast(l_suppkey % 30 + 1 + l_partkey % 3 as varchar(20))) as c, concat('C', cast(l_linenumber % 3 as varchar(20))) as d from lineitem where l_suppkey % 30 < 27"
_CORPUS = "select o_orderkey as id, concat('select T', cast(o_custkey % 40 as varchar(20)), '.x, S.T', cast(o_orderkey % 40 as varchar(20)), ' from y') as text from orders"


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT concat('S.', a, '.', b) AS src, concat('S.', c, '.', d) AS dst FROM ({_RELATIONS})), g AS (SELECT 'S.T0.C1' AS node, 0 AS level UNION SELECT e.dst, g.level + 1 FROM g JOIN e ON e.src = g.node WHERE g.level < 4), n AS (SELECT DISTINCT split_part(node, '.', 2) AS t FROM g)
    SELECT DISTINCT id, concat('S.', t) AS "table" FROM ({_CORPUS}) JOIN n ON list_contains(regexp_extract_all(text, '\\w+'), t)"""
)
def lineage_search(spark, sf_dir):
    """Texts that name a table which the walk from a column reaches."""
    rows = run(spark, sf_dir, _RELATIONS).select(F.lit("S").alias("schema"), F.col("a").alias("table"), F.col("b").alias("column"), F.lit("S").alias("to_schema"), F.col("c").alias("to_table"), F.col("d").alias("to_column"))
    reached = metadata.column_walk(rows, spark.range(1).select(F.lit("S.T0.C1").alias("node")), max_depth=4)
    return lint.lineage_search(run(spark, sf_dir, _CORPUS), "id", "text", reached)


_SENDS = "select o_orderkey as id, concat('dwf.t', cast(o_custkey as varchar(20)), case when o_orderkey % 2 = 0 then ', a, b' else ', a' end) as fields from orders"


@query(f"SELECT id, concat('DWF.T', o_custkey) AS target, CAST(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_fields FROM ({_SENDS}) JOIN orders ON o_orderkey = id WHERE o_custkey IN (1, 7, 100)")
def send_search(spark, sf_dir):
    """R10."""
    return lint.send_search(run(spark, sf_dir, _SENDS), "id", "fields", ["dwf.T1", '"DWF"."T7"', "DWF.T100"])


_PLANS = "select concat('P', cast(o_custkey as varchar(20))) as plan, concat('Q', cast(o_orderkey as varchar(20))) as seq, o_orderstatus <> 'O' as has_jobs from orders"


@query(f"SELECT DISTINCT plan, seq FROM ({_PLANS}) WHERE NOT has_jobs")
def empty_sequences(spark, sf_dir):
    """Q7: sequences of a plan without a job."""
    rows = run(spark, sf_dir, _PLANS)
    return lint.empty_sequences(rows.select("plan", "seq"), rows.where("has_jobs").select("seq", F.col("plan").alias("job")))


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {duck('edges_cycle')} t), w AS (SELECT src, dst FROM e UNION SELECT w.src, e.dst FROM w JOIN e ON e.src = w.dst) SELECT DISTINCT src AS job, 'CYCLE' AS rule FROM w WHERE src = dst")
def dependency_cycles(spark, sf_dir):
    """Q7: jobs that depend on themselves in the end."""
    return lint.cycle_issues(relation(spark, sf_dir, "edges_cycle").withColumnsRenamed({"src": "job", "dst": "dep"}), "o_custkey")


_KINDS = """select l_orderkey * 10 + l_linenumber as id, case l_linenumber % 3 when 0 then 'SQL' when 1 then 'HIVE' else 'PYTHON' end as kind, case when l_suppkey % 3 > 0 then l_suppkey % 3 = 1 end as partitioned,
    concat(case when l_partkey % 2 = 0 then 'create view v.x as ' else '' end, 'select ', case when l_partkey % 3 = 0 then 'distinct ' else '' end, case when l_partkey % 5 = 0 then 'decode( a)' else 'a' end, ' from ', case when l_partkey % 7 = 0 then 'bare' else 's.t' end,
    case when l_suppkey % 2 = 0 then '; alter table s.t add b varchar2(9)' else '' end, case when l_orderkey % 2 = 0 then ' 影响条数' else '' end, case when l_orderkey % 3 = 0 then ' def rollback_deal (x): drop partition p' else '' end) as script from lineitem"""


@query(
    f"""SELECT id, rule FROM (SELECT id, unnest([CASE WHEN kind <> 'PYTHON' AND script LIKE '%alter%' THEN 'ALTER' END, CASE WHEN kind <> 'HIVE' AND script LIKE 'create view%' THEN 'CREATED_VIEW' END, CASE WHEN kind <> 'HIVE' AND script LIKE '%distinct%' THEN 'DISTINCT' END,
      CASE WHEN kind = 'PYTHON' AND script LIKE '%varchar2%' THEN 'FIXED_LENGTH' END, CASE WHEN kind = 'HIVE' AND script LIKE '%varchar2%' THEN 'VARCHAR2' END, CASE WHEN kind = 'PYTHON' AND script NOT LIKE '%影响条数%' THEN 'MISSING_LOG' END, CASE WHEN kind = 'PYTHON' AND (script LIKE '%rollback%') <> partitioned THEN 'PARTITION_MISMATCH' END,
      CASE WHEN kind = 'PYTHON' AND script LIKE '%bare%' THEN 'UNQUALIFIED_TABLE' END, CASE WHEN kind <> 'HIVE' AND script LIKE '%decode%' THEN 'USED_FUNCTION' END]) AS rule FROM ({_KINDS})) WHERE rule IS NOT NULL"""
)
def kind_rules(spark, sf_dir):
    """Q1, Q2, Q3."""
    return lint.kind_issues(run(spark, sf_dir, _KINDS), "id", "script", ["decode"])


@query(
    """SELECT kind_of AS source, CASE WHEN text IS NULL THEN 'NULL' WHEN ltrim(text) = '' THEN 'EMPTY' WHEN regexp_matches(ltrim(text), '(?i)^(SELECT|INSERT|CREATE|UPDATE|DELETE|MERGE|WITH)\\b') THEN 'SQL' WHEN ltrim(text) LIKE '<%' THEN 'MARKUP' WHEN regexp_matches(ltrim(text), '^[\\[{]') THEN 'JSON' ELSE 'TEXT' END AS kind, count(*) AS n
    FROM (SELECT source AS kind_of, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'events', props FROM events UNION ALL SELECT 'part', CASE p_size % 3 WHEN 0 THEN ' select 1' WHEN 1 THEN '' END FROM part) GROUP BY ALL"""
)
def text_kinds(spark, sf_dir):
    """R3."""
    rows = run(spark, sf_dir, "select source, text from documents union all select 'pages', html from pages union all select 'events', props from events union all select 'part', case p_size % 3 when 0 then ' select 1' when 1 then '' end from part")
    return facts.type_histogram(rows, "source", "text")
