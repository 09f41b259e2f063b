"""Registered queries of suppression publishes, the mapping index, decode statistics and report rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.tables import scratch
from threadloom.operators import facts, reports
from threadloom.plans.registry import Registry
from threadloom.plans.relations import run
from threadloom.sources import store

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql

# -- three publishes: of all scopes, of two of them, and of one

_EDGES = "select concat('E', cast(l_linenumber % 3 as varchar(9))) as environment, concat('S', cast(l_suppkey % 2 as varchar(9))) as profile, concat(cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20))) as row_key, min(l_shipmode_) as note, min(l_partkey) as part from (select *, l_returnflag as l_shipmode_ from lineitem) x group by 1, 2, 3"
_PUBLISHES = ((1, ("E0", "E1", "E2")), (2, ("E0", "E1")), (3, ("E0",)))


@query(
    f"""WITH e AS ({_EDGES}), p AS (SELECT e.*, n FROM e, (SELECT unnest([1, 2, 3]) AS n) WHERE (part + n) % 3 <> 0 AND environment IN ('E0', CASE WHEN n <= 2 THEN 'E1' END, CASE WHEN n = 1 THEN 'E2' END)),
    l AS (SELECT environment, max(n) AS last FROM (VALUES ('E0', 3), ('E1', 2), ('E2', 1)) v(environment, n) GROUP BY environment),
    s AS (SELECT environment, profile, row_key, min(part) AS part, min(n) AS first, max(n) AS named, list(n) AS ns, max(last) AS last FROM p JOIN l USING (environment) GROUP BY ALL)
    SELECT environment, profile, row_key, part, named AS note, named = last AS active, CAST(make_date(2024, 1, first::INT) AS VARCHAR) AS created_on, CAST(make_date(2024, 1, (CASE WHEN named = last THEN last ELSE named + 1 END)::INT) AS VARCHAR) AS updated_on FROM s"""
)
def suppression_publishes(spark, sf_dir):
    """What is left after three publishes: upserted, retired and reactivated rows, and scopes that later ones leave alone."""
    kept = store.SuppressionStore(spark, scratch(spark, "suppressions"), ["environment", "profile"], ["part", "note"])
    rows = run(spark, sf_dir, _EDGES).select("environment", "profile", "row_key", "part")
    for n, environments in _PUBLISHES:
        mine = rows.where(F.col("environment").isin(*environments))
        named = mine.where((F.col("part") + n) % 3 != 0).withColumn("note", F.lit(n).cast("long"))
        kept.publish(named, mine, f"2024-01-0{n} 00:00:00")
    day = lambda c: F.col(c).cast("date").cast("string")
    return kept.read().select("environment", "profile", "row_key", "part", "note", "active", day("created_at").alias("created_on"), day("updated_at").alias("updated_on"))


@query("SELECT o_orderkey, m.p_partkey AS part, m.p_name AS name FROM (SELECT o_orderkey, o_custkey % 500 AS part FROM orders) o JOIN part m ON m.p_partkey = o.part")
def mapping_rebuild(spark, sf_dir):
    """A mapping rebuilt as a bucketed table, and orders that look up their names in it by a join."""
    name = f"threadloom_mapping_{spark.sparkContext.applicationId.replace('-', '_')}"
    store.rebuild_mapping(run(spark, sf_dir, "select p_partkey, p_name from part"), name, "p_partkey", buckets=16)
    asked = run(spark, sf_dir, "select o_orderkey, o_custkey % 500 as part from orders")
    return asked.join(spark.table(name), F.col("part") == F.col("p_partkey")).select("o_orderkey", "part", F.col("p_name").alias("name"))


# -- texts with as many broken bytes as their row says

_BROKEN = "select lang, text, case when doc_id % 5 = 0 then 1 + doc_id % 3 when doc_id % 7 = 0 then length(text) else 0 end as broken from documents"
_LENGTHS = f"SELECT lang, text, broken, strlen(text) + broken AS raw, length(text) + broken AS decoded FROM ({_BROKEN})"


def _bytes(spark, sf_dir):
    rows = run(spark, sf_dir, _BROKEN)
    return rows.select("lang", F.concat(F.col("text").cast("binary"), F.unhex(F.repeat(F.lit("FF"), F.col("broken").cast("int")))).alias("content"))


@query(
    f"""SELECT lang, count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS nulls, count(*) FILTER (WHERE broken = 0) AS valid, count(*) FILTER (WHERE broken > 0 AND broken <= 0.1 * decoded) AS repaired, count(*) FILTER (WHERE broken > 0 AND broken > 0.1 * decoded) AS invalid,
    min(raw) AS raw_least, max(raw) AS raw_most, CAST(sum(raw) AS BIGINT) AS raw_total, min(decoded) AS decoded_least, max(decoded) AS decoded_most, CAST(sum(decoded) AS BIGINT) AS decoded_total FROM ({_LENGTHS}) GROUP BY lang"""
)
def decode_statistics(spark, sf_dir):
    """R3."""
    return facts.decode_statistics(_bytes(spark, sf_dir), "lang", "content")


@query(f"SELECT lang, measure, CASE WHEN v = 0 THEN 0 ELSE CAST(pow(2, floor(log2(v))) AS BIGINT) END AS low, count(*) AS n FROM (SELECT lang, 'raw' AS measure, raw AS v FROM ({_LENGTHS}) UNION ALL SELECT lang, 'decoded', decoded FROM ({_LENGTHS})) WHERE v IS NOT NULL GROUP BY ALL")
def length_histogram(spark, sf_dir):
    """R3."""
    return facts.length_histogram(_bytes(spark, sf_dir), "lang", "content")


# -- reports, menus and authorities

_K = "cast(p_partkey as varchar(20))"
_REPORTS = f"""select concat('/a/', case when p_size % 4 = 0 then 'no number' else concat('[', {_K}, ']') end, {_K}, '.cpt') as report, p_partkey, p_size, case when p_size % 9 = 0 then '<WorkBook><TableDataMap>' else concat('<?xml version="1.0"?><WorkBook><TableDataMap><TableData name="ds1"><Connection><DatabaseName>db', cast(p_size % 3 as varchar(9)),
    '</DatabaseName></Connection><Query><![CDATA[select ', case when p_size % 2 = 0 then 'distinct ' else '' end, 'card_no, a.email from ', case when p_size % 5 = 0 then 'bare' else 'dwf.t' end, {_K}, ' where d_date = ''2024010', cast(p_size % 2 as varchar(9)), ''']]></Query></TableData>',
    case when p_size % 3 = 0 then '<TableData name="ds2"><Connection><DatabaseName>db9</DatabaseName></Connection><Query>select 1 from dwf.x where k in ( select k from dwf.y)</Query></TableData>' else '' end, '</TableDataMap><Report class="com.fr.report.worksheet.WorkSheet" name="s', {_K},
    '"/><Report class="other" name="z"/>', case when p_size % 2 = 0 then '<LayerReportAttr clientPaging="true" engineState="1"/>' else '' end, '</WorkBook>') end as xml from part"""


@query(
    f"""SELECT report, CASE WHEN p_size % 9 <> 0 THEN concat('db', p_size % 3, CASE WHEN p_size % 3 = 0 THEN ',db9' ELSE '' END) END AS sources, CASE WHEN p_size % 9 <> 0 THEN concat('s', p_partkey) END AS sheets, CASE WHEN p_size % 9 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'ROW' ELSE 'NONE' END END AS paging,
    CASE WHEN p_size % 9 <> 0 THEN p_size % 3 = 0 END AS two FROM ({_REPORTS})"""
)
def report_parts(spark, sf_dir):
    """Q8: nested XML of reports."""
    read = reports.read_reports(run(spark, sf_dir, _REPORTS).select("report", "xml"))
    return read.select("report", F.array_join("sources", ",").alias("sources"), F.array_join("sheets", ",").alias("sheets"), "paging", F.contains("script", F.lit("dwf.y")).alias("two"))


@query(
    f"""WITH r AS (SELECT *, p_size % 9 <> 0 AS good FROM ({_REPORTS})), i AS (SELECT report, unnest([CASE WHEN p_size % 4 = 0 THEN ['NUMBER_MISSING', split_part(report, '/', 3)] END, CASE WHEN p_size % 4 = 0 THEN ['NAME_WITH_BLANK', report] END, CASE WHEN NOT good THEN ['NO_XML', NULL] END,
      CASE WHEN good AND p_size % 2 = 0 THEN ['DISTINCT', NULL] END, CASE WHEN good AND p_size % 2 = 1 THEN ['HARDCODED_DATE', '2024-01-01'] END, CASE WHEN good AND p_size % 3 = 0 THEN ['IN_SUBQUERY', NULL] END, CASE WHEN good AND p_size % 5 = 0 THEN ['SCHEMA_MISSING', concat('BARE', p_partkey)] END]) AS x FROM r)
    SELECT report, x[1] AS rule, x[2] AS detail FROM i WHERE x IS NOT NULL"""
)
def report_issues(spark, sf_dir):
    """Q8: rules on names and queries of reports."""
    return reports.report_issues(run(spark, sf_dir, _REPORTS).select("report", "xml"))


_WORDS = "select concat('f', cast(n as varchar(9))) as field, word as keyword from (select 1 as n, 'license' as word union all select 1, 'Password' union all select 2, 'id' union all select 2, 'worthless' union all select 3, 'e') w union all select 'nation', n_name from nation"


@query(f"SELECT doc_id, field, array_to_string(list_sort(list(DISTINCT keyword)), ',') AS keywords FROM documents, ({_WORDS}) w WHERE contains(upper(text), upper(keyword)) GROUP BY doc_id, field")
def dictionary_hits(spark, sf_dir):
    """Q8: words of a dictionary, long ones and of one or two letters."""
    found = reports.dictionary_hits(run(spark, sf_dir, "select doc_id, text from documents"), "doc_id", "text", run(spark, sf_dir, _WORDS))
    return found.select("doc_id", "field", F.array_join("keywords", ",").alias("keywords"))


_MENUS = f"select p_partkey as line_id, concat(case when p_size % 3 = 0 then '' else '数据仓库/' end, case when p_size % 4 = 0 then '会计结算部/' else 'x/' end, 'r', {_K}, case when p_size % 5 = 0 then '' else '.cpt' end, case when p_size % 7 = 0 then '' else concat(case when p_size % 2 = 0 then '，' else ',' end, case when p_size % 6 = 0 then '互联网金融部/' else 'm/' end, 'r', {_K}) end) as line from part"


@query(
    """SELECT p_partkey AS line_id, x[1] AS field, x[2] AS rule, x[3] AS detail FROM (SELECT p_partkey, unnest([CASE WHEN p_size % 3 = 0 THEN ['path', 'ROOT_MISSING', '数据仓库/'] END, CASE WHEN p_size % 5 = 0 THEN ['path', 'SUFFIX_MISSING', '.cpt,.frm'] END, CASE WHEN p_size % 7 = 0 THEN ['menu', 'MENU_MISSING', NULL] END,
    CASE WHEN p_size % 4 = 0 THEN ['path', 'FORBIDDEN_PART', '会计结算部'] END, CASE WHEN p_size % 6 = 0 AND p_size % 7 <> 0 THEN ['menu', 'FORBIDDEN_PART', '互联网金融部'] END]) AS x FROM part) WHERE x IS NOT NULL"""
)
def menu_issues(spark, sf_dir):
    """Q8: menu lines."""
    return reports.menu_issues(run(spark, sf_dir, _MENUS))


_AUTHORITIES = "select o_orderkey as line_id, concat('数据仓库/r', cast(o_custkey as varchar(20)), '.cpt,role', cast(o_orderkey % 40 as varchar(9)), '，role', cast(o_custkey % 37 as varchar(9)), ', ') as line from orders"


@query(
    """SELECT DISTINCT o_orderkey AS line_id, 'ROLE_UNKNOWN' AS rule, concat('role', r) AS detail FROM (SELECT o_orderkey, unnest([o_orderkey % 40, o_custkey % 37]) AS r FROM orders) WHERE r NOT IN (SELECT n_nationkey FROM nation)
    UNION ALL SELECT o_orderkey, 'REPORT_UNKNOWN', concat('r', o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)"""
)
def authority_issues(spark, sf_dir):
    """Q8: roles and reports that nobody knows."""
    roles = run(spark, sf_dir, "select concat('role', cast(n_nationkey as string)) as role from nation")
    return reports.authority_issues(run(spark, sf_dir, _AUTHORITIES), roles, run(spark, sf_dir, "select concat('m/r', cast(c_custkey as string), '.frm') as name from customer where c_custkey % 3 <> 0"))
