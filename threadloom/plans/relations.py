"""Lineage relations derived from the given tables: one SQL text for Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from threadloom.functions.tables import table

#: Names of nodes: zero-padded, so that the order of names is that of keys.
_NAME = "concat('DWM.P', lpad(cast({0} as varchar(20)), 9, '0'))"

SQL = {
    "edges_tree": f"select {_NAME.format('cast(floor(p_partkey / 2) as bigint)')} as src, {_NAME.format('p_partkey')} as dst from part where p_partkey >= 1",
    "edges_chain": """select src, dst, o_custkey from (
        select o_orderkey as src, o_custkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst from orders) x where dst is not null""",
    "edges_cycle": """select src, dst, o_custkey from (
        select o_orderkey as src, o_custkey, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst from orders) x where dst is not null
        union all
        select max(case when d = 1 then o_orderkey end) as src, max(case when a = 1 then o_orderkey end) as dst, o_custkey from (
        select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as a,
               row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as d from orders where o_custkey % 7 = 0) y
        group by o_custkey having count(*) > 1""",
    "edges_supply": "select distinct concat('S', cast(l_suppkey as varchar(20))) as src, concat('P', cast(l_partkey as varchar(20))) as dst from lineitem",
    "program_edges": """select distinct concat('G', cast(l_suppkey as varchar(20))) as program, concat('T', cast(l_partkey % 97 as varchar(20))) as src,
        concat('T', cast((l_partkey * 7 + l_linenumber) % 97 as varchar(20))) as dst from lineitem""",
    "sql_side": """select 'PROD' as environment, concat('DWS_DWF.P', cast(l_partkey as varchar(20))) as target, concat(case when l_suppkey % 11 = 0 then 'DLO' else 'dwd' end, '.S', cast(l_suppkey as varchar(20))) as source,
        case when l_linenumber = 1 then '' else concat('G', cast(l_linenumber as varchar(20))) end as program from lineitem where l_returnflag <> 'R'""",
    "sched_side": """select 'PROD' as environment, concat('DWF.P', cast(l_partkey as varchar(20))) as target, concat('DWS_DWD.S', cast(l_suppkey as varchar(20))) as source,
        concat('J', cast(l_linenumber as varchar(20))) as program from lineitem where l_linestatus = 'O' and l_suppkey % 11 <> 0""",
    "scripts": """select l_orderkey, l_linenumber, concat('INSERT INTO DWM.T', cast(l_partkey as varchar(20)), ' (a, b) WITH c', cast(l_linenumber as varchar(20)), ' AS (SELECT 1 FROM dwd.seed) SELECT x.a, y.b FROM DWF.S', cast(l_suppkey as varchar(20)),
        ' x JOIN c', cast(l_linenumber as varchar(20)), ' y ON x.k = y.k LEFT JOIN dwf.r', cast(l_linenumber as varchar(20)), ' z ON z.d = ''FROM hidden'' WHERE z.e > ''', cast(cast(l_shipdate as date) as varchar(20)), '''') as script from lineitem""",
    "states": """select user_id, event_type, cast(ts as date) as day, HASH(concat(cast(count(*) as varchar(20)), '|', cast(cast(round(sum(value) * 100) as bigint) as varchar(30)))) as hash
        from events group by user_id, event_type, cast(ts as date)""",
    "jobs": """select concat('JOB_', cast(o_orderkey as varchar(20))) as job, o_orderpriority as priority, o_orderstatus as status,
        concat('33:JOB_', cast(o_orderkey % 500 as varchar(20)), '|44:X|33:JOB_', cast(o_orderkey % 77 as varchar(20)), '|33:JOB_', cast(o_orderkey % 500 as varchar(20))) as deps from orders""",
}


def _bind(text: str, names: list[str]) -> str:
    for n in names:
        text = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text)
    return text


_TABLES = ["part", "orders", "lineitem", "events", "customer", "supplier", "nation", "region", "documents", "pages", "labels", "conversations"]


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, _hash_for_spark(SQL[name]))


def _hash_for_spark(text: str) -> str:
    """HASH(x) is sha2(x, 256) in Spark; the relation's only call closes before ' as hash'."""
    return text.replace("HASH(", "sha2(").replace(") as hash", ", 256) as hash")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over the given tables."""
    text = _bind(text.replace("{", "{{").replace("}", "}}"), _TABLES)
    used = {n: table(spark, sf_dir, n) for n in _TABLES if f"{{{n}}}" in text}
    return spark.sql(text, **used)


def duck(name: str) -> str:
    """The same relation for DuckDB, in brackets."""
    return "(" + SQL[name].replace("HASH(", "sha256(") + ")"
