"""Registered queries of the extraction state machines, on texts generated from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import extract
from threadloom.plans.registry import Registry
from threadloom.plans.relations import run

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.oracle_sql

_MANY = "select p_partkey, concat('insert into a values (''x;', p_name, '''); ; select \"b;c\" from t', cast(p_size as varchar(10)), case when p_size % 2 = 0 then ';' else '' end) as script from part"


@query("SELECT p_partkey, CAST(k AS INTEGER) AS position, CASE k WHEN 0 THEN concat('insert into a values (''x;', p_name, ''')') ELSE concat('select \"b;c\" from t', CAST(p_size AS VARCHAR)) END AS statement FROM part, (SELECT unnest([0, 1]) AS k)")
def statement_split(spark, sf_dir):
    return extract.statements(run(spark, sf_dir, _MANY), ["p_partkey"], "script")


_BLOCKS = """select p_partkey, concat('insert into t with c as (select 1 from dwd.x', cast(p_size as varchar(10)), ' where 1 = ', case when p_size % 2 = 0 then '2' else '1' end, ') select extract(day from d) from c join dwf.y on a = b -- from hidden', chr(10), 'where k in (select k from dwm.z)') as script from part"""


@query(
    """SELECT p_partkey, CAST(k AS INTEGER) AS block, CAST(CASE k WHEN 2 THEN 1 END AS INTEGER) AS parent, CASE k WHEN 0 THEN concat('DWD.X', CAST(p_size AS VARCHAR)) WHEN 1 THEN 'DWF.Y' ELSE 'DWM.Z' END AS sources, k = 0 AND p_size % 2 = 0 AS statically_false
    FROM part, (SELECT unnest([0, 1, 2]) AS k)"""
)
def query_blocks(spark, sf_dir):
    return extract.blocks(run(spark, sf_dir, _BLOCKS), ["p_partkey"], "script")


_DDL = """select p_partkey, concat('CREATE TABLE IF NOT EXISTS dwf.f_', cast(p_partkey as varchar(10)), ' (id bigint COMMENT ''key, of all'', price decimal(10, 2)', case when p_size % 2 = 0 then ', PRIMARY KEY (id)' else '' end, '); ALTER TABLE dwf.x ADD COLUMN c', cast(p_size as varchar(10)), ' int; COMMENT ON COLUMN dwf.x.a IS ''note'';') as script from part"""


@query(
    """SELECT p_partkey, CASE WHEN k < 2 THEN concat('DWF.F_', CAST(p_partkey AS VARCHAR)) ELSE 'DWF.X' END AS table_name, CASE k WHEN 0 THEN 'ID' WHEN 1 THEN 'PRICE' WHEN 2 THEN concat('C', CAST(p_size AS VARCHAR)) ELSE 'A' END AS column_name,
    CASE k WHEN 0 THEN 'key, of all' WHEN 3 THEN 'note' END AS comment, CASE k WHEN 2 THEN 'alter' WHEN 3 THEN 'comment' ELSE 'create' END AS origin FROM part, (SELECT unnest([0, 1, 2, 3]) AS k)"""
)
def ddl_columns(spark, sf_dir):
    return extract.columns_defined(run(spark, sf_dir, _DDL), ["p_partkey"], "script")


_PROGRAM = """select p_partkey, concat('table = "dwf.f_', cast(p_partkey as varchar(10)), '"', chr(10), 'sql = f"insert into {table} select * from dwd.s', cast(p_size as varchar(10)), ' where d = {day}"', chr(10),
    case when p_size % 2 = 0 then 'db.execute(sql)' else concat('run_sql("delete from {} where k = 1".format("dwm.m', cast(p_size as varchar(10)), '"))') end) as script from part"""


@query(
    """SELECT p_partkey, 0 AS position, CASE WHEN p_size % 2 = 0 THEN concat('insert into dwf.f_', CAST(p_partkey AS VARCHAR), ' select * from dwd.s', CAST(p_size AS VARCHAR), ' where d = {}') ELSE concat('delete from dwm.m', CAST(p_size AS VARCHAR), ' where k = 1') END AS statement, 'CALL' AS reason FROM part"""
)
def python_sql_extract(spark, sf_dir):
    return extract.programs_sql(run(spark, sf_dir, _PROGRAM), ["p_partkey"], "script")


_INSERT = """select p_partkey, concat('INSERT INTO dwf.t', cast(p_size as varchar(10)), ' (a, b, c) SELECT x.k, max(y.v), z FROM dwd.s', cast(p_size as varchar(10)), ' x', case when p_size % 2 = 0 then ' JOIN dwd.r AS y ON x.k = y.k' else '' end) as script from part"""


@query(
    """SELECT p_partkey, concat('DWF.T', CAST(p_size AS VARCHAR)) AS target, c AS target_column, CASE WHEN c = 'A' OR (c = 'C' AND p_size % 2 = 1) THEN concat('DWD.S', CAST(p_size AS VARCHAR)) END AS source, CASE c WHEN 'A' THEN 'K' WHEN 'C' THEN 'Z' END AS source_column,
    CASE WHEN c = 'B' THEN 'UNRESOLVED' WHEN c = 'C' AND p_size % 2 = 0 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS state FROM part, (SELECT unnest(['A', 'B', 'C']) AS c)"""
)
def column_projection(spark, sf_dir):
    return extract.column_lineage(run(spark, sf_dir, _INSERT), ["p_partkey"], "script")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'DWF.Y,DWM.Z' ELSE concat('DWD.X', CAST(p_size AS VARCHAR), ',DWF.Y,DWM.Z') END AS sources FROM part")
def effective_sources(spark, sf_dir):
    """H9 on tables: a block counts unless it or an ancestor is statically false (blocks nest one deep here and in SQL)."""
    found = extract.blocks(run(spark, sf_dir, _BLOCKS), ["p_partkey"], "script")
    dead = found.where("statically_false").select("p_partkey", F.col("block").alias("dead"))
    alive = found.join(dead, (found["p_partkey"] == dead["p_partkey"]) & ((found["block"] == dead["dead"]) | (found["parent"] == dead["dead"])), "left_anti")
    names = alive.select("p_partkey", F.explode(F.split("sources", ",")).alias("source")).where("source <> ''")
    return names.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
