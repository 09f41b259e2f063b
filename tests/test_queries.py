"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest

from threadloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "is_integer") or isinstance(x, int):
        return f"{float(x):.6f}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(_value(r[c]) for c in order) for r in rows) == sorted(tuple(_value(r[k]) for k in at) for r in want.fetchall())


def test_registry():
    import __spark_entry__

    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and set(catalogue.QUERIES) <= set(found)
