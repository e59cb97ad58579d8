"""Every query against its SQL on a small scale, value by value."""

import math
import os

import duckdb
import pytest

from sparkloom.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in os.listdir(data):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{data}/{t}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    found = QUERIES[name](spark, data)
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    ours = sorted(repr(plain(tuple(r))) for r in found.select(*columns).collect())
    assert ours == sorted(repr(plain(tuple(r[i] for i in at))) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
