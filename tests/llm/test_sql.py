"""Queries of this folder against their SQL on a small scale, value by value."""

import os

import duckdb
import pytest

from sparkloom.llm.queries import ORACLE_SQL, QUERIES


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in os.listdir(data):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{data}/{t}'")
    found, want = QUERIES[name](spark, data), con.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    ours = sorted(repr([plain(v) for v in r]) for r in found.select(*columns).collect())
    assert ours == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
