"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from purlin.session import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = {n: s for n, s in entry.oracle_sql().items() if not n.startswith(("op", "pipeline"))}


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str([plain(v) for v in value]) if isinstance(value, (list, tuple)) else str(value)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(want.columns)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
