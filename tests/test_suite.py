"""Every registered query against its SQL statement on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from suite.check import rows_of
from suite.domain import DRIVER_TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = oracle.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 15
