"""Every query that has SQL gives the same rows in DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from furrow import queries as library

NAMES = sorted(library.queries())


def rows_of(values):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in values)


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, small, db, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    sql = entry.oracle_sql()[name]
    got = rows_of(tuple(r[c] for c in columns) for r in df.collect())
    assert got
    assert got == rows_of(db.sql(f"select {', '.join(columns)} from ({sql})").fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    assert df.count() > 0
