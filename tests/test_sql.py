"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SQL = {k: v for k, v in entry.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck(tiny):
    c = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return f"{float(v) + 0.0:.9g}" if isinstance(v, (float, Decimal)) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tiny, duck, name):
    got = entry.queries()[name](spark, tiny)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_every_query_of_sql_is_registered():
    assert set(SQL) <= set(entry.queries())
