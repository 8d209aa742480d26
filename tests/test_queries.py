"""Every registered core query against its SQL on the smallest tables, as names, rows and values."""

import os

import duckdb
import pytest

import __spark_entry__
from lodesift.plans.registry import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(x):
    return round(x, 8) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, oracle, name):
    got = QUERIES[name](spark, SMALL)
    expected = oracle.execute(SQL[name])
    order = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(order)
    rows = [tuple(plain(r[c]) for c in order) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in expected.fetchall())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns and set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries())
