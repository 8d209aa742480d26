"""Every registered query of the problems that has SQL, against it, on the smallest tables."""

import os

import duckdb
import pytest

from lodesift.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, oracle, name):
    got = QUERIES[name](spark, SMALL)
    expected = oracle.execute(SQL[name])
    order = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(order)
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(map(repr, expected.fetchall()))
