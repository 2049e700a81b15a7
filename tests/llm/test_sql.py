"""The registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import collections
import glob
import os

import duckdb
import pytest

from leafmill.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    want = collections.Counter(found.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())
    assert collections.Counter(tuple(r) for r in got.select(*columns).collect()) == want
