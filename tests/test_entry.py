"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.catalog import QUERIES, SQL


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    frame = QUERIES[name](spark, data)
    names = sorted(frame.columns)
    expected = con.sql(SQL[name]).df()
    assert sorted(expected.columns) == names
    got = sorted(map(repr, map(tuple, frame.select(names).collect())))
    told = sorted(map(repr, con.sql(f"select {', '.join(names)} from ({SQL[name]})").fetchall()))
    assert got == told
