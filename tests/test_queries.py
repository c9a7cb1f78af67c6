"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LIBRARY = sorted(entry._library.QUERIES)


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([normal(r[i]) for i in order]) for r in found)


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return db


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", LIBRARY)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert found
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
