"""The driver contract: every query runs, and those with SQL agree with DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ridgeflow import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def plain(row):
    return repr(tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    expected = [tuple(r[i] for i in order) for r in found.fetchall()]
    assert sorted(map(plain, rows)) == sorted(map(plain, expected))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
