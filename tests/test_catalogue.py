"""Every query with SQL against DuckDB, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_matches_sql(spark, tables, name):
    df = core.QUERIES[name](spark, FOLDER)
    wanted = tables.sql(core.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(wanted.columns, wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
