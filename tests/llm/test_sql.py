"""The llm queries that SQL can express, against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from palimpsest.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found, wanted = queries.QUERIES[name](spark, FOLDER), con.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    order = sorted(found.columns)
    assert sorted(tuple(str(r[c]) for c in order) for r in found.collect()) == sorted(tuple(str(r[wanted.columns.index(c)]) for c in order) for r in wanted.fetchall())
