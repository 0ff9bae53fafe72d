"""Queries with SQL give the rows DuckDB gives."""

import glob
import os

import duckdb
import pytest

from meshline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    frame, expected = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(expected.columns)
    columns = sorted(frame.columns)
    assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == sorted(tuple(r) for r in expected.select(*columns).fetchall())
