"""Every plain query with SQL gives the rows DuckDB gives."""

import glob
import os

import duckdb
import pytest

from meshline.plans import queries


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, db, name):
    frame = queries.QUERIES[name](spark, sf)
    found = frame.collect()
    if name in queries.ORACLE_SQL:
        expected = db.sql(queries.ORACLE_SQL[name])
        assert sorted(frame.columns) == sorted(expected.columns)
        assert rows(frame.columns, [tuple(r) for r in found]) == rows(expected.columns, expected.fetchall())
    else:
        assert found


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
