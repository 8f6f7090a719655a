"""Every query against its SQL counterpart on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
spec = importlib.util.spec_from_file_location("smoke", f"{HERE}/tools/smoke.py")
smoke = importlib.util.module_from_spec(spec)
spec.loader.exec_module(smoke)
ROOT = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in smoke.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return connection


def test_every_statement_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, ROOT)
    rows = [tuple(r) for r in frame.collect()]
    if name not in SQL:
        assert rows
        return
    result = db.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert smoke.canonical(frame.columns, rows) == smoke.canonical(columns, result.fetchall())
