import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in ("events", "conversations"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, tables, key):
    df = catalogue.QUERIES[key](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = tables.sql(catalogue.ORACLE_SQL[key])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert mine == sorted(repr(tuple(row[i] for i in at)) for row in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
