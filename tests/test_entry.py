import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, compare

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    return connection


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["table_name", "ordinal", "column_name", "data_type", "issues"]
    assert found.count() > 0


def test_every_query_has_rows_and_every_sql_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_its_sql(spark, oracle, name):
    outcome = compare(spark, oracle, name, entry.queries()[name], entry.oracle_sql().get(name), ROOT)
    assert outcome.startswith(("ok", "rows-only")), outcome
