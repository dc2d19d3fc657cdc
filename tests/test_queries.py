"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from orderlines.plans.oracle import ORACLE_SQL

DATA = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "part", "events")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    result = duck.execute(ORACLE_SQL[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((repr(tuple(row)) for row in result.fetchall()))
    assert sorted(repr(tuple(row)) for row in df.select(*names).collect()) == expected


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 150
