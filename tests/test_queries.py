"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabulith import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([str(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    other = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    found, expected = [tuple(r) for r in df.collect()], other.fetchall()
    strip = lambda r: tuple(x.replace(tzinfo=None) if hasattr(x, "tzinfo") and x.tzinfo else x for x in r)
    assert rows(df.columns, map(strip, found)) == rows(other.columns, map(strip, expected))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows_only(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
