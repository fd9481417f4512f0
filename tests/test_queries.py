"""Queries against the same in SQL, and every registered query once."""

import glob
import os

import duckdb
import pytest

from quern import catalogue

#: Long ones whose parts have tests of their own.
SLOW = {"stream_count_window", "generic_map_reduce"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_equals_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["word", "n"]
