"""Every query with SQL, compared on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.frames import TABLES
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, key):
    note, _, ok = compare(spark, con, key, FOLDER)
    assert ok, note


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
