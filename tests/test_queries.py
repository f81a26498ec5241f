"""Every registered query against its SQL check on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import __spark_entry__ as entry
from check import TABLES, rows

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_registry_is_complete():
    assert len(entry.queries()) >= 140 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sql, name):
    spark.catalog.clearCache()
    df = entry.queries()[name](spark, SF)
    cur = sql.execute(entry.oracle_sql()[name])
    expected = rows([d[0] for d in cur.description], cur.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
