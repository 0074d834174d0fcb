"""Every registered query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

from conftest import DATA, ROOT

sys.path.insert(0, os.path.join(ROOT, "tools"))
import compare  # noqa: E402
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, DATA)
    cur = duck.execute(oracle_sql()[name])
    assert compare.normal(df.columns, df.collect()) == compare.normal([c[0] for c in cur.description], cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_flagship(spark):
    assert entry(spark).count() > 3
