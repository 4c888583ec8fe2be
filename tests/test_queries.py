"""Every query with SQL gives the same rows in DuckDB; the others give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import DATA

QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
OWN = sorted(n for n in SQL if not n.startswith("op") and n != "pipeline")
SCANS = sorted(n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    other = duck.sql(SQL[name])
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in other.fetchall())
    assert mine == theirs
    assert mine or name == "anti_referenced"


@pytest.mark.parametrize("name", SCANS)
def test_scan_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["region_id", "n_blocks", "owned_area"]
    assert df.count() > 0
