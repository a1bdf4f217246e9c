"""Every registered query against its SQL in DuckDB, on the smallest test tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from workload.data import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    assert rows, "no rows"
    if name not in SQL:
        return
    relation = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    order = [relation.columns.index(c) for c in df.columns]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in rows) == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "column"


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
