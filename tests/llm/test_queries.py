"""Registered queries against their SQL."""

import os

import pytest

import __spark_entry__ as contract
from dosegrid.llm.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, len(QUERIES) + 1))
    assert QUERIES.keys() <= contract.queries().keys() and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF_DIR)
    expected = sql.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [list(expected.columns).index(c) for c in columns]
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(str(r[i]) for i in at) for r in expected.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_has_its_columns(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert "doc_id" in df.columns and df.count() >= 0
