"""Every registered query against its DuckDB formulation (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, _rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == _rows(cols, res.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "complexity" in df.columns


def test_every_code_query_has_an_oracle():
    from codeweave.registry import oracle_queries, spark_queries
    assert set(spark_queries()) == set(oracle_queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
