"""Every oracle SQL plans in DuckDB, and names the same columns as its Spark query."""

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_oracle_columns_match_query(spark, con, key):
    sql_cols = con.sql(E.oracle_sql()[key]).limit(0).columns
    spark_cols = E.queries()[key](spark, SF).columns
    assert sorted(sql_cols) == sorted(spark_cols)
