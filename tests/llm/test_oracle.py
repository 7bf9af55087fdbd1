"""Registered queries against their SQL, and all of them over empty tables."""

import duckdb
import pytest

from shelflight.llm.queries import ORACLE_SQL, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    found = QUERIES[name](spark, sf).toArrow()
    assert sorted(found.column_names) == sorted(columns)
    got = [tuple(row[c] for c in columns) for row in found.to_pylist()]
    assert got and sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, sf, tmp_path, name):
    for table in TABLES:
        spark.read.parquet(f"{sf}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
