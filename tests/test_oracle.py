"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

from workload.oracle import ORACLE_SQL
from workload.queries import QUERIES
from workload.views import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, sf, name):
    found = QUERIES[name](spark, sf).toArrow()
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(found.column_names) == sorted(columns)
    got = [tuple(row[c] for c in columns) for row in found.to_pylist()]
    assert got, "query returned nothing"
    assert sorted(got, key=repr) == sorted(expected, key=repr)
