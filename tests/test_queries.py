"""Registered queries against their SQL, over the smallest tables."""

import os

import duckdb
import pytest

from faultgrain.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "events", "documents", "conversations")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL.keys()))
def test_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)
    assert sorted(names) == columns and found == expected


def test_entry_imports_without_optional_parts():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.queries().keys() >= QUERIES.keys()
