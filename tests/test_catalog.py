import math

import duckdb
import pytest

from quillstone.plans import catalog

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{BASE}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, BASE)
    columns = sorted(found.columns)
    wanted = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    right = sorted(tuple(plain(row[i]) for i in at) for row in wanted.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in found.collect()) == right
