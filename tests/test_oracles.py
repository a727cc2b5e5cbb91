"""Every registered query against its DuckDB twin."""

import duckdb
import pytest

import __spark_entry__ as entry
from oracles import registry, sql
from tests.conftest import SF_DIR

QUERIES = registry.queries()
ORACLES = sql.oracle_sql()
TABLES = "nation customer supplier part orders documents events".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def comparable(rows):
    return sorted(tuple(map(str, row)) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = comparable(result.fetchall())
    assert comparable(df.select(*columns).collect()) == expected
    assert expected


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 333
