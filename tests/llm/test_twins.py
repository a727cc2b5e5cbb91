"""The operators that SQL expresses, against their DuckDB twins."""

import duckdb
import pytest

from cartulary.llm import queries
from tests.conftest import SF_DIR

TWINS = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = duck.execute(TWINS[name])
    columns = [d[0] for d in result.description]
    df = queries.queries()[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(tuple(map(str, row)) for row in result.fetchall())
    assert sorted(tuple(map(str, row)) for row in df.select(*columns).collect()) == expected
    assert expected
