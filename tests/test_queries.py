"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from compare import TABLES, same
from holdfast.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR

@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return found


def test_all_queries_have_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = connection.execute(ORACLES[name])
    assert same(df, cursor.fetchall(), [d[0] for d in cursor.description]) == ""
