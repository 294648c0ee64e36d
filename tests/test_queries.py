"""Every registered query against its check statement on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyframe.plans.catalog import QUERIES
from tallyframe.plans.fixtures import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9) + 0.0
        return v

    cut = [tuple(value(row[i]) for i in order) for row in rows]
    return sorted(cut, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    query = QUERIES[name]
    df = query.run(spark, SF_DIR)
    rows = [tuple(row) for row in df.collect()]
    assert query.sql is not None
    cursor = duck.execute(query.sql)
    columns = [column[0] for column in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = {column[0]: str(column[1]) for column in cursor.description}
    assert {n: KINDS[t] for n, t in df.dtypes} == kinds
    assert canonical(df.columns, rows) == canonical(columns, cursor.fetchall())
    assert rows
