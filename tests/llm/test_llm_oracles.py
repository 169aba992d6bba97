"""Text queries that have SQL, against it on the smallest given tables."""

import os

import duckdb
import pytest

from exprstudy.llm import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = catalogue.REGISTRY[name](spark, FOLDER)
    columns = sorted(frame.columns)
    cursor = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert sorted(tuple(row[c] for c in columns) for row in frame.collect()) == expected
