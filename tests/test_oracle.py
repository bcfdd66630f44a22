"""Registered queries against their SQL on the smallest given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from faktorium import plans

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.load()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_point(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["invoice_id", "vat_code", "row_kind", "net", "tax", "gross"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    actual = sorted(repr(tuple(row[c] for c in columns)) for row in result.collect())
    answer = database.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in order)) for row in answer.fetchall())
    assert actual and actual == expected
