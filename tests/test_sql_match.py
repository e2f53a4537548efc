"""Every registered query against the same question in SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = contract.queries()
SQL = contract.oracle_sql()
SCALE = os.environ.get("MATCH_SF", "sf0.01")


@pytest.fixture(scope="module")
def duck(testdata):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{testdata}/{SCALE}/{name}.parquet')"
        )
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9f}"
    return str(value)


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(record[i]) for i in order) for record in records)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, testdata, name):
    result = QUERIES[name](spark, f"{testdata}/{SCALE}")
    expected = duck.execute(SQL[name])
    expected_names = [column[0] for column in expected.description]
    expected_kinds = {column[0]: str(column[1]) for column in expected.description}
    assert sorted(result.columns) == sorted(expected_names)
    same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: same[t] for c, t in result.dtypes} == expected_kinds
    assert rows_of(result.columns, result.collect()) == rows_of(expected_names, expected.fetchall())
