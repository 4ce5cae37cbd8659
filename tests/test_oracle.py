"""Every registered query against its DuckDB statement, values and types."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as contract
from starmart.checks.oracle_sql import statements
from tests.conftest import DATA

FOLDER = os.environ.get("TEST_SF_DIR", f"{DATA}/sf0.01")
RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "string": "VARCHAR",
    "date": "DATE",
    "double": "DOUBLE",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in RAW:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    yield connection
    connection.close()


def _plain(value):
    if isinstance(value, float):
        return ("number", repr(value))
    if isinstance(value, datetime.date):
        return ("date", value.isoformat())
    return ("none",) if value is None else (type(value).__name__, value)


def _sorted(rows, order):
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(statements()) <= set(contract.oracle_sql())


CARRIED = [name for name in contract.oracle_sql() if name.startswith("carried_")]


@pytest.mark.parametrize("name", [*sorted(statements()), *CARRIED])
def test_query_matches_sql(spark, duck, name):
    ours = contract.queries()[name](spark, FOLDER)
    theirs = duck.execute(contract.oracle_sql()[name])
    theirs_columns = {d[0]: str(d[1]) for d in theirs.description}
    ours_columns = {f.name: KINDS[f.dataType.simpleString()] for f in ours.schema.fields}
    assert ours_columns == theirs_columns

    names = sorted(ours_columns)
    expected = _sorted(theirs.fetchall(), [list(theirs_columns).index(n) for n in names])
    actual = _sorted(ours.collect(), [ours.columns.index(n) for n in names])
    assert len(actual) == len(expected)
    assert actual == expected
    assert actual
