"""Every registered query against DuckDB on the same files."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from errorloom.plans.registered import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    return db


def normal(rows, names, order):
    positions = [names.index(name) for name in order]
    picked = [tuple(row[position] for position in positions) for row in rows]
    return sorted(picked, key=lambda row: tuple((value is None, str(value)) for value in row))


KINDS = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR)
    expected = duck.execute(contract.oracle_sql()[name])
    names = [column[0] for column in expected.description]
    rows = expected.fetchall()
    kinds = {d[0]: str(d[1]) for d in duck.execute("describe " + contract.oracle_sql()[name]).fetchall()}
    assert sorted(got.columns) == sorted(names)
    assert {c: KINDS[t] for c, t in got.dtypes} == kinds
    order = sorted(names)
    assert rows, "an oracle without rows checks nothing"
    assert normal([tuple(row) for row in got.collect()], got.columns, order) == normal(rows, names, order)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(contract.oracle_sql())
