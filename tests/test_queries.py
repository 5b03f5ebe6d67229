"""Every registered query runs; every one with SQL equals DuckDB."""

import pytest
from compare import compare, duck
from conftest import FOLDER

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"set_02_difference", "fil_02_class_filter"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    message = compare(QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert message is None or (name in MAY_BE_EMPTY and message.startswith("EMPTY")), message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert {r["head"] for r in entry.entry(spark).collect()} == {
        "raw", "embed", "combined", "external"}
