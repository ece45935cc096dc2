"""Every registered query at sf0.001: against DuckDB where there is SQL, else for rows."""

import pytest

import __spark_entry__ as contract
from tests import oracle

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(oracle.DEFAULT_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    _, message = oracle.compare(spark, duck, QUERIES[name], SQL.get(name), oracle.DEFAULT_DIR)
    assert message == ""


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
