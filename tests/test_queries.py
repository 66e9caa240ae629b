"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as contract
from fleetscope.plans.testbed import QUERIES
from fleetscope.plans.twin_sql import SQL
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, small, con, name):
    assert differences(contract.queries()[name](spark, small), con, contract.oracle_sql()[name]) == []


def test_comparison_notices_a_changed_value(spark, small, con):
    df = contract.queries()["value_range"](spark, small).selectExpr("min_value + 1 AS min_value", "max_value")
    assert differences(df, con, contract.oracle_sql()["value_range"])


def test_entry(spark):
    assert contract.entry(spark).count() == 15
