"""Every registered query that has SQL must agree with it."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, duck
from tests.conftest import SMALL

STATEMENTS = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_matches_sql(spark, con, name):
    assert compare(contract.queries()[name](spark, SMALL), con, STATEMENTS[name]) == []


def test_statements_belong_to_queries():
    assert set(STATEMENTS) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "user_id" and len(df.columns) == 8
    assert df.count() > 0
