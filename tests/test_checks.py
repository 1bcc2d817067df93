"""Every query with SQL gives the rows of the SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.run_checks import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
# Too long for every test run; run_checks.py covers it.
SLOW = {"prepare_train"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_with_sql_is_registered():
    assert set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query(spark, con, name):
    assert compare(contract.queries()[name](spark, SF_DIR), con, ORACLES[name]) == ""


def test_entry(spark):
    assert contract.entry(spark).count() > 0
