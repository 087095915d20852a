"""Every registered query against independent SQL, on whole tables."""

import pytest

import __spark_entry__ as contract
from tests.oracle_check import connect, differences
from workload.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert differences(df, con, contract.oracle_sql()[name]) == []


def test_every_query_has_sql():
    assert set(all_queries()) <= set(contract.oracle_sql())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
