"""Every registered query against its check SQL on the smallest tables."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from check import compare, connect
from txtrail.plans.catalog import QUERIES
from txtrail.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check_sql(spark, duck, name):
    assert compare(spark, duck, SMALL, name).startswith("ok")


def test_entry_covers_all_matched_transactions(spark):
    assert entry.entry(spark).count() == 1473
