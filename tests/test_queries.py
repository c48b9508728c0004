"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql
from logwarden.plans.queries import REGISTRY
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
EMPTY_HERE = {"alerts_above_p99"}  # may be empty on so few rows


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    diff = compare(spark, duck, name, REGISTRY[name], oracle_sql()[name], SF)
    assert diff is None or (diff == "empty result" and name in EMPTY_HERE), diff


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
