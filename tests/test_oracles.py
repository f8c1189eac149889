"""Every registered query against its DuckDB twin."""

import pytest
from oracle_check import difference, duck

import __spark_entry__ as contract
from sqlcorpus.registry.duck_oracles import ORACLES
from sqlcorpus.registry.spark_queries import QUERIES

NAMES = sorted(contract.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(NAMES) <= set(contract.queries())


@pytest.mark.parametrize("name", NAMES)
def test_equal(name, spark, sf, con):
    assert difference(contract.queries()[name](spark, sf), con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).columns == ["split", "section", "name", "stat", "value"]
