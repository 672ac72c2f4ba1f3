"""Every registered query against its SQL, on the smallest tables."""

import pytest
from parity import compare, connect

import __spark_entry__ as entry
from logweave.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


# the training-data queries have no SQL; their tests are elsewhere
@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_parity(spark, sf, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.oracle_sql())
