"""Every query of the library against its SQL, and the contract of the entry module."""

import pytest
from oracle import SF, same

import __spark_entry__ as entry
from meritgraph.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name], SF)


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
