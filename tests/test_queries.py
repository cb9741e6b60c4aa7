"""Every registered query of the core against its SQL in DuckDB; those without SQL must at least run."""

from __future__ import annotations

import pytest
from compare import differs, duck

from rillstone.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf, con):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        assert differs(got, con.execute(registry.ORACLES[name]).fetchdf()) == ""
    else:
        assert len(got.columns) > 0


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLES) <= set(e.oracle_sql())
