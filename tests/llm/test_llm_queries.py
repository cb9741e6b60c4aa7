"""The package's queries against their SQL, and by what they must hold."""

from __future__ import annotations

import pytest
from compare import differs, duck

from rillstone.llm import plans


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf, con):
    got = plans.QUERIES[name](spark, sf).toPandas()
    if name in plans.ORACLES:
        assert differs(got, con.execute(plans.ORACLES[name]).fetchdf()) == ""
    else:
        assert len(got) > 0


def test_columns(spark, sf):
    want = {"p2_found": ["movie_a", "movie_b"], "p4_found": ["pair_id", "defect"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "start_char", "end_char"]}
    assert {n: plans.QUERIES[n](spark, sf).columns for n in want} == want
