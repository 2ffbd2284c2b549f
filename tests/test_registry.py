"""Driver contract and oracle agreement of every registered query (DuckDB, sf0.001)."""

import os

import pytest

from conftest import SF_TINY

import __spark_entry__ as E


def test_contract(spark):
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    df = E.entry(spark)
    assert df.count() > 0
    assert "action_id" in df.columns


NAMES = sorted(E.queries())
if os.environ.get("WHOLESAIL_QUICK"):
    NAMES = NAMES[:10]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    from oracle_check import compare

    res = compare(spark, SF_TINY, [name], verbose=False)[name]
    assert res.startswith("OK") or res.startswith("rows-only"), res
