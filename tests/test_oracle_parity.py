"""Every registered query equals its independent DuckDB SQL oracle.

Most run at sf0.001; the upsert family needs one row per id in the source and
runs at sf0.01 (sf0.001 has one duplicated charge id)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_MID, SF_SMALL
from tests.oracle_compare import compare, duck
from wardlake.plans.oracles import oracle_sql
from wardlake.plans.registry import QUERIES

MID = {"merge_upsert", "merge_stats", "insert_ignore", "dedupe_latest", "stream_silver_upsert", "merge_upsert_by_month", "stream_dedupe"}
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def cons():
    return {SF_SMALL: duck(SF_SMALL), SF_MID: duck(SF_MID)}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, cons, name):
    sf = SF_MID if name in MID else SF_SMALL
    compare(QUERIES[name](spark, sf), cons[sf], ORACLES[name])


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["department", "revenue", "cost", "profit"]
    assert len(rows) > 0
