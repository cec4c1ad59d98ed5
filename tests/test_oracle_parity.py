"""Every registered query equals its DuckDB oracle on the small fixture."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duckdb_con
from tallyloom.plans import registry
from tests.conftest import SF_SMALL

KEYS = sorted(registry.QUERIES)  # the corpus operators are tested in tests/llm


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], E.oracle_sql().get(key), SF_SMALL)
    assert r["status"] == "ok", r


def test_every_key_has_an_oracle():
    assert set(registry.QUERIES) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "revenue" in df.columns
