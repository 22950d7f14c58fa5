"""Every registered job against its DuckDB twin on the smallest tables."""

import pytest

from conftest import SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as entry_mod

NAMES = sorted(entry_mod.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    """The operators of the inventory have one each; tests/llm says which of the others have none."""
    missing = set(entry_mod.queries()) - set(entry_mod.oracle_sql())
    assert missing <= set(entry_mod._LLM_QUERIES) | {"pipeline"}
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF_SMALL, name, con)
    assert r.get("cols_match") and r.get("values_match"), r


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["email", "hits", "first_page_id", "last_page_id", "source_url"]
    assert df.count() > 0
