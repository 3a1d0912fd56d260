"""Every query with reference SQL agrees with DuckDB; the others run."""

import pytest

import __spark_entry__ as entry
from storylens.catalog.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_reference_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_top_k_and_group_limits_are_pushed(spark):
    plan = lambda name: QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan("importance_top")
    recent = plan("outlet_recent")
    assert "WindowGroupLimit" in recent and "Partial" in recent
    assert "p_name" not in plan("blindspots")
    for name in ("blindspots", "coverage_mix", "story_articles", "user_feed"):
        assert "CartesianProduct" not in plan(name)
