"""Answers that lie behind hundreds of more important or newer stories are found."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from storylens.functions import text as T
from storylens.operators import blindspots as B
from storylens.operators import search as SR
from storylens.operators import stories as ST
from storylens.operators import trending as TR

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def coverage(spark):
    """700 balanced stories, newest and most important first, and one last story that only the right covers."""
    rows = [
        (i, 8, 8, 1000 - i, dt.datetime(2024, 1, 31, 23) - dt.timedelta(minutes=i), 33, 34, 33, 3, 3, 3)
        for i in range(700)
    ]
    rows.append((700, 4, 4, 5, dt.datetime(2024, 1, 30), 0, 10, 90, 0, 1, 5))
    return spark.createDataFrame(
        rows,
        "story_id long, outlet_count int, article_count int, importance int, last_pub timestamp, "
        "izq_pct int, centro_pct int, der_pct int, izq int, centro int, der int",
    ).cache()


def test_blindspot_of_little_importance(coverage):
    assert [r.story_id for r in B.blindspots(coverage, AS_OF).collect()] == [700]
    assert [r.story_id for r in B.blindspots(coverage, AS_OF, limit=1).collect()] == [700]


def test_brief_searches_all_stories(coverage):
    assert {r.side: r.story_id for r in B.side_brief(coverage).collect()} == {
        "izquierda": 0, "centro": 1, "derecha": 700,
    }


def test_ranking_covers_all_stories(coverage):
    raised = coverage.withColumn("importance", F.when(F.col("story_id") == 700, 10**6).otherwise(F.lit(1)))
    ranked = SR.hybrid_rank(raised, AS_OF).orderBy("position").collect()
    assert [r.position for r in ranked] == list(range(1, 702)) and ranked[0].story_id == 700
    plain = SR.hybrid_score(raised, AS_OF).collect()
    order = sorted(plain, key=lambda r: (-r.score, -r.last_pub.timestamp(), -r.importance, r.story_id))
    assert [r.story_id for r in ranked] == [r.story_id for r in order]


def test_pages_have_no_last_number(coverage):
    listed = SR.page(coverage.orderBy("story_id"), 351, 2).collect()
    assert [(r.story_id, r.position, r.has_more) for r in listed] == [(700, 701, False)]


def test_pools_hold_all_open_stories(spark, coverage):
    outlets = spark.createDataFrame([("a", True), ("b", False)], "slug string, active boolean")
    assert ST.open_pool(coverage, AS_OF).count() == 701
    assert ST.open_pool(coverage, AS_OF, n=10).count() == 10
    assert ST.indexable(coverage, outlets, AS_OF).count() == 702
    assert TR.trending_titles(coverage, AS_OF).count() == 701


def test_search_inputs_are_whole(spark):
    slugs = [f"outlet-{i}" for i in range(60)]
    row = spark.createDataFrame([("word " * 100, ",".join(slugs))], "term string, slugs string").select(
        T.sanitize_search("term").alias("term"), T.parse_slugs("slugs").alias("slugs")
    ).first()
    assert row.term == ("word " * 100).strip() and row.slugs == slugs
