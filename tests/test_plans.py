"""Ranks over whole tables, windows made of panes, bit maps of sets and links between blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from storylens.operators.maintenance import clean_entities
from storylens.operators.similarity import article_story_match
from storylens.plans import prefix_join
from storylens.plans.global_rank import global_rank
from storylens.streaming.articles import coverage_window, sliding_totals

T0 = dt.datetime(2024, 1, 1)


def test_global_rank_equals_sorting_and_splits_ties(spark):
    rows = [(i, 0.5 if i % 2 else round(random.Random(i).random(), 2), None if i % 7 == 0 else i % 11) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, score double, day int").repartition(8)
    order = [F.col("score").desc(), F.col("day").asc_nulls_first(), F.col("id").desc()]
    got = {r.id: r.rank for r in global_rank(df, order).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[2] is not None, r[2] or 0, -r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)}
    # Half of all rows share a score; no partition holds more than twice its share of them.
    parts = df.repartitionByRange(4, *order).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) <= 2 * len(rows) / 4
    assert global_rank(df.limit(0), order).collect() == []


def test_sliding_totals_equal_overlapping_windows(spark):
    r = random.Random(2)
    rows = [(T0 + dt.timedelta(minutes=r.choice([r.randint(0, 600), r.randint(0, 30000)])), r.choice("ab"), r.randint(1, 5)) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, "a", 1)], "ts timestamp, k string, v int")
    got = sliding_totals(df, "ts", ["k"], {"n": F.count(F.lit(1)), "total": F.sum("v")}, 12)
    want = df.groupBy(F.window("ts", "12 hours", "1 hour").alias("w"), "k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    assert sorted(got.select("start", "k", "n", "total").collect()) == sorted(want.select("w.start", "k", "n", "total").collect())
    native = coverage_window(df.filter("ts is not null"), "ts", ["k"], "12 hours", "1 hour")
    assert sorted(got.select("start", "k", "n").collect()) == sorted(native.select("window.start", "k", "n").collect())
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("words", [1, 8])
def test_bit_maps_lose_no_pair(spark, words, monkeypatch):
    monkeypatch.setattr(prefix_join, "WORDS", words)
    r = random.Random(4)
    texts = {i: sorted({f"w{r.randint(0, 60)}" for _ in range(r.randint(1, 14))}) for i in range(120)}
    texts = {i: t for i, t in texts.items() if list(texts.values()).index(t) == list(texts).index(i)}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, tokens array<string>")
    found = {tuple(p) for p in prefix_join.candidate_pairs(df, {"t:": ("tokens", 1.0)}, 0.4).collect()}
    sets = {i: set(t) for i, t in texts.items()}
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.4}
    assert true and true <= found
    if words == 8:  # 512 bits for a dozen words: hardly any other pair is left
        assert len(found) <= 2 * len(true)


def test_article_story_match_keeps_to_its_window(spark):
    articles = [(1, "incendio forestal provincia", "", 1, T0), (2, "huelga transporte", "", 1, T0), (3, "volcan isla", "", 2, T0)]
    stories = [
        (10, "incendio forestal provincia", "", T0 + dt.timedelta(hours=73)), (11, "incendio forestal provincia hoy", "", T0 - dt.timedelta(hours=72)),
        (12, "huelga transporte", "", T0 + dt.timedelta(hours=1)), (13, "huelga transporte", "", T0),
    ]
    got = article_story_match(
        spark.createDataFrame(articles, "article_id long, titulo string, resumen string, outlet_id long, fecha_pub timestamp"),
        spark.createDataFrame(stories, "story_id long, titulo_canonico string, resumen_canonico string, last_pub timestamp"),
    ).collect()
    found = {r.article_id: r.story_id for r in got}
    # The first is too far from its best story, equal scores go to the lowest id, the third has none.
    assert found == {1: 11, 2: 12}


def test_clean_entities_decodes_stored_texts(spark):
    df = spark.createDataFrame([(1, "Paz &amp; pan", None), (2, "sin marcas", "a &#233; b")], "id long, titulo string, resumen string")
    assert [tuple(r) for r in clean_entities(df).orderBy("id").collect()] == [(1, "Paz & pan", None), (2, "sin marcas", "a é b")]
