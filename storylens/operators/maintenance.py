"""Batch rewrites of story state.  Each job returns new snapshots as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relevance import is_low_value
from ..functions.text import decode_entities, has_entities
from ..functions.dates import minus
from ..plans.joins import hot_lookup, lookup_join
from .coverage import story_rollup


def recompute_stories(stories: DataFrame, articles: DataFrame, outlets: DataFrame, as_of=None, days: int = 14) -> DataFrame:
    """Counts, dates and importance of stories active in the last days (all without ``as_of``).

    Only articles of affected stories reach the aggregation.
    """
    affected = stories.select("story_id") if as_of is None else stories.filter(
        F.col("last_pub") >= minus(as_of, f"{days} days")
    ).select("story_id")
    return story_rollup(articles.join(affected, "story_id", "left_semi"), outlets)


def split_low_value(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles to keep and articles to delete."""
    low = is_low_value("titulo", "resumen")
    return articles.filter(~low), articles.filter(low)


def prune_low_value(articles: DataFrame, outlets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept articles, recomputed touched stories and ids of emptied stories."""
    kept, deleted = split_low_value(articles)
    touched = deleted.filter("story_id is not null").select("story_id").distinct()
    recomputed = story_rollup(kept.join(touched, "story_id", "left_semi"), outlets)
    emptied = touched.join(kept.select("story_id"), "story_id", "left_anti")
    return kept, recomputed, emptied


def prune_counts(articles: DataFrame) -> DataFrame:
    """Deleted articles, touched and emptied stories, with the rules run once per article."""
    judged = articles.select("story_id", is_low_value("titulo", "resumen").alias("low"))
    per_story = judged.groupBy("story_id").agg(
        F.count_if("low").alias("low"), F.count(F.lit(1)).alias("n")
    )
    real = F.col("story_id").isNotNull() & (F.col("low") > 0)
    return per_story.agg(
        F.coalesce(F.sum("low"), F.lit(0)).alias("deleted"),
        F.count_if(real).alias("stories_touched"),
        F.count_if(real & (F.col("low") == F.col("n"))).alias("stories_removed"),
    )


def check_merge_pairs(pairs: DataFrame, stories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid (target, source) pairs, and rejected pairs with a reason.

    A story may be merged away once and may not also be the target of another pair in the
    same run, so that the result does not depend on an order of pairs.
    """
    known = stories.select(F.col("story_id").cast("string").alias("_id"), F.lit(True).alias("_known")).hint("merge")
    keyed = pairs.select("target", "source").withColumn("_t", F.trim(F.col("target").cast("string"))).withColumn(
        "_s", F.trim(F.col("source").cast("string"))
    )
    # Ids are judged once each; many pairs may name the same one, so the pairs look it up by salted joins.
    sources = keyed.groupBy("_s").agg(F.min("_t").alias("_only"), F.max(F.col("_t") != F.col("_s")).alias("_moves"))
    moved = sources.filter("_moves").select(F.col("_s").alias("_as_source")).hint("merge")
    by_source = sources.join(known, F.col("_s") == F.col("_id"), "left").select("_s", "_only", F.col("_known").alias("_ks"))
    by_target = (
        keyed.select("_t").distinct()
        .join(known, F.col("_t") == F.col("_id"), "left")
        .join(moved, F.col("_t") == F.col("_as_source"), "left")
        .select("_t", F.col("_known").alias("_kt"), "_as_source")
    )
    checked = (
        hot_lookup(hot_lookup(keyed, by_source, "_s"), by_target, "_t")
        .withColumn(
            "reason",
            F.when(F.coalesce("_t", F.lit("")) == "", "blank_id")
            .when(F.coalesce("_s", F.lit("")) == "", "blank_id")
            .when(F.col("_t") == F.col("_s"), "same_story")
            .when(F.col("_kt").isNull(), "unknown_target")
            .when(F.col("_ks").isNull(), "unknown_source")
            .when(F.col("_t") != F.col("_only"), "source_has_other_target")
            .when(F.col("_as_source").isNotNull(), "target_is_merged_away"),
        )
    )
    valid = checked.filter("reason is null").select("target", "source").distinct()
    return valid, checked.filter("reason is not null").select("target", "source", "reason")


def merge_stories(articles: DataFrame, outlets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move articles of each source to its target; new articles and recomputed targets."""
    mapping = pairs.select(F.col("source").alias("story_id"), F.col("target").alias("_target"))
    moved = lookup_join(articles, mapping, "story_id", "left").withColumn(
        "story_id", F.coalesce("_target", "story_id")
    ).drop("_target").select(*articles.columns)
    targets = pairs.select(F.col("target").alias("story_id")).distinct()
    return moved, story_rollup(moved.join(targets, "story_id", "left_semi"), outlets)


def duplicate_title_pairs(stories: DataFrame) -> DataFrame:
    """Merge pairs for stories with the same canonical title; the lowest id is kept."""
    keep = stories.groupBy("titulo_canonico").agg(F.min("story_id").alias("target"))
    return (
        stories.join(keep, "titulo_canonico")
        .filter("story_id <> target")
        .select("target", F.col("story_id").alias("source"))
    )


def clean_entities(articles: DataFrame, columns: list[str] = ("titulo", "resumen")) -> DataFrame:
    """Decode entities left in stored texts; other rows pass unchanged."""
    out = articles
    for name in columns:
        out = out.withColumn(name, F.when(has_entities(name), decode_entities(name)).otherwise(F.col(name)))
    return out
