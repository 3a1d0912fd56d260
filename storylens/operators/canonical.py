"""The article whose title stands for a story."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectrum as S
from ..functions.dates import epoch_micros
from ..functions.text import (
    bigrams_of_normalized,
    clean_summary,
    decode_entities,
    is_other_language,
    normalize_for_match,
    tokens_of_normalized,
    weighted_similarity,
)
from ..functions.vectors import cosine
from ..plans.joins import lookup_join
from ..plans.lineage import cut
from ..plans.ranking import first_per_group
from .vector_ops import centroid

POOL = 60
UNDATED = 2**62


def canonical_article(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """One article per story: its title and cleaned summary.

    ``articles`` has story_id, article_id, outlet_id, titulo, resumen, fecha_pub and
    optionally embedding.  Titles in the other press language only compete when the story
    has no others.  With enough vectors the earliest of the most central articles wins,
    otherwise the title most similar to the story's last 60 articles.
    """
    rated = lookup_join(
        articles.filter("story_id is not null"),
        outlets.select("outlet_id", S.factuality_rank("factualidad").alias("rank")),
        "outlet_id",
        "left",
    ).withColumn("rank", F.coalesce("rank", S.factuality_rank(F.lit("media"))))
    flagged = rated.withColumn("foreign", is_other_language("titulo"))
    if "embedding" not in flagged.columns:
        flagged = flagged.withColumn("embedding", F.lit(None).cast("array<double>"))
    flagged = cut(flagged.withColumn("has_vector", F.coalesce(F.size("embedding"), F.lit(0)) > 0))
    totals = flagged.groupBy("story_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("foreign")).alias("own"),
        F.count_if("has_vector").alias("vectors"),
        F.count_if(F.col("has_vector") & ~F.col("foreign")).alias("own_vectors"),
    )
    usable = F.when(F.col("own") > 0, F.col("own_vectors")).otherwise(F.col("vectors"))
    by_vector = (F.col("vectors") >= F.greatest(F.lit(2), F.col("n") / 2)) & (usable > 0)
    stories = cut(totals.withColumn("by_vector", by_vector))
    candidates = lookup_join(flagged, stories, "story_id").filter((F.col("own") == 0) | ~F.col("foreign"))
    vector_choice = _most_central(candidates.filter("by_vector and has_vector"), flagged.filter("has_vector"))
    text_choice = _most_shared(candidates.filter("not by_vector"), flagged, stories.filter("not by_vector"))
    return (
        vector_choice.unionByName(text_choice)
        .join(flagged.select("article_id", "titulo", "resumen"), "article_id")
        .select(
            "story_id",
            "article_id",
            F.coalesce(F.nullif(decode_entities("titulo"), F.lit("")), F.lit("Sin título")).alias("titulo_canonico"),
            F.when(F.col("resumen") != "", clean_summary(decode_entities("resumen"))).alias("resumen_canonico"),
        )
    )


def _most_central(candidates: DataFrame, with_vector: DataFrame) -> DataFrame:
    """Among scores within 0.01 of the best of a story, the earliest article."""
    centers = centroid(with_vector.select("story_id", "embedding"), "story_id").select("story_id", "centroid")
    scored = cut(
        lookup_join(candidates, centers, "story_id").select(
            "story_id",
            "article_id",
            F.coalesce(epoch_micros("fecha_pub"), F.lit(UNDATED)).alias("at"),
            (cosine("embedding", "centroid") + F.col("rank") * 0.001).alias("score"),
        )
    )
    tops = scored.groupBy("story_id").agg(F.max("score").alias("top"))
    near = lookup_join(scored, tops, "story_id").filter(F.col("score") >= F.col("top") - 0.01)
    return (
        near.groupBy("story_id")
        .agg(F.min(F.struct("at", "article_id")).alias("c"))
        .select("story_id", "c.article_id")
    )


def _most_shared(candidates: DataFrame, articles: DataFrame, stories: DataFrame) -> DataFrame:
    """Highest mean title similarity to the story's last 60 articles, plus the rank bonus.

    The 60 are a bounded top-k per story, so the join grows with the articles.  Repeated
    titles of a story are scored once per (story, normalised title).
    """
    chosen = lookup_join(articles, stories.select("story_id"), "story_id")
    pool = first_per_group(
        chosen.select("story_id", "article_id", "titulo"), ["story_id"], [F.col("article_id").desc()], POOL
    )
    pool_texts = pool.select(
        "story_id", F.col("article_id").alias("other"), normalize_for_match("titulo").alias("o")
    )
    sized = pool_texts.groupBy("story_id").agg(F.count(F.lit(1)).alias("size"))
    weights = pool_texts.groupBy("story_id", "o").agg(F.count(F.lit(1)).alias("times"))
    titled = candidates.select(
        "story_id", "article_id", "rank", normalize_for_match("titulo").alias("t")
    )
    unique = titled.select("story_id", "t").distinct()

    def sets(name: str) -> list:
        return [tokens_of_normalized(F.col(name)).alias(f"{name}_tokens"), bigrams_of_normalized(F.col(name)).alias(f"{name}_bigrams")]

    pairs = unique.select("*", *sets("t")).join(weights.select("*", *sets("o")), "story_id")
    sums = pairs.groupBy("story_id", "t").agg(
        F.sum(
            F.col("times")
            * weighted_similarity(F.col("t_tokens"), F.col("t_bigrams"), F.col("o_tokens"), F.col("o_bigrams"))
        ).alias("total")
    )
    # A candidate inside the pool is not compared with itself.
    self_score = F.when(F.size(tokens_of_normalized(F.col("t"))) > 0, F.lit(0.55)).otherwise(0.0) + F.when(
        F.size(bigrams_of_normalized(F.col("t"))) > 0, F.lit(0.45)
    ).otherwise(0.0)
    inside = pool.select("story_id", "article_id", F.lit(True).alias("inside"))
    score = (
        F.col("total") - F.when(F.col("inside"), self_score).otherwise(0.0)
    ) / F.greatest(F.lit(1), F.col("size") - 1) + F.col("rank") * 0.01
    return (
        titled.join(sums, ["story_id", "t"])
        .join(sized, "story_id")
        .join(inside, ["story_id", "article_id"], "left")
        .groupBy("story_id")
        .agg(F.min(F.struct((-F.round(score, 9)).alias("s"), "article_id")).alias("c"))
        .select("story_id", "c.article_id")
    )
