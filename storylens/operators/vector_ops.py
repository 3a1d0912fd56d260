"""Group statistics on vectors: centroids, linkage, outliers, central articles."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_entities
from ..functions.vectors import cosine, dot, unit
from ..plans.joins import lookup_join
from ..plans.ranking import first_per_group


def centroid(vectors: DataFrame, group: str, embedding: str = "embedding") -> DataFrame:
    """Component-wise mean per group: one buffer of the dimension per group and task."""
    return (
        vectors.filter(F.col(embedding).isNotNull())
        .select(group, array_to_vector(F.col(embedding).cast("array<double>")).alias("_v"))
        .groupBy(group)
        .agg(Summarizer.mean(F.col("_v")).alias("_mean"), F.count(F.lit(1)).alias("n"))
        .select(group, "n", vector_to_array("_mean").alias("centroid"))
    )


def unit_sums(vectors: DataFrame, group: str, embedding: str = "embedding") -> DataFrame:
    """Sum of unit vectors and size per group."""
    return (
        vectors.filter(F.col(embedding).isNotNull())
        .select(group, array_to_vector(unit(embedding)).alias("_v"))
        .groupBy(group)
        .agg(Summarizer.sum(F.col("_v")).alias("_sum"), F.count(F.lit(1)).alias("n"))
        .select(group, "n", vector_to_array("_sum").alias("unit_sum"))
    )


def entity_counts(articles: DataFrame, group: str, title: str = "titulo") -> DataFrame:
    """Titles per entity in each group, with the group's size."""
    sizes = articles.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    counts = (
        articles.select(group, F.explode(title_entities(title)).alias("entity"))
        .groupBy(group, "entity")
        .agg(F.count(F.lit(1)).alias("titles"))
    )
    return counts.join(sizes, group)


def protagonist_strength(counts: DataFrame, group: str, min_share: float = 0.2) -> DataFrame:
    """(a, b, strength) for groups that share an entity named in ``min_share`` of both.

    Weaker mentions cannot reach the strength merging needs, so they are dropped before
    the join; what is left per entity are groups that are largely about it.
    """
    shares = counts.select(
        group, "entity", (F.col("titles") / F.col("size")).alias("share")
    ).filter(F.col("share") >= min_share)
    a = shares.select(F.col(group).alias("a"), "entity", F.col("share").alias("share_a"))
    b = shares.select(F.col(group).alias("b"), "entity", F.col("share").alias("share_b"))
    return (
        a.join(b, "entity")
        .filter("a < b")
        .groupBy("a", "b")
        .agg(F.max(F.least("share_a", "share_b")).alias("strength"))
    )


def average_linkage(vectors: DataFrame, group: str, pairs: DataFrame) -> DataFrame:
    """Mean cosine between all members of two groups, from one sum vector per group."""
    sums = unit_sums(vectors, group)
    a = sums.select(F.col(group).alias("a"), F.col("n").alias("na"), F.col("unit_sum").alias("sa"))
    b = sums.select(F.col(group).alias("b"), F.col("n").alias("nb"), F.col("unit_sum").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select(
        *pairs.columns, (dot("sa", "sb") / (F.col("na") * F.col("nb"))).alias("linkage")
    )


def outlier_score(vectors: DataFrame, group: str, id_col: str) -> DataFrame:
    """Mean cosine of each vector to the other members of its group."""
    sums = unit_sums(vectors, group).filter("n > 1")
    own = unit("embedding")
    joined = lookup_join(vectors.select(id_col, group, own.alias("_u")), sums, group)
    score = (dot("_u", "unit_sum") - dot("_u", "_u")) / (F.col("n") - 1)
    return joined.select(id_col, group, score.alias("score"))


def central_articles(vectors: DataFrame, group: str, id_col: str, k: int = 3) -> DataFrame:
    """The ``k`` vectors of each group closest to its centroid."""
    scored = lookup_join(vectors.select(id_col, group, "embedding"), centroid(vectors, group), group).select(
        id_col, group, F.round(cosine("embedding", "centroid"), 6).alias("cosine")
    )
    return first_per_group(scored, [group], [F.col("cosine").desc(), F.col(id_col)], k)
