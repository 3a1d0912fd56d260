"""Per-story choices: images, article order, dates, and small catalogue statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import spectrum as S
from ..functions.dates import as_column, epoch_micros, minus
from ..plans.joins import lookup_join
from ..plans.ranking import first_per_group, rank_in_group


def cover_image(articles: DataFrame, stories: DataFrame) -> DataFrame:
    """One image per story.

    Images of articles titled like the story come first, the oldest of them wins; other
    images follow, newest first.  A missing date counts as the oldest.  ``min`` of a struct
    combines on the map side, whatever the size of a story.
    """
    titles = stories.select("story_id", "titulo_canonico")
    dated = F.coalesce(epoch_micros("fecha_pub"), F.lit(0))
    canonical = F.coalesce(F.col("titulo") == F.col("titulo_canonico"), F.lit(False))
    pictured = articles.filter("imagen_url is not null and imagen_url <> '' and story_id is not null")
    return (
        lookup_join(pictured, titles, "story_id")
        .select(
            "story_id",
            F.struct(
                (~canonical).cast("int").alias("other"),
                F.when(canonical, dated).otherwise(-dated).alias("at"),
                F.col("url"),
                F.col("imagen_url"),
            ).alias("choice"),
        )
        .groupBy("story_id")
        .agg(F.min("choice").alias("choice"))
        .select("story_id", F.col("choice.imagen_url").alias("cover_url"))
    )


def latest_image(articles: DataFrame) -> DataFrame:
    """Image of the newest article that has one, per story."""
    newest = F.struct(
        (-F.coalesce(epoch_micros("fecha_pub"), F.lit(0))).alias("at"), "url", "imagen_url"
    )
    return (
        articles.filter("imagen_url is not null and imagen_url <> '' and story_id is not null")
        .groupBy("story_id")
        .agg(F.min(newest).alias("choice"))
        .select("story_id", F.col("choice.imagen_url").alias("image_url"))
    )


def cover_join(articles: DataFrame, stories: DataFrame) -> DataFrame:
    """Articles with an image whose title is their story's canonical title."""
    titles = stories.select("story_id", F.col("titulo_canonico").alias("titulo"))
    return (
        articles.filter("imagen_url is not null")
        .join(titles, ["story_id", "titulo"])
        .select("story_id", "url", "imagen_url", "fecha_pub")
    )


def spectrum_order(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Articles of each story from left to right, oldest first, undated last."""
    positions = outlets.select("outlet_id", S.lean_position("sesgo").alias("position"))
    placed = (
        lookup_join(
            articles.filter("story_id is not null").select("story_id", "url", "outlet_id", "fecha_pub"),
            positions,
            "outlet_id",
            "left",
        )
        .withColumn("position", F.coalesce("position", S.lean_position(F.lit(""))))
    )
    return rank_in_group(
        placed,
        ["story_id"],
        [F.col("position"), F.date_trunc("hour", "fecha_pub")],
        [F.col("fecha_pub").asc_nulls_last(), F.col("url")],
    )


def outlet_recent(articles: DataFrame, n: int = 12) -> DataFrame:
    """Newest ``n`` articles per outlet, undated last."""
    return first_per_group(
        articles.select("outlet_id", "url", "titulo", "story_id", "fecha_pub"),
        ["outlet_id"],
        [F.col("fecha_pub").desc_nulls_last(), F.col("url")],
        n,
    )


def top_by_importance(stories: DataFrame, n: int) -> DataFrame:
    return stories.orderBy(F.col("importance").desc(), "story_id").limit(n)


def newest_first(stories: DataFrame) -> DataFrame:
    return stories.orderBy(F.col("last_pub").desc_nulls_last(), "story_id")


def backfill_dates(stories: DataFrame, articles: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Fill missing dates of stories that have articles.

    Dates come from the articles, else from ``updated_at`` / ``created_at``; with
    ``fallback`` given, from that timestamp instead.
    """
    spans = articles.groupBy("story_id").agg(
        F.min("fecha_pub").alias("_first"), F.max("fecha_pub").alias("_last")
    )
    first_default = F.col("created_at") if fallback is None else as_column(fallback)
    last_default = F.coalesce("updated_at", "created_at") if fallback is None else as_column(fallback)
    fill = F.col("last_pub").isNull() & F.col("_has")
    return (
        stories.join(spans.withColumn("_has", F.lit(True)), "story_id", "left")
        .withColumn("_has", F.coalesce("_has", F.lit(False)))
        .withColumn("first_pub", F.when(fill, F.coalesce("_first", first_default)).otherwise(F.col("first_pub")))
        .withColumn("last_pub", F.when(fill, F.coalesce("_last", last_default)).otherwise(F.col("last_pub")))
        .drop("_first", "_last", "_has")
    )


def missing_dates(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Stories without a last date that do have articles."""
    return stories.filter("last_pub is null").join(articles.select("story_id"), "story_id", "left_semi")


def open_pool(stories: DataFrame, as_of, days: int = V.LOOKBACK_DAYS, n: int | None = None) -> DataFrame:
    """Stories still open for new articles: active in the last days; the newest ``n`` if given."""
    active = stories.filter(F.col("last_pub") >= minus(as_of, f"{days} days"))
    return active if n is None else newest_first(active).limit(n)


def indexable(stories: DataFrame, outlets: DataFrame, as_of, n: int | None = None) -> DataFrame:
    """Pages worth indexing: active outlets, and recent stories of two outlets or more (the newest ``n`` if given)."""
    recent = stories.filter((F.col("outlet_count") >= 2) & (F.col("last_pub") >= minus(as_of, "30 days")))
    story_pages = (recent if n is None else newest_first(recent).limit(n)).select(
        F.concat(F.lit("/historia/"), F.col("story_id").cast("string")).alias("path"),
        F.col("last_pub").alias("modified"),
    )
    outlet_pages = outlets.filter("active").select(
        F.concat(F.lit("/medios/"), "slug").alias("path"),
        F.lit(None).cast(dict(stories.dtypes)["last_pub"]).alias("modified"),
    )
    return outlet_pages.unionByName(story_pages)


def catalog_stats(
    stories: DataFrame, articles: DataFrame, outlets: DataFrame, as_of, approximate: bool = False,
    active: DataFrame | None = None,
) -> DataFrame:
    """Active outlets, plural stories and articles of the last day, and all stories.

    ``active`` may name the stories of the last day where they are cheaper to come by than in
    ``stories``.  Each number is one global aggregate; the four one-row results are scalar subqueries.
    """
    since = minus(as_of, "24 hours")
    total = F.approx_count_distinct("story_id") if approximate else F.count(F.lit(1))
    plural_today = (stories if active is None else active).filter((F.col("last_pub") >= since) & (F.col("outlet_count") >= 2))
    articles_today = articles.filter(F.col("fecha_pub") >= since)
    return outlets.filter("active").agg(F.count(F.lit(1)).alias("outlets")).select(
        "outlets",
        plural_today.agg(F.count(F.lit(1))).scalar().alias("stories_today"),
        articles_today.agg(F.count(F.lit(1))).scalar().alias("articles_today"),
        stories.agg(total).scalar().alias("stories_total"),
    )


def row_counts(stories: DataFrame, articles: DataFrame) -> DataFrame:
    return stories.agg(F.count(F.lit(1)).alias("stories")).select(
        "stories", articles.agg(F.count(F.lit(1))).scalar().alias("articles")
    )
