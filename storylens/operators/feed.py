"""Reader feeds, story and outlet pages, share fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectrum as S
from ..functions.text import outlet_initials, page_title, share_description
from ..plans.joins import lookup_join
from .coverage import average_position
from .search import list_stories, stories_of_side, story_window, search_contains, page
from .stories import latest_image, outlet_recent, spectrum_order


def followed_outlets(follows: DataFrame, outlets: DataFrame, user_id) -> DataFrame:
    """Distinct slugs a user follows."""
    mine = follows.filter(F.col("user_id") == user_id).select("outlet_id").distinct()
    return outlets.join(mine, "outlet_id", "left_semi").select("slug").distinct()


def is_following(follows: DataFrame, outlets: DataFrame, user_id) -> DataFrame:
    """Every outlet with a flag telling whether the user follows it."""
    mine = follows.filter(F.col("user_id") == user_id).select("outlet_id").distinct()
    return outlets.select("outlet_id", "slug").join(
        mine.withColumn("following", F.lit(True)), "outlet_id", "left"
    ).withColumn("following", F.coalesce("following", F.lit(False)))


def user_feed(
    stories: DataFrame,
    articles: DataFrame,
    outlets: DataFrame,
    follows: DataFrame,
    user_id,
    as_of,
    side: str = "",
    window: str = "all",
    term: str = "",
    number: int = 1,
) -> DataFrame:
    """Page of stories from the active outlets a user follows, by importance."""
    followed = outlets.filter("active").join(
        followed_outlets(follows, outlets, user_id), "slug", "left_semi"
    )
    mine = (
        articles.filter("story_id is not null")
        .join(followed.select("outlet_id"), "outlet_id", "left_semi")
        .select("story_id")
        .distinct()
    )
    rows = story_window(stories, window, as_of).join(mine, "story_id", "left_semi")
    if side:
        rows = rows.join(stories_of_side(articles, outlets, side), "story_id", "left_semi")
    rows = search_contains(rows, term)
    return page(rows.orderBy(F.col("importance").desc(), "story_id"), number)


def story_detail(coverage: DataFrame, articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Coverage, mean position and hero image of stories, one row each."""
    return (
        coverage.join(average_position(articles, outlets), "story_id", "left")
        .join(latest_image(articles), "story_id", "left")
        .withColumn("average_position", F.coalesce("average_position", F.lit(50.0)))
    )


def story_articles(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Articles of stories in spectrum order, with outlet names."""
    names = outlets.select("outlet_id", "nombre", "sesgo", "factualidad")
    return lookup_join(spectrum_order(articles, outlets), names, "outlet_id", "left")


def share_fields(stories: DataFrame, coverage: DataFrame, articles: DataFrame) -> DataFrame:
    """Texts, counts, shares and image shown when a story is shared."""
    mix = coverage.select(
        "story_id", "outlet_count", "article_count", "izq_pct", "centro_pct", "der_pct", "last_pub"
    )
    return (
        stories.select("story_id", "titulo_canonico", "resumen_canonico")
        .join(mix, "story_id")
        .join(latest_image(articles), "story_id", "left")
        .withColumn("page_title", page_title("titulo_canonico"))
        .withColumn("description", share_description("resumen_canonico", "outlet_count", "article_count"))
    )


def outlet_page(outlets: DataFrame, articles: DataFrame, n: int = 12) -> DataFrame:
    """Outlets with position, side, initials and their newest articles."""
    card = outlets.select(
        "outlet_id",
        "slug",
        S.lean_position("sesgo").alias("position"),
        S.is_center("sesgo").alias("is_center"),
        outlet_initials("nombre").alias("initials"),
    )
    return lookup_join(outlet_recent(articles, n), card, "outlet_id")


__all__ = [
    "followed_outlets", "is_following", "user_feed", "story_detail", "story_articles",
    "share_fields", "outlet_page", "list_stories",
]
