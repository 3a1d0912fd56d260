"""Daily and weekly editions and who is due to receive them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import as_column, local_day, local_weekday, minus
from ..functions.text import snippet
from .blindspots import blindspots, blindspots_per_side
from .stories import top_by_importance

EDITION = ["story_id", "outlet_count", "article_count", "importance", "izq_pct", "centro_pct", "der_pct"]


def top_plural(coverage: DataFrame, since, min_outlets: int, n: int) -> DataFrame:
    active = coverage.filter((F.col("last_pub") >= since) & (F.col("outlet_count") >= min_outlets))
    return top_by_importance(active, n)


def daily_edition(coverage: DataFrame, since) -> DataFrame:
    """Top plural stories active since the last edition."""
    return top_plural(coverage, since, 2, V.TOP_DAILY).select(*EDITION)


def weekly_edition(coverage: DataFrame, as_of, window: str = "7 days") -> DataFrame:
    """Top stories of the week and the blindspots of each side, as one long table."""
    top = top_plural(coverage, minus(as_of, window), 3, V.TOP_WEEKLY)
    blind = blindspots(coverage, as_of, window=window)
    sides = blindspots_per_side(blind, top).withColumn(
        "section", F.concat(F.lit("sin_"), F.col("missing_side"))
    )
    return (
        top.withColumn("section", F.lit("top"))
        .select("section", *EDITION)
        .unionByName(sides.select("section", *EDITION))
    )


def edition_items(edition: DataFrame, stories: DataFrame, covers: DataFrame, base_url: str) -> DataFrame:
    """Edition rows with title, excerpt, link and cover image."""
    texts = stories.select("story_id", "titulo_canonico", "resumen_canonico")
    return (
        edition.join(texts, "story_id")
        .join(covers, "story_id", "left")
        .withColumn("resumen", F.when(F.col("resumen_canonico").isNotNull(), snippet("resumen_canonico")))
        .withColumn("link", F.concat(F.lit(base_url + "/historia/"), F.col("story_id").cast("string")))
        .drop("resumen_canonico")
    )


def digest_due(subscribers: DataFrame, as_of, force: bool = False) -> DataFrame:
    """Verified subscribers who should get their edition now (local civil days)."""
    verified = subscribers.filter("verified_at is not null")
    if force:
        return verified
    now = as_column(as_of)
    other_day = F.col("last_digest_sent_at").isNull() | (
        local_day("last_digest_sent_at") != local_day(now)
    )
    monday = local_weekday(now) == "Monday"
    return verified.filter(other_day & ((F.col("frequency") == "daily") | monday))
