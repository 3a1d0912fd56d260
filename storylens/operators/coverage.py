"""How a story is covered: outlets, sides, shares and importance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectrum as S
from ..plans.joins import lookup_join


def outlet_counts(articles: DataFrame, extra: dict[str, tuple] = {}) -> DataFrame:
    """Articles per (story, outlet) with first and last date.

    This is the only pass over the articles in the coverage operators.  It combines on the
    map side, so a story or outlet with very many articles shrinks before the shuffle.
    """
    return (
        articles.filter(F.col("story_id").isNotNull())
        .groupBy("story_id", "outlet_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("fecha_pub").alias("first_pub"),
            F.max("fecha_pub").alias("last_pub"),
            *[combine(column).alias(name) for name, (combine, column) in extra.items()],
        )
    )


def articles_of_active(articles: DataFrame, since) -> DataFrame:
    """All articles of the stories that have one dated ``since`` or later.

    ``last_pub >= since`` holds for exactly these stories, so a question about a window counts
    their articles only: the date reaches the scan that finds them, and the rest of the history
    is dropped before it is aggregated.  The active stories grow with the table, so they are joined
    by shuffle whatever their estimate: the hint keeps adaptive execution from sending them to the driver.
    """
    recent = articles.filter(F.col("fecha_pub") >= since).filter("story_id is not null").select("story_id").distinct()
    return articles.join(recent.hint("merge"), "story_id", "left_semi")


def story_coverage(articles: DataFrame, outlets: DataFrame, extra: dict[str, tuple] = {}) -> DataFrame:
    """One row per story: counts, dates, sides, importance and coverage shares.

    An outlet counts once per story.  Outlets without a lean take part in the outlet count
    but not in the shares.  No distinct aggregate is needed: outlets are already unique.
    ``extra`` adds aggregates that combine with themselves (``{"name": (F.min, "column")}``)
    to the same pass.
    """
    leans = outlets.select("outlet_id", S.side("sesgo").alias("side"), (F.col("sesgo") != "").alias("has_lean"))
    per_outlet = lookup_join(outlet_counts(articles, extra), leans, "outlet_id", "left")
    in_mix = F.col("outlet_id").isNotNull() & F.col("has_lean")

    def outlets_on(name: str):
        return F.count_if((F.col("side") == name) & in_mix).cast("int")

    def has(name: str):
        return F.max(F.coalesce((F.col("side") == name).cast("int"), F.lit(0)))

    rolled = per_outlet.groupBy("story_id").agg(
        F.sum("n").alias("article_count"),
        F.count("outlet_id").alias("outlet_count"),
        (has("left") + has("center") + has("right")).alias("sides"),
        F.min("first_pub").alias("first_pub"),
        F.max("last_pub").alias("last_pub"),
        outlets_on("left").alias("izq"),
        outlets_on("center").alias("centro"),
        outlets_on("right").alias("der"),
        *[combine(name).alias(name) for name, (combine, _) in extra.items()],
    )
    covered = F.col("izq") + F.col("centro") + F.col("der") > 0
    shares = S.largest_remainder(F.col("izq"), F.col("centro"), F.col("der"))
    return rolled.select(
        "*",
        importance(F.col("outlet_count"), F.col("sides")).alias("importance"),
        F.when(covered, shares["left"]).alias("izq_pct"),
        F.when(covered, shares["center"]).alias("centro_pct"),
        F.when(covered, shares["right"]).alias("der_pct"),
    )


def importance(outlet_count, sides):
    """Ten per outlet, plus eight per side once there are two outlets."""
    bonus = F.when(outlet_count >= 2, sides * 8).otherwise(0)
    return (outlet_count * 10 + bonus).cast("int")


def story_rollup(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    return story_coverage(articles, outlets).select(
        "story_id", "article_count", "outlet_count", "sides", "first_pub", "last_pub", "importance"
    )


def coverage_mix(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Distinct outlets per side and their shares; stories without any are absent."""
    return (
        story_coverage(articles, outlets)
        .filter("izq_pct is not null")
        .select("story_id", "izq", "centro", "der", "izq_pct", "centro_pct", "der_pct")
    )


def average_position(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Mean lean position of a story's outlets; 50 when none is known."""
    positions = outlets.select("outlet_id", S.lean_position("sesgo").alias("position"))
    pairs = articles.filter("story_id is not null").select("story_id", "outlet_id").distinct()
    return (
        lookup_join(pairs, positions, "outlet_id", "left")
        .groupBy("story_id")
        .agg(F.coalesce(F.avg("position"), F.lit(50.0)).alias("average_position"))
    )


def per_outlet_counts(articles: DataFrame) -> DataFrame:
    """Articles per story and outlet: the state behind the per-outlet cap."""
    return (
        articles.filter("story_id is not null and outlet_id is not null")
        .groupBy("story_id", "outlet_id")
        .agg(F.count(F.lit(1)).alias("articles"))
    )


def outlets_by_side(outlets: DataFrame) -> DataFrame:
    return (
        outlets.filter("active")
        .groupBy(S.side("sesgo").alias("side"))
        .agg(F.count(F.lit(1)).alias("outlets"))
    )


def side_imbalance(outlets: DataFrame) -> DataFrame:
    """Which side has more active outlets; no row when left and right are equal."""
    counts = outlets.filter("active").agg(
        F.count_if(S.side("sesgo") == "left").alias("left"),
        F.count_if(S.side("sesgo") == "right").alias("right"),
    )
    more_left = F.col("left") > F.col("right")
    return counts.filter(F.col("left") != F.col("right")).select(
        F.when(more_left, "left").otherwise("right").alias("more"),
        F.when(more_left, "right").otherwise("left").alias("fewer"),
        F.greatest("left", "right").alias("more_outlets"),
        F.least("left", "right").alias("fewer_outlets"),
    )


def methodology_table(outlets: DataFrame) -> DataFrame:
    """Active outlets with their side and owner, in side and name order."""
    order = F.when(F.col("side") == "left", 0).when(F.col("side") == "center", 1).otherwise(2)
    return (
        outlets.filter("active")
        .select(S.side("sesgo").alias("side"), "nombre", "slug", "ownership")
        .orderBy(order, "nombre", "slug")
    )


def absent_outlets(articles: DataFrame, outlets: DataFrame, story_id) -> DataFrame:
    """Active outlets that do not cover a story (an id or a scalar subquery), by name."""
    covering = articles.filter(F.col("story_id") == story_id).select("outlet_id").distinct()
    return (
        outlets.filter("active")
        .join(covering, "outlet_id", "left_anti")
        .select("outlet_id", "nombre", "slug", "sesgo")
        .orderBy("nombre", "outlet_id")
    )
