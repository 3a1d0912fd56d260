"""Blindspots and the side brief."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import spectrum as S
from ..functions.dates import minus
from ..functions.text import brief_title, story_url
from ..plans.ranking import first_per_group
from .stories import top_by_importance


def blindspots(
    coverage: DataFrame, as_of, limit: int | None = None, window: str = "7 days"
) -> DataFrame:
    """Stories one side covers and the other barely does, the ``limit`` most important ones if given.

    ``coverage`` has one row per story.  Every story of the window is looked at; only then
    is the result cut.
    """
    recent = coverage.filter(
        (F.col("outlet_count") >= V.BLINDSPOT_MIN_OUTLETS) & (F.col("last_pub") >= minus(as_of, window))
    )
    missing = S.missing_side("izq_pct", "der_pct")
    found = (
        recent.withColumn("missing_side", missing)
        .filter("missing_side is not null")
        .withColumn("missing_pct", F.when(F.col("missing_side") == "izquierda", F.col("izq_pct")).otherwise(F.col("der_pct")))
    )
    return found if limit is None else top_by_importance(found, limit)


def blindspots_per_side(blind: DataFrame, top: DataFrame, k: int = V.BLINDSPOTS_PER_SIDE) -> DataFrame:
    """First ``k`` blindspots of each missing side that are not top stories."""
    rest = blind.join(top.select("story_id"), "story_id", "left_anti")
    return first_per_group(rest, ["missing_side"], [F.col("importance").desc(), F.col("story_id")], k)


def side_brief(coverage: DataFrame) -> DataFrame:
    """One story per side: the unused story with the highest share of that side.

    All stories are searched.  Two picks at most are taken before a side's turn, so its story is
    among the three best of that side: the picks are three rankings of nine rows at most,
    each putting stories that were picked before last.
    """
    plural = coverage.filter((F.col("outlet_count") >= 2) & F.col("izq_pct").isNotNull())
    picks = [("izquierda", "izq_pct"), ("centro", "centro_pct"), ("derecha", "der_pct")]
    best = [
        plural.orderBy(F.col(share).desc(), F.col("importance").desc(), "story_id").limit(len(picks))
        for _, share in picks
    ]
    rows = best[0].unionByName(best[1]).unionByName(best[2]).dropDuplicates(["story_id"]).withColumn("_used", F.lit(0))
    side = F.lit(None).cast("string")
    for order, (name, share) in enumerate(picks):
        rank = F.row_number().over(
            Window.orderBy("_used", F.col(share).desc(), F.col("importance").desc(), "story_id")
        )
        rows = rows.withColumn(f"_pick{order}", (rank == 1) & (F.col("_used") == 0))
        rows = rows.withColumn("_used", F.greatest("_used", F.col(f"_pick{order}").cast("int")))
        side = F.when(F.col(f"_pick{order}"), name).otherwise(side)
    share_pct = F.when(F.col("side") == "izquierda", F.col("izq_pct")).when(
        F.col("side") == "centro", F.col("centro_pct")
    ).otherwise(F.col("der_pct"))
    return (
        rows.withColumn("side", side)
        .filter("side is not null")
        .withColumn("dominant_pct", share_pct)
        .withColumn("badge", S.brief_badge("dominant_pct"))
        .drop("_used", "_pick0", "_pick1", "_pick2")
    )


def brief_caption(brief: DataFrame, titles: DataFrame, base_url: str, tail: str = "") -> DataFrame:
    """One text with a block per side, left to right (the brief has three rows at most)."""
    order = F.when(F.col("side") == "izquierda", 0).when(F.col("side") == "centro", 1).otherwise(2)
    block = F.concat_ws(
        "\n",
        F.concat("badge", F.lit(" · "), F.upper("side")),
        brief_title("titulo_canonico"),
        story_url(base_url, "story_id"),
    )
    blocks = F.array_sort(F.collect_list(F.struct(order.alias("at"), block.alias("block"))))
    return (
        brief.join(titles.select("story_id", "titulo_canonico"), "story_id")
        .agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n").alias("_blocks"))
        .select(F.concat_ws("\n", F.lit(V.BRIEF_INTRO), "_blocks", F.nullif(F.lit(tail), F.lit(""))).alias("caption"))
    )
