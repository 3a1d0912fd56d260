"""Editorial scale, factuality and coverage-share expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import _col


def lean_position(lean) -> Column:
    """0 (left) to 100 (right); the first matching rule wins, unknown labels are 50."""
    s = F.lower(F.trim(_col(lean)))
    return (
        F.when(s.contains("izquierda") & s.contains("radical"), 5)
        .when(s.contains("indep"), 22)
        .when(s.startswith("izquierda"), 18)
        .when(s.contains("centro-izq"), 35)
        .when(s.contains("centro-der"), 68)
        .when(s.contains("derecha") & s.contains("extrema"), 95)
        .when(s.contains("liberal") & s.contains("derecha"), 78)
        .when(s.contains("derecha"), 88)
        .when(s.contains("centro"), 52)
        .when(s.contains("izq"), 25)
        .otherwise(50)
    )


def side(lean) -> Column:
    """``left``, ``center`` or ``right``; null leans stay null."""
    position = lean_position(lean)
    return F.when(_col(lean).isNotNull(), F.when(position < V.LEFT_BELOW, "left")
                  .when(position > V.RIGHT_ABOVE, "right").otherwise("center"))


def is_center(lean) -> Column:
    return side(lean) == "center"


def factuality_rank(label) -> Column:
    key = F.lower(F.trim(_col(label)))
    ranks = F.lit(None).cast("double")
    for name, rank in V.FACTUALITY_RANKS.items():
        ranks = F.when(key == name, F.lit(rank)).otherwise(ranks)
    return F.coalesce(ranks, F.lit(V.FACTUALITY_RANKS["media"]))


def better_factuality(a, b) -> Column:
    return factuality_rank(a) > factuality_rank(b)


def largest_remainder(left, center, right) -> dict[str, Column]:
    """Whole percentages that sum to 100; spare points go to the largest fractions.

    At most two points are spare.  A side gets one when fewer than that many sides come
    before it; equal fractions go left, center, right.
    """
    counts = {"left": _col(left), "center": _col(center), "right": _col(right)}
    total = counts["left"] + counts["center"] + counts["right"]
    raw = {k: (c.cast("double") / total) * 100 for k, c in counts.items()}
    whole = {k: F.floor(r) for k, r in raw.items()}
    fraction = {k: raw[k] - whole[k] for k in raw}
    spare = F.lit(100) - whole["left"] - whole["center"] - whole["right"]

    def ahead(other: str, me: str, other_first_on_tie: bool) -> Column:
        f = fraction[other], fraction[me]
        return (f[0] >= f[1] if other_first_on_tie else f[0] > f[1]).cast("int")

    before = {
        "left": ahead("center", "left", False) + ahead("right", "left", False),
        "center": ahead("left", "center", True) + ahead("right", "center", False),
        "right": ahead("left", "right", True) + ahead("center", "right", True),
    }
    return {k: (whole[k] + (spare > before[k]).cast("int")).cast("int") for k in raw}


def stacked_segments(left_pct, center_pct, right_pct) -> Column:
    """Start and width of the three bar segments; a segment of 0 % is null."""
    l, c, r = _col(left_pct), _col(center_pct), _col(right_pct)

    def segment(start: Column, width: Column) -> Column:
        return F.when(width > 0, F.struct(start.alias("start"), width.alias("width")))

    return F.struct(
        segment(F.lit(0), l).alias("left"),
        segment(l, c).alias("center"),
        segment(l + c, r).alias("right"),
    )


def dominant_side(left_pct, center_pct, right_pct) -> Column:
    top = F.greatest(_col(left_pct), _col(center_pct), _col(right_pct))
    return (
        F.when(_col(left_pct) == top, "left").when(_col(right_pct) == top, "right").otherwise("center")
    )


def blindspot_claim(left_pct, center_pct, right_pct) -> Column:
    dominant = dominant_side(left_pct, center_pct, right_pct)
    return (
        F.when(dominant == "left", V.CLAIM_LEFT)
        .when(dominant == "right", V.CLAIM_RIGHT)
        .otherwise(V.CLAIM_CENTER)
    )


def missing_side(left_pct, right_pct) -> Column:
    """Side that barely covers a story the opposite side does cover, else null."""
    l, r = _col(left_pct), _col(right_pct)
    return F.when((l <= V.MISSING_MAX_PCT) & (r >= V.COVERING_MIN_PCT), "izquierda").when(
        (r <= V.MISSING_MAX_PCT) & (l >= V.COVERING_MIN_PCT), "derecha"
    )


def brief_badge(share_pct) -> Column:
    return F.when(_col(share_pct) >= V.BRIEF_DOMINANT_MIN, "ANGULO MUERTO").otherwise("SESGO")
