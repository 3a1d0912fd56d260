"""Ranking helpers that survive groups holding a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group with their ``rank``.

    Catalyst turns ``row_number() <= n`` into a group limit on both sides of the shuffle,
    so a hot group sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rank_in_group(
    df: DataFrame, group: list[str], coarse: list[Column], fine: list[Column], name: str = "rank"
) -> DataFrame:
    """``row_number`` per group, ordered by ``coarse`` then ``fine``, for groups of any size.

    ``coarse`` splits a group into ordered slots (a side, a day).  Slots are counted with
    map-side aggregation; a running sum over the small slot table gives every slot its
    offset, and rows are only numbered inside their slot.  No task sorts a whole group.
    """
    slots = [f"_slot{i}" for i in range(len(coarse))]
    keyed = df
    for slot, expression in zip(slots, coarse):
        keyed = keyed.withColumn(slot, expression)
    counts = keyed.groupBy(*group, *slots).agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*group).orderBy(*[F.col(s).asc_nulls_last() for s in slots])
    offsets = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        *[F.col(s).alias(f"_o{i}") for i, s in enumerate(slots)],
        (F.sum("_n").over(ordered) - F.col("_n")).alias("_offset"),
    )
    inside = Window.partitionBy(*group, *slots).orderBy(*fine)
    numbered = keyed.withColumn("_inside", F.row_number().over(inside))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    same += [F.col(s).eqNullSafe(F.col(f"_o{i}")) for i, s in enumerate(slots)]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra
    joined = numbered.join(offsets, condition, "inner")
    return joined.select(*df.columns, (F.col("_offset") + F.col("_inside")).cast("long").alias(name))
