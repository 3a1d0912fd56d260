"""Ranks over whole tables: no task holds more than its share of the rows, whatever the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

_ROW = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row in its partition


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row (from 1) in ``order``, a list of sort columns.

    Rows are dealt by ranges of the whole ordering key, with boundaries that Spark takes from a sample, and sorted
    inside their partition.  The sizes of the partitions, one row each, give the offsets.  Rows that agree in every
    column of ``order`` share a partition: end it with something that tells them apart.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The partition and row of a row are read once, then kept.
    placed = cut(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_part")  # a row per partition of the job
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROW)) + 1
    return numbered.select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))
