"""Incremental ingestion with Structured Streaming.

Streams use the batch expressions unchanged.  Story state lives in tables, not in the
streaming state store, and every batch is written under its batch id, so a batch that is
replayed after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import fixed_values as V
from ..functions.relevance import is_low_value
from ..operators.clustering import assign_stories
from ..sources.feeds import first_seen


def stream_articles(spark: SparkSession, path: str, schema: StructType, format: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Landed items as a stream, cleaned and without low-value items."""
    items = (
        spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_batch).load(path)
    )
    return items.filter("url is not null and url <> '' and title is not null and title <> ''").filter(
        ~is_low_value("title", "summary")
    )


def stream_dedupe(items: DataFrame, arrival: Column, delay: str = "4 days") -> DataFrame:
    """First item per url within the watermark; undated items count as just arrived."""
    return (
        items.withColumn("fecha_pub", F.coalesce(F.col("fecha_pub").cast("timestamp"), arrival))
        .withWatermark("fecha_pub", delay)
        .dropDuplicatesWithinWatermark(["url"])
    )


def write_new_articles(items: DataFrame, path: str, checkpoint: str, known: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Append items whose url is not stored yet, one folder per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new = first_seen(batch, ["fecha_pub"])
        if known is not None:
            new = new.join(known().select("url"), "url", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        items.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_assign(
    articles: DataFrame,
    load_pool: Callable[[SparkSession, int], DataFrame | None],
    path: str,
    checkpoint: str,
    mode: str = "lexical",
) -> StreamingQuery:
    """Assign each batch to the open stories of the stored pool snapshot.

    ``load_pool(spark, batch_id)`` must return the snapshot written by earlier batches
    only, which makes a replay see what the first attempt saw.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        pool = load_pool(batch.sparkSession, batch_id)
        assigned = assign_stories(batch, pool, mode)
        assigned.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        articles.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def coverage_window(events: DataFrame, ts: str, keys: list[str], size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts per window and key: tumbling days, or sliding (48 hours by 1 hour).

    Works on batch and streaming frames; on a stream set the watermark first.
    """
    return events.groupBy(F.window(ts, size, slide).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def sliding_totals(events: DataFrame, ts: str, keys: list[str], values: dict[str, Column], hours: int = 48) -> DataFrame:
    """Sums of ``values`` (aggregates) for every window of ``hours`` that begins on an hour and holds a row; in batch.

    Rows are added up by hour first.  An hour enters the window that begins ``hours`` - 1 before it and leaves after
    its own: two changes a pane, whose running sum is the total of each window.  No row meets 48 windows.
    """
    names = [*values, "_panes"]
    panes = events.filter(F.col(ts).isNotNull()).groupBy(*keys, F.date_trunc("hour", ts).alias("_hour")).agg(
        *[value.alias(name) for name, value in values.items()], F.lit(1).cast("long").alias("_panes")
    )
    hour = F.expr("interval 1 hour")
    enters = F.struct((F.col("_hour") - F.expr(f"interval {hours - 1} hours")).alias("start"), F.lit(1).alias("sign"))
    leaves = F.struct((F.col("_hour") + hour).alias("start"), F.lit(-1).alias("sign"))
    changed = panes.withColumn("_change", F.explode(F.array(enters, leaves)))
    changes = changed.groupBy(*keys, F.col("_change.start").alias("start")).agg(
        *[F.sum(F.col(n) * F.col("_change.sign")).alias(n) for n in names]
    )
    order = Window.partitionBy(*keys).orderBy("start")
    running = changes.select(
        *keys, "start", F.lead("start").over(order).alias("_next"),
        *[F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names],
    )
    filled = running.filter("_panes > 0").withColumn("start", F.explode(F.sequence("start", F.col("_next") - hour, hour)))
    return filled.select("start", *keys, *values)


def with_watermark(items: DataFrame, ts: str = "fecha_pub", delay: str = "4 days") -> DataFrame:
    return items.withWatermark(ts, delay)


def observe_late(items: DataFrame, ts: str, as_of: Column, name: str = "ingest", delay: str = "4 days") -> DataFrame:
    """Count seen and late rows with ``observe``; the rows pass unchanged."""
    late = F.col(ts) < as_of - F.expr(f"interval {delay}")
    return items.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if(late).alias("late"))


def stream_sessions(articles: DataFrame, key: str = "story_id", ts: str = "fecha_pub", gap_hours: int = V.CLUSTER_WINDOW_HOURS) -> DataFrame:
    """Bursts of activity per key on a stream with a watermark."""
    return articles.groupBy(key, F.session_window(ts, f"{gap_hours} hours").alias("session")).agg(
        F.count(F.lit(1)).alias("n")
    )


def story_sessions(articles: DataFrame, key: str = "story_id", ts: str = "fecha_pub", gap_hours: int = V.CLUSTER_WINDOW_HOURS) -> DataFrame:
    """Bursts of activity per key in batch: rows less than the gap apart.

    Rows of one hour always belong together, so they are aggregated first; the ordered
    window only sees one row per key and active hour, however many articles a key has.
    """
    hours = articles.groupBy(key, F.date_trunc("hour", ts).alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at")
    )
    w = Window.partitionBy(key).orderBy("hour")
    gap = F.unix_micros(F.col("first_at").cast("timestamp")) - F.unix_micros(
        F.lag("last_at").over(w).cast("timestamp")
    )
    starts = F.coalesce((gap >= gap_hours * 3_600_000_000).cast("int"), F.lit(1))
    numbered = hours.withColumn("_start", starts).withColumn("session", F.sum("_start").over(w))
    return numbered.groupBy(key, "session").agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
