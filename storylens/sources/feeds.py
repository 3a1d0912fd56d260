"""Landed feed payloads (XML and JSON) and the rules that turn items into articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import parse_pub_date
from ..functions.relevance import is_low_value
from ..functions.text import decode_entities, item_image, item_summary, js_trim, strip_html
from ..plans.ranking import first_per_group

ITEM_TYPE = (
    "array<struct<title:string,link:array<struct<_href:string,_rel:string,_VALUE:string>>,"
    "description:string,summary:string,content:string,"
    "isoDate:string,`dc:date`:string,pubDate:string,published:string,updated:string,"
    "enclosure:struct<_url:string>,`media:content`:struct<_url:string>>>"
)
#: RSS holds items in its channel, RSS 1.0 beside it, Atom has entries.
FEED_SCHEMA = f"channel struct<item:{ITEM_TYPE}>, item {ITEM_TYPE}, entry {ITEM_TYPE}"
POST_SCHEMA = (
    "array<struct<link:string,date:string,title:struct<rendered:string>,"
    "excerpt:struct<rendered:string>>>"
)
ITEM_COLUMNS = ["feed", "position", "url", "title", "summary", "fecha_pub", "imagen_url"]


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS and Atom files; ``feed`` is the file."""
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("feed"), F.col("value").alias("payload")
    )
    return parse_feed_xml(files)


def parse_feed_xml(payloads: DataFrame, feed: str = "feed", payload: str = "payload") -> DataFrame:
    """Items of RSS and Atom payloads held in a column, one row per item.

    ``position`` keeps the order of items.  A payload that is not well-formed has no items.
    """
    parsed = payloads.select(
        F.col(feed).alias("feed"), F.from_xml(F.col(payload), FEED_SCHEMA).alias("_feed")
    )
    lists = [F.coalesce(F.col(c), F.array()) for c in ("_feed.channel.item", "_feed.item", "_feed.entry")]
    rows = parsed.select("feed", F.posexplode(F.concat(*lists)).alias("position", "_item"))
    return _items(rows.select("feed", F.col("position").cast("long"), "_item.*"))


def _link(links: str) -> Column:
    """Text of the link (RSS), else the address of the alternate one, else the first address (Atom)."""
    text = F.filter(links, lambda x: x["_VALUE"].isNotNull())
    page = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(text, 0)["_VALUE"], F.get(page, 0)["_href"], F.get(links, 0)["_href"])


def _items(rows: DataFrame) -> DataFrame:
    return rows.select(
        "feed",
        "position",
        js_trim(_link("link")).alias("url"),
        js_trim(decode_entities(F.col("title"))).alias("title"),
        item_summary("description", "summary", "content").alias("summary"),
        parse_pub_date(
            F.coalesce("isoDate", "`dc:date`"), F.coalesce("pubDate", "published", "updated")
        ).alias("fecha_pub"),
        item_image(F.col("enclosure._url"), F.col("`media:content`._url")).alias("imagen_url"),
    )


def parse_feed_json(payloads: DataFrame, feed: str = "feed", payload: str = "payload") -> DataFrame:
    """Items of JSON post arrays; rows without link or title are skipped."""
    posts = F.from_json(F.col(payload), POST_SCHEMA)
    rows = payloads.select(
        F.col(feed).alias("feed"), F.posexplode(posts).alias("position", "_post")
    )
    empty = F.lit(None).cast("string")
    # The plain-text title drives the skip rule; entities are decoded as for XML items.
    plain_title = strip_html(F.col("_post.title.rendered"))
    return rows.filter(
        (js_trim(F.coalesce("_post.link", F.lit(""))) != "") & (F.coalesce(plain_title, F.lit("")) != "")
    ).select(
        "feed",
        F.col("position").cast("long"),
        js_trim("_post.link").alias("url"),
        js_trim(decode_entities(plain_title)).alias("title"),
        item_summary(strip_html(F.col("_post.excerpt.rendered")), empty, empty).alias("summary"),
        F.try_to_timestamp("_post.date").alias("fecha_pub"),
        empty.alias("imagen_url"),
    )


def read_feed_json(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed JSON post files (one array per file)."""
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("feed"), F.col("value").alias("payload")
    )
    return parse_feed_json(files)


def cap_items_per_feed(items: DataFrame, n: int) -> DataFrame:
    """First ``n`` items of each feed in feed order."""
    return first_per_group(items, ["feed"], [F.col("position")], n)


def first_seen(items: DataFrame, order: list[str]) -> DataFrame:
    """First row per url.  ``min`` of a struct combines map-side, so copies never pile up."""
    rest = [c for c in items.columns if c != "url" and c not in order]
    picked = items.groupBy("url").agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return picked.select(
        *[F.col("url") if c == "url" else F.col(f"_first.{c}").alias(c) for c in items.columns]
    )


def drop_known(items: DataFrame, articles: DataFrame, order: list[str]) -> DataFrame:
    """New items only: with link and title, first of their url, url not stored yet."""
    usable = items.filter("url is not null and url <> '' and title is not null and title <> ''")
    return first_seen(usable, order).join(articles.select("url"), "url", "left_anti")


def filter_relevant(items: DataFrame, title: str = "title", summary: str = "summary") -> DataFrame:
    return items.filter(~is_low_value(title, summary))


def ingest_metrics(items: DataFrame, articles: DataFrame, order: list[str]) -> DataFrame:
    """Items seen, known, low-value and inserted, as one aggregate over one pass."""
    known = articles.select("url").distinct().withColumn("_known", F.lit(True))
    usable = items.filter("url is not null and url <> '' and title is not null and title <> ''")
    copies = usable.groupBy("url").agg(
        F.count(F.lit(1)).alias("_copies"), F.min(F.struct(*order, "title", "summary")).alias("_first")
    )
    judged = copies.join(known, "url", "left").select(
        "_copies",
        F.coalesce("_known", F.lit(False)).alias("known"),
        is_low_value(F.col("_first.title"), F.col("_first.summary")).alias("low"),
    )
    new = ~F.col("known")
    return judged.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("items_usable"),
        F.coalesce(F.sum(F.when(new, F.col("_copies") - 1).otherwise(F.col("_copies"))), F.lit(0)).alias("duplicates"),
        F.count_if(new & F.col("low")).alias("excluded_low_value"),
        F.count_if(new & ~F.col("low")).alias("inserted"),
    )


def ordering_time(fecha_pub: str, as_of) -> Column:
    """Publication time used for ordering; undated items count as published now."""
    return F.coalesce(F.col(fecha_pub), as_of)
