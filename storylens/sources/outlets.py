"""Outlet catalogue, follows, validation and upserts.

Upserts return a new snapshot: no table format with MERGE is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import _col, js_trim
from ..plans.joins import lookup_join

OUTLETS = T.StructType(
    [
        T.StructField("outlet_id", T.StringType()),
        T.StructField("nombre", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField("rss_urls", T.ArrayType(T.StringType())),
        T.StructField("sesgo", T.StringType()),
        T.StructField("factualidad", T.StringType()),
        T.StructField("ownership", T.StringType()),
        T.StructField("prioridad", T.IntegerType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
OUTLET_DEFAULTS = {"sesgo": "desconocido", "factualidad": "media", "prioridad": 3, "active": True}


def read_outlets(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Outlet catalogue with declared types and the catalogue's defaults."""
    rows = spark.read.schema(OUTLETS).format(format).load(path)
    for name, value in OUTLET_DEFAULTS.items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)))
    return rows.withColumn("slug", F.lower("slug"))


def expand_feeds(outlets: DataFrame) -> DataFrame:
    """One row per feed URL of active outlets, highest priority first."""
    return (
        outlets.filter("active")
        .select("outlet_id", "slug", "prioridad", F.posexplode("rss_urls").alias("feed_index", "feed_url"))
        .orderBy(F.col("prioridad").desc(), "slug", "feed_index")
    )


def outlet_list(outlets: DataFrame) -> DataFrame:
    return (
        outlets.filter("active")
        .select("outlet_id", "nombre", "slug", "sesgo", "prioridad")
        .orderBy(F.col("prioridad").desc(), "nombre", "outlet_id")
    )


def upsert_outlets(current: DataFrame, incoming: DataFrame, update_cols: list[str] | None = None) -> DataFrame:
    """Insert or update by slug; ``update_cols`` limits what an update may overwrite."""
    values = [c for c in current.columns if c not in ("slug", "outlet_id")]
    update = values if update_cols is None else update_cols
    old = current.withColumn("_old", F.lit(True)).alias("o")
    new = incoming.withColumn("_new", F.lit(True)).alias("n")

    def pick(name: str) -> Column:
        if name in update:
            replaced = F.when(F.col("n._new"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        else:
            replaced = F.when(F.col("o._old"), F.col(f"o.{name}")).otherwise(F.col(f"n.{name}"))
        return replaced.alias(name)

    joined = old.join(new, F.col("o.slug") == F.col("n.slug"), "full_outer")
    return joined.select(
        F.coalesce("o.outlet_id", "n.outlet_id").alias("outlet_id"),
        F.coalesce("o.slug", "n.slug").alias("slug"),
        *[pick(c) for c in values],
    ).select(*current.columns)


def feed_outlet_patch(outlets: DataFrame, patches: DataFrame) -> DataFrame:
    """Bulk corrections keyed by slug; null patch values leave the row's value."""
    changed = [c for c in patches.columns if c != "slug"]
    renamed = patches.select("slug", *[F.col(c).alias(f"_p_{c}") for c in changed])
    return lookup_join(outlets, renamed, "slug", "left").select(
        *[
            F.coalesce(f"_p_{c}", c).alias(c) if c in changed else F.col(c)
            for c in outlets.columns
        ]
    )


def upsert_follows(follows: DataFrame, incoming: DataFrame, outlets: DataFrame) -> DataFrame:
    """Add (user, outlet) pairs of active outlets that are not there yet."""
    active = outlets.filter("active").select("outlet_id")
    new = incoming.select("user_id", "outlet_id").join(active, "outlet_id", "left_semi")
    return follows.select("user_id", "outlet_id").union(new.select("user_id", "outlet_id")).distinct()


def remove_follows(follows: DataFrame, removed: DataFrame) -> DataFrame:
    return follows.join(removed.select("user_id", "outlet_id"), ["user_id", "outlet_id"], "left_anti")


def outlet_violations(has_urls: bool = True) -> Column:
    """Names of the constraints a row breaks, as an array."""

    def length_outside(name: str, low: int, high: int) -> Column:
        size = F.length(F.coalesce(_col(name), F.lit("")))
        return (size < low) | (size > high)

    checks = {
        "nombre": length_outside("nombre", 1, 200),
        "slug": length_outside("slug", 1, 120)
        | ~F.coalesce(_col("slug"), F.lit("")).rlike(V.SLUG_PATTERN),
        "sesgo": length_outside("sesgo", 1, 120),
        "factualidad": length_outside("factualidad", 1, 120),
        "ownership": F.length(F.coalesce(_col("ownership"), F.lit(""))) > 300,
        "prioridad": ~F.coalesce(F.col("prioridad").between(1, 5), F.lit(False)),
    }
    if has_urls:
        valid = F.filter("rss_urls", lambda u: u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:\S+$"))
        urls = F.coalesce(F.size("rss_urls"), F.lit(0))
        checks["rss_urls"] = (urls < 1) | (F.coalesce(F.size(valid), F.lit(0)) != urls)
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def validate_outlets(outlets: DataFrame) -> DataFrame:
    """Each outlet with its violations, including names and slugs that are not unique.

    Repeats are found by two aggregates joined back, not by a window over the name.
    """
    name_key = F.lower("nombre")
    names = outlets.groupBy(name_key.alias("_name")).agg(F.count(F.lit(1)).alias("_names"))
    slugs = outlets.groupBy(F.col("slug").alias("_slug")).agg(F.count(F.lit(1)).alias("_slugs"))
    rows = (
        outlets.withColumn("_name", name_key)
        .withColumn("_slug", F.col("slug"))
        .join(names, "_name", "left")
        .join(slugs, "_slug", "left")
    )
    repeats = F.array_compact(
        F.array(
            F.when(F.col("_names") > 1, F.lit("nombre_repetido")),
            F.when(F.col("_slugs") > 1, F.lit("slug_repetido")),
        )
    )
    violations = F.concat(outlet_violations("rss_urls" in outlets.columns), repeats)
    return rows.withColumn("violations", violations).drop("_name", "_slug", "_names", "_slugs")


def clean_slug(c) -> Column:
    return F.lower(js_trim(c))


__all__ = [
    "OUTLETS", "read_outlets", "expand_feeds", "outlet_list", "upsert_outlets",
    "feed_outlet_patch", "upsert_follows", "remove_follows", "validate_outlets", "clean_slug",
]
