"""Writers for assigned articles and story aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet


def write_articles(articles: DataFrame, path: str, mode: str = "append", summary: str = "resumen", chars: int | None = None) -> None:
    """Articles partitioned by publication day; undated ones go to their own partition.

    Rows are spread by day and url, so a day with very many articles has many writers.
    With ``chars`` (the reference stores ``SNIPPET_STORE_CHARS``) a snippet of ``summary`` is written, else all of it.
    """
    if chars is not None:
        articles = articles.withColumn(summary, snippet(summary, chars))
    spread = F.pmod(F.xxhash64("url"), F.lit(16))
    (
        articles.withColumn("pub_date", F.to_date("fecha_pub"))
        .repartition("pub_date", spread)
        .write.mode(mode)
        .partitionBy("pub_date")
        .parquet(path)
    )


def write_stories(stories: DataFrame, path: str, mode: str = "overwrite") -> None:
    stories.write.mode(mode).parquet(path)
