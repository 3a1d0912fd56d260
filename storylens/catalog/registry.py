"""Registered queries and, where SQL can say the same, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.session import TASK_BYTES, ship_package
from .tables import News

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(build: Callable[[News], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Civil days are derived from UTC timestamps.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            for key, value in TASK_BYTES.items():
                spark.conf.set(key, value)
            ship_package(spark)
            return build(News(spark, str(folder).rstrip("/")))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap
