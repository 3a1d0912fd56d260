"""Lookup joins whose strategy depends on a checked size of the small side."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
SALTS = 32


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (an upper bound for scans, filters, projections).

    Estimates of stacked joins multiply and can outgrow what Python parses as a number;
    such a plan counts as unbounded.
    """
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:
        return sys.maxsize


ROW_BYTES = 256


def lookup_join(
    fact: DataFrame, dim: DataFrame, key: str, how: str = "inner", rows: int | None = None
) -> DataFrame:
    """Join ``fact`` to a dimension with one row per ``key``.

    A dimension of a checked small size is broadcast.  A larger one is joined by shuffle;
    since a single key may hold a large part of the facts, that join is salted: each
    dimension row is repeated once per salt and facts of one key go to ``SALTS`` tasks.
    The hint keeps adaptive execution, which sees the size before the copies, from broadcasting it.
    ``rows`` is a counted bound of the dimension's rows, for narrow dimensions whose plan
    estimate says nothing (estimates multiply over the rounds of iterative jobs).
    """
    size = plan_bytes(dim) if rows is None else rows * ROW_BYTES
    if size <= BROADCAST_LIMIT_BYTES:
        return fact.join(F.broadcast(dim), key, how)
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted_fact = fact.withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), F.lit(SALTS)).cast("int"))
    return salted_fact.join(salted_dim.hint("merge"), [key, "_salt"], how).drop("_salt")


def hot_lookup(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join of ``fact`` to a side with one row per ``key`` that grows as the facts do.

    Facts of one key (or of none) go to ``SALTS`` tasks.  A row of ``dim`` is repeated only for the salts that its
    key has among the facts, so the copies are never more than the facts, and most keys have one.
    """
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), F.lit(SALTS)).cast("int"))
    copies = salted.select(key, "_salt").distinct().join(dim.hint("merge"), key)
    return salted.join(copies.hint("merge"), [key, "_salt"], "left").drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core.

    Meant for CPU-heavy row expressions on small files; a table with many splits, as any
    large one has, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
