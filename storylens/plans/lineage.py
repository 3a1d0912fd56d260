"""Cutting long lineages of iterative jobs in shared, fault-tolerant storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the folder the cluster names in ``spark.checkpoint.dir``.

    A local session may go without one (plain tests); on a cluster a temporary folder would be
    another disk on every machine, so there it is an error.
    """
    _named_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to that folder and read again, for frames that a loop makes from its own results.

    A checkpoint keeps Catalyst's size estimate of the plan it cuts.  Joins multiply estimates, so those of a loop
    grow into numbers of millions of digits in the driver; a stored frame has the size of its files.
    """
    spark = df.sparkSession
    path = f"{_named_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _named_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return (context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).rstrip("/")
