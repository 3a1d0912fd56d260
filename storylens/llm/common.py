"""Small shared pieces: whole-table reads, stored intermediate tables, batch sizes, bounded label samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import spread  # noqa: F401  (used by the operators)
from ..plans.session import ship_package

#: Rows of one Arrow batch: keeps a Python worker's memory small even where texts are long.
BATCH_ROWS = 512
#: Bytes of one Arrow batch.
BATCH_BYTES = 8 << 20
#: Keys that hold more than one row in so many are hot: there are fewer of them than this.
HOT_KEYS = 4096
#: Python code of a task works on at most this many characters of short texts at once.
PIECE_CHARS = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Settings of a session that runs these operators; executors get the package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="storylens-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(facts: DataFrame, dim: DataFrame, *keys: str) -> DataFrame:
    """Inner join of ``facts`` to a side with one row per key, none of which is null.

    Keys with more than one in ``HOT_KEYS`` of the facts are fewer than ``HOT_KEYS``, so their rows of ``dim`` are
    broadcast and their facts stay where they are; the facts of all other keys are shuffled.  Both sides are read
    more than once: they should be stored tables, or cheap to derive from one.
    """
    names = list(keys)
    held = facts.groupBy(*names).agg(F.count(F.lit(1)).alias("_held"))
    hot = store(held.filter(F.col("_held") * HOT_KEYS > facts.count()).select(*names), "hot-keys")
    few = F.broadcast(dim.join(F.broadcast(hot), names, "left_semi"))
    return facts.join(few, names).unionByName(facts.join(F.broadcast(hot), names, "left_anti").join(dim, names))


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, n_rows: int, *key: str) -> DataFrame:
    """About ``n_rows`` rows, the same ones on every run: those with a small hash of ``key``."""
    total = rows.count()
    if total <= n_rows:
        return rows
    width = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(*key), F.lit(width)) < int(width * n_rows / total)).limit(2 * n_rows)


def slices(lengths, most: int = PIECE_CHARS):
    """Ranges (lo, hi) of consecutive texts of at most ``most`` characters together, one text at least."""
    lo, size = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if len(lengths) > lo:
        yield lo, len(lengths)


def map_texts(df: DataFrame, work: Callable[[list[str]], dict[str, object]], added: str) -> DataFrame:
    """Replace the column ``text`` by what ``work`` returns for the whole texts of a batch.

    ``added`` is the schema of the new columns; other columns pass unchanged whatever their type.
    A null text is an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in df.columns if c != "text"]
    fields = df.sparkSession.createDataFrame([], added).schema
    schema = df.select(*kept).schema
    for field in fields:
        schema = schema.add(field)
    types = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = work(texts)
            columns = [batch.column(c) for c in kept] + [pa.array(found[f.name], type=f.type) for f in types]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *types.names])

    return df.select(*kept, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
