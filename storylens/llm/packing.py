"""Packing documents into sequences of a fixed length, with a certificate of how few are needed.

Each document is tokenized where it is read; an end token follows it.  A document that is longer than a
sequence is cut into pieces of full length, of which the first may be shorter.  Full pieces are sequences of
their own.  The others are dealt at random into partitions of about ``PART_ITEMS`` pieces, and each partition is
packed by best-fit decreasing.  Lower bounds from dual-feasible functions certify the number of sequences a
partition needs at least.  Partitions that need more than their bound exchange their documents (they are dealt
anew among them) and are packed again, up to ``ROUNDS`` times; an exchange that saves nothing is not taken.

Null and empty texts are a lone end token.  Repeated rows and null ids are packed like others.  An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import spread, store

LENGTH = 1024
END_ID = 2
PART_ITEMS = 32768
ROUNDS = 3
VOCABULARY = "byte_bpe_50k"

PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint, uid bigint"
PLACE = "part bigint, bin bigint, offset bigint, bins bigint, bound bigint"


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY):
    """ids (uint32) of a whole text, as the ``tokenizers`` file of this name gives them.

    The ranks of the same vocabulary are read by the faster library; special strings in texts become
    their ids, as is the default of ``tokenizers``.  Texts that it refuses go to ``tokenizers`` itself.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # its pattern engine gives up on some very long runs
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = (n - 1) % length + 1
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def pieces(docs: DataFrame, length: int = LENGTH, name: str = VOCABULARY) -> DataFrame:
    """A row per piece: the columns of ``docs`` but ``text``, and those of ``PIECE``."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("text", "piece", "start", "length", "ids_crc32", "uid")]
    added = spark.createDataFrame([], PIECE).schema
    schema = StructType([*docs.select(*kept).schema.fields, *added.fields[:-1]])
    types = to_arrow_schema(StructType(added.fields[:-1]))

    def run(batches):
        encode = encoder(name)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    rows.append((i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            of, *columns = zip(*rows) if rows else ([],) * 5
            at = pa.array(of, pa.int64())
            arrays = [batch.column(c).take(at) for c in kept]
            arrays += [pa.array(v, type=t) for v, t in zip(columns, types.types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *types.names])

    texts = spread(docs.select(*kept, F.coalesce("text", F.lit("")).alias("text")))
    return texts.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id())


def best_fit(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the fullest bin that still takes it."""
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by the room they have left
    some = 0  # bit r: there is a bin with room r
    n = 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            which = open_bins[room].pop()
            if not open_bins[room]:
                some ^= 1 << room
        else:
            room, which = capacity, n
            n += 1
        bins[i], offsets[i] = which, capacity - room
        left = room - size
        if left:
            if not open_bins[left]:
                some |= 1 << left
            open_bins[left].append(which)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = LENGTH) -> int:
    """Sequences needed at least: the best of two families of dual-feasible functions.

    A function is dual feasible if its values over any items that fit into one bin add up to one bin at
    most; the sum of its values over all items is then a bound.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for e in range(1, capacity // 2 + 1):  # short items as nothing, those that fit beside short ones only as a bin
        value = np.where(size > capacity - e, capacity, np.where(size >= e, size, 0))
        best = max(best, -(-int((count * value).sum()) // capacity))
    for k in range(1, 33):  # rounding down to a k-th, unless the size is a multiple of a (k+1)-th
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def _packed(items: DataFrame, capacity: int) -> DataFrame:
    """Each partition ``part`` packed on its own."""
    added = items.sparkSession.createDataFrame([], PLACE).schema
    schema = StructType([*items.schema.fields, *added.fields[1:]])
    names = schema.names

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")  # the result does not depend on the order of arrival
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        n = len(lengths)
        used = int(bins.max()) + 1 if n else 0
        for name, value in (
            ("bin", bins), ("offset", offsets), ("bins", np.full(n, used)),
            ("bound", np.full(n, lower_bound(lengths, capacity))),
        ):
            table = table.append_column(name, pa.array(value, pa.int64()))
        return table.select(names)

    return items.groupBy("part").applyInArrow(run, schema)


def _totals(packed: DataFrame) -> tuple[int, int]:
    """Partitions and sequences."""
    row = packed.groupBy("part").agg(F.max("bins").alias("bins")).agg(F.count(F.lit(1)), F.sum("bins")).first()
    return row[0], row[1] or 0


def pack(items: DataFrame, length: int = LENGTH, part_items: int = PART_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``pieces`` with ``sequence_id`` and ``offset``."""
    items = store(items, "packing-pieces")
    names = items.columns
    full = items.filter(F.col("length") == length)
    out = full.select(*names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("length") < length)
    n_parts = max(1, -(-rest.count() // part_items))
    dealt = lambda df, n, turn: df.withColumn(
        "part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(n)) + F.lit(turn << 40)
    )
    current = store(_packed(dealt(rest, n_parts, 0), length), "packing-0")
    placed = lambda df: df.select(
        *names, (F.col("part") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset"
    )
    pool = current.filter("bins > bound")
    out = out.unionByName(placed(current.filter("bins <= bound")))
    for turn in range(1, rounds + 1):
        n, used = _totals(pool)
        if n < 2:
            break
        again = store(_packed(dealt(pool.select(*names), n, turn), length), f"packing-{turn}")
        if _totals(again)[1] < used:
            out = out.unionByName(placed(again.filter("bins <= bound")))
            pool = again.filter("bins > bound")
    return out.unionByName(placed(pool))


def op4(documents: DataFrame) -> DataFrame:
    return pack(pieces(documents.select("doc_id", "text"))).drop("uid")
