"""Token counts with a cache of stored counts, keyed by digests of content and tokenizer.

Every text is known by the SHA-256 of its normalised content, and every tokenizer by the digest of its file and
settings.  Counts that the cache (a Parquet table) holds for both digests are joined; only the distinct texts that
it lacks are encoded, and their counts are appended.  A second run over the same texts encodes nothing.

The content is normalised only as far as the tokenizer itself does before it counts: not at all for the
vocabularies here, but for null, which is the empty text.  Null and empty texts have no tokens.  Repeated rows and
null ids stay rows.  An empty table gives an empty result and leaves the cache as it is.

A cache is written by one job at a time; a count that is stored twice is read once.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, shared_folder, spread, store

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Words whose counts a task remembers; it forgets them all beyond that.
REMEMBERED = 400_000

CACHE = "tokenizer string, content string, n_tokens bigint"


@lru_cache(maxsize=4)
def tokenizer_digest(name: str = VOCABULARY) -> str:
    """Digest of the tokenizer's file and of how texts are given to it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return hashlib.sha256(file.read() + b"|whole texts, no added ids").hexdigest()


class Counter:
    """Counts tokens of whole texts as the library of the file does."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers

        path = public_tokenizers.path(name)
        self.words: dict[str, int] = {}
        self.split = None
        if name.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i)]
            # Merges never cross a place that no piece spans: before a space, before and after a line end.
            # Runs of several spaces may be pieces, so they stay whole.
            apart = not any(re.search("[^▁]▁|\n", p) for p in pieces)
            if apart and self.encode(["a b\n\nc  d", "\nb"]) == [self._count(t) for t in ("a b\n\nc  d", "\nb")]:
                self.split = re.compile(" +[^ \n]*|\n[^ \n]*")
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]

    def _count(self, text: str) -> int:
        return sum(self._parts(re.findall(" +[^ \n]*|\n[^ \n]*", " " + text)))

    def _parts(self, parts: list[str]) -> list[int]:
        """Tokens of parts that begin with a space (which the model itself puts first) or a line end."""
        found = self.encode([p[1:] if p[0] == " " else p for p in parts])
        return [1 if p == " " else n - (p[0] == "\n") for p, n in zip(parts, found)]

    def __call__(self, texts: list[str]) -> list[int]:
        if self.split is None:
            return self.encode(texts) if texts else []
        words = self.words
        if len(words) > REMEMBERED:
            words.clear()
        parted = [self.split.findall(" " + t) if t and "▁" not in t else [] for t in texts]
        new = list({p for parts in parted for p in parts if p not in words})
        words.update(zip(new, self._parts(new)))
        get = words.__getitem__
        out = [sum(map(get, parts)) for parts in parted]
        for i, t in enumerate(texts):
            if "▁" in t:
                out[i] = self.encode([t])[0]
        return out


@lru_cache(maxsize=2)
def _counter(name: str) -> Counter:
    return Counter(name)


def _encoded(misses: DataFrame, name: str) -> DataFrame:
    """(content, n_tokens) of rows of ``content`` and ``text``."""

    def run(batches):
        count = _counter(name)
        for batch in batches:
            n = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(np.array(n, dtype=np.int64))], names=["content", "n_tokens"]
            )

    return misses.select("content", "text").mapInArrow(run, "content string, n_tokens bigint")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that isn't there yet is made empty."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def count(docs: DataFrame, cache: str, name: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` in place of ``text``; the cache at this path gains the misses."""
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(name)
    rest = [c for c in docs.columns if c not in ("text", "content", "n_bytes", "n_tokens")]
    text = F.coalesce("text", F.lit(""))
    rows = spread(docs).select(*rest, text.alias("text")).withColumn("content", F.sha2("text", 256))
    known = read_cache(spark, cache).filter(F.col("tokenizer") == tokenizer)
    misses = rows.select("content", "text").join(known.select("content"), "content", "left_anti")
    # One text per digest; equal texts of a split are already one before the shuffle.
    distinct = misses.groupBy("content").agg(F.first("text").alias("text"))
    _encoded(distinct, name).select(F.lit(tokenizer).alias("tokenizer"), "content", "n_tokens").write.mode(
        "append"
    ).parquet(cache)
    stored = (
        read_cache(spark, cache).filter(F.col("tokenizer") == tokenizer).groupBy("content")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    keyed = store(
        rows.select(*rest, "content", F.octet_length("text").cast("long").alias("n_bytes")), "token-rows"
    )
    return hot_join(keyed, stored, "content").select(*rest, "n_bytes", "n_tokens")


def op5(documents: DataFrame, cache: str | None = None) -> DataFrame:
    """Counts of all documents; without a path the cache is a new table in the shared folder."""
    if cache is None:
        import uuid

        cache = f"{shared_folder(documents.sparkSession)}/token-cache-{uuid.uuid4().hex}"
    out = count(documents.select("doc_id", "text"), cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
