"""Batch text-to-vector with a model given by the user."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import embedding_text

BATCH = 64
Model = Callable[[list[str]], list[list[float]]]


def hashing_model(dimension: int = 64) -> Model:
    """Deterministic stand-in for a real model: hashed words, normalised."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimension))
        for row, text in enumerate(texts):
            for word in text.lower().split():
                digest = hashlib.md5(word.encode()).digest()
                out[row, digest[0] % dimension] += 1.0 if digest[1] % 2 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()

    return embed


def embed_articles(
    articles: DataFrame,
    load_model: Callable[[], Model],
    prefix: str = "query: ",
    limit: int | None = None,
) -> DataFrame:
    """Fill missing ``embedding`` values.

    ``load_model`` runs once per Python worker task.  Rows that have a vector never leave
    the JVM; the others go to Python in Arrow batches and to the model 64 at a time.
    """
    rows = articles
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<double>"))
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    present = rows.filter("embedding is not null")
    missing = rows.filter("embedding is null").drop("embedding").withColumn(
        "_text", embedding_text("titulo", "resumen", prefix, limit)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in batches:
            texts = pdf["_text"].tolist()
            vectors: list[list[float]] = []
            for start in range(0, len(texts), BATCH):
                vectors.extend(model(texts[start : start + BATCH]))
            yield pdf.drop(columns="_text").assign(embedding=vectors)

    schema = StructType([*missing.drop("_text").schema.fields, rows.schema["embedding"]])
    filled = missing.mapInPandas(run, schema)
    return present.unionByName(filled.select(*rows.columns))
