"""Language of a text: known words first, shorter and shorter character n-grams for the others.

A word that the labelled texts hold at least ``MIN_WORD`` times adds its log frequency in each language.
An unseen word adds the mean log frequency of its n-grams of the longest order of which the labelled texts
know any (5 down to 1, word borders included).  The language with the largest sum wins.

Null texts and texts without a letter are ``und`` with score 0.  A text with letters of which nothing is
known gets the most frequent language of the labels with its share.  Without any labels all is ``und``.
Equal sums go to the language that comes first in the alphabet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import bounded_sample, held_out, map_texts, slices, spread

#: Labelled rows the model is fitted on, and characters of the longest text among them.
FIT_ROWS = 6000
FIT_CHARS = 32768
MIN_WORD = 2
ORDERS = range(1, 6)
SMOOTH = 0.1


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Model from ``text`` and non-null ``lang`` of a bounded sample of rows."""
    labelled = rows.filter(F.col("lang").isNotNull() & (F.length("text").between(1, FIT_CHARS)))
    sample = bounded_sample(labelled.select("doc_id", "text", "lang"), fit_rows, "doc_id", "text")

    def count(batches):
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                texts = group["text"].tolist()
                for lo, hi in slices([len(t) for t in texts]):
                    words = flat.Words(texts[lo:hi])
                    keys, index, inverse = words.unique()
                    n = np.bincount(inverse, minlength=len(keys))
                    parts = [(0, keys, n)]
                    for order, owner, gram in words.grams(index, ORDERS):
                        found, at = np.unique(gram, return_inverse=True)
                        parts.append((order, found, np.bincount(at, weights=n[owner])))
                    for order, key, freq in parts:
                        yield pd.DataFrame(
                            {"lang": lang, "kind": order, "key": key.view(np.int64), "n": freq.astype(np.int64)}
                        )

    docs = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(docs)
    model = {"langs": langs, "tables": []}
    if not langs:
        return model
    share = np.array([docs[lang] for lang in langs], dtype=float)
    model["share"] = share / share.sum()
    each = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    counts = (
        spread(sample).select("text", "lang").mapInPandas(count, "lang string, kind int, key long, n long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n"), *each)
        .filter((F.col("kind") > 0) | (F.col("n") >= MIN_WORD))
    )
    # Bounded: as many rows as a sample of FIT_ROWS texts of FIT_CHARS characters can have at most.
    found = counts.drop("n").toPandas()
    for kind in (0, *ORDERS):
        part = found[found["kind"] == kind].sort_values("key")
        keys = part["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        n = part[[f"n{i}" for i in range(len(langs))]].to_numpy(float)[order]
        logs = np.log((n + SMOOTH) / (n.sum(0) + SMOOTH * (len(keys) + 1)))
        model["tables"].append((keys[order], logs.astype(np.float32)))
    return model


def score_texts(model: dict, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, out, scores = model["langs"], ["und"] * len(texts), np.zeros(len(texts))
    if not langs:
        return out, scores
    for lo, hi in slices([len(t) for t in texts]):
        words = flat.Words(texts[lo:hi])
        if not len(words.hash):
            continue
        keys, index, inverse = words.unique()
        known, logs = model["tables"][0]
        at = flat.find(known, keys)
        value = np.where((at >= 0)[:, None], logs[at] if len(logs) else 0.0, 0.0)
        open_ = np.flatnonzero(at < 0)
        per_order = {n: (owner, gram) for n, owner, gram in words.grams(index[open_], ORDERS)}
        done = np.zeros(len(open_), dtype=bool)
        for n in reversed(ORDERS):
            if n not in per_order:
                continue
            owner, gram = per_order[n]
            todo = ~done[owner]
            owner, gram = owner[todo], gram[todo]
            known, logs = model["tables"][n]
            at = flat.find(known, gram)
            owner, at = owner[at >= 0], at[at >= 0]
            hits = np.bincount(owner, minlength=len(open_))
            some = hits > 0
            for k in range(len(langs)):
                total = np.bincount(owner, weights=logs[at, k], minlength=len(open_))
                value[open_[some], k] = total[some] / hits[some]
            done |= some
        total = np.stack([np.bincount(words.doc, weights=value[inverse, k], minlength=hi - lo) for k in range(len(langs))], 1)
        has = np.bincount(words.doc, minlength=hi - lo) > 0
        nothing = has & (total == 0).all(1)
        chance = np.exp(total - total.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        chance[nothing] = model["share"]
        best = chance.argmax(1)
        for i in np.flatnonzero(has):
            out[lo + i] = langs[best[i]]
            scores[lo + i] = chance[i, best[i]]
    return out, scores


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of ``text``, from ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts):
        langs, scores = score_texts(shared.value, texts)
        return {"lang_pred": langs, "score": scores}

    rest = docs.drop("lang_pred", "score")
    return map_texts(spread(rest), predict, "lang_pred string, score double")


def op1(documents: DataFrame) -> DataFrame:
    model = fit(documents.filter(~held_out(F.col("doc_id"))))
    out = identify(documents.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
