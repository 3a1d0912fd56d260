"""Scores of documents by masked pseudo-likelihood under a small bidirectional window network.

Tokens are words: the most frequent ones of the whole corpus have ids of their own, all others share ``BUCKETS`` ids
by their hash.  The network sees ``SIDE`` tokens on both sides of a position and predicts the hidden token in the
middle: first its class, then the token within the class, so every probability is normalised over all tokens.
A document's score is the sum of the conditional log probabilities of all its tokens.

Word counts cover every document.  Every position of every document is a target once, with its neighbours as
context.  Each round sends the network to
all partitions; each trains its copy on its documents with numpy, and the copies are averaged with the number of
targets as weight.  Documents are dealt to the rounds by hash.

Null, empty and wordless texts have no tokens and score 0.  Repeated rows and null ids stay rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import map_texts, slices, spread, store

CLASSES, IN_CLASS = 24, 24
TOKENS = CLASSES * IN_CLASS
BUCKETS = 64
SIDE = 2
DIM, HIDDEN = 12, 24
PAD = TOKENS  # beyond the ends of a document
ROUNDS = 2
BATCH, RATE = 256, 0.1
SHARES = 64  # pieces of the parameters that are averaged on their own


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n): occurrences of each word in all documents."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, n = [keys], [counts]
            for lo, hi in slices([len(t) for t in texts]):
                k, c = np.unique(flat.Words(texts[lo:hi]).hash, return_counts=True)
                found.append(k)
                n.append(c)
            keys, at = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate(n), minlength=len(keys)).astype(np.int64)
            if len(keys) > 500_000:  # pass on what was counted, to bound the memory of a task
                yield _counted(keys, counts)
                keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield _counted(keys, counts)

    texts = spread(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _counted(keys, counts):
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent words and their ids."""
    top = counts.orderBy(F.desc("n"), "key").limit(TOKENS - BUCKETS).collect()
    keys = np.array([r["key"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], order.astype(np.int64)


def token_ids(vocab: tuple[np.ndarray, np.ndarray], texts: list[str]) -> list[np.ndarray]:
    out = []
    for lo, hi in slices([len(t) for t in texts]):
        words = flat.Words(texts[lo:hi])
        at = flat.find(vocab[0], words.hash)
        rare = TOKENS - BUCKETS + (words.hash % np.uint64(BUCKETS)).astype(np.int64)
        ids = np.where(at >= 0, vocab[1][at] if len(vocab[1]) else 0, rare).astype(np.int16)
        out += np.split(ids, np.searchsorted(words.doc, np.arange(1, hi - lo)))
    return out


def new_network(seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat_net = np.zeros(_size(), dtype=np.float32)
    for name, part in views(flat_net).items():
        if name in ("E", "W", "C", "T"):
            part[...] = rng.normal(0, part.shape[-1] ** -0.5 if name != "W" else part.shape[0] ** -0.5, part.shape)
    return flat_net


def _shapes() -> dict[str, tuple[int, ...]]:
    return {
        "E": (TOKENS + 1, DIM), "W": (2 * SIDE * DIM, HIDDEN), "b": (HIDDEN,),
        "C": (HIDDEN, CLASSES), "c": (CLASSES,), "T": (CLASSES, HIDDEN, IN_CLASS), "t": (CLASSES, IN_CLASS),
    }


def _size() -> int:
    return sum(int(np.prod(s)) for s in _shapes().values())


def views(flat_net: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _shapes().items():
        n = int(np.prod(shape))
        out[name] = flat_net[at : at + n].reshape(shape)
        at += n
    return out


def contexts(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token the ids of its neighbours, nearest left ones first; beyond a document the pad."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    begins = ends - np.repeat(lengths, lengths)
    at = np.arange(len(ids))
    out = np.full((len(ids), 2 * SIDE), PAD, dtype=np.int64)
    for k in range(1, SIDE + 1):
        left, right = at - k >= begins, at + k < ends
        out[left, k - 1] = ids[at[left] - k]
        out[right, SIDE + k - 1] = ids[at[right] + k]
    return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def log_probs(net: dict, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log probability of each token beside its neighbours."""
    out = np.empty(len(ids), dtype=np.float32)
    for lo in range(0, len(ids), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        h = np.tanh(net["E"][around[part]].reshape(-1, 2 * SIDE * DIM) @ net["W"] + net["b"])
        kind, place = ids[part] % CLASSES, ids[part] // CLASSES
        logits = _log_softmax(h @ net["C"] + net["c"])
        found = logits[np.arange(len(h)), kind]
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            of = order[bounds[k] : bounds[k + 1]]
            if len(of):
                inner = _log_softmax(h[of] @ net["T"][k] + net["t"][k])
                found[of] += inner[np.arange(len(of)), place[of]]
        out[part] = found
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax in place."""
    x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-1, keepdims=True)
    return x


def train(flat_net: np.ndarray, squares: np.ndarray, around: np.ndarray, ids: np.ndarray) -> None:
    """One pass of steps with per-parameter rates over targets, in the order given."""
    net = views(flat_net)
    gradient = np.zeros_like(flat_net)
    grad = views(gradient)
    for lo in range(0, len(ids), BATCH):
        # The targets of a step in order of class: a class is a range of rows, sums are sums of ranges.
        order = np.argsort(ids[lo : lo + BATCH] % CLASSES, kind="stable")
        near, target = around[lo : lo + BATCH][order], ids[lo : lo + BATCH][order]
        rows = np.arange(len(target))
        kind, place = target % CLASSES, target // CLASSES
        bounds = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        ranges = [(k, slice(i, j)) for k, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
        x = net["E"][near].reshape(len(target), -1)
        h = np.tanh(x @ net["W"] + net["b"])
        d_class = _softmax(h @ net["C"] + net["c"])
        d_class[rows, kind] -= 1
        inner = net["t"][kind]
        for k, of in ranges:
            inner[of] += h[of] @ net["T"][k]
        _softmax(inner)
        inner[rows, place] -= 1
        gradient[:] = 0
        grad["C"][...], grad["c"][...] = h.T @ d_class, d_class.sum(0)
        d_h = d_class @ net["C"].T
        for k, of in ranges:
            d_h[of] += inner[of] @ net["T"][k].T
            grad["T"][k] = h[of].T @ inner[of]
        grad["t"][[k for k, _ in ranges]] = np.add.reduceat(inner, [of.start for _, of in ranges])
        d_h *= 1 - h * h
        grad["W"][...], grad["b"][...] = x.T @ d_h, d_h.sum(0)
        # Every place of a row of E is a counter that its parts are added to.
        places = near.ravel()[:, None] * DIM + np.arange(DIM)
        grad["E"][...] = np.bincount(places.ravel(), (d_h @ net["W"].T).ravel(), grad["E"].size).reshape(-1, DIM)
        gradient /= len(target)
        squares += gradient * gradient
        flat_net -= RATE * gradient / np.sqrt(squares + 1e-8)


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("ids")
    return column.flatten().to_numpy().astype(np.int64), column.value_lengths().to_numpy().astype(np.int64)


def fit(tokens: DataFrame) -> np.ndarray:
    """Parameters trained on all rows of ``ids`` (arrays of token ids) and ``turn``."""
    context = tokens.sparkSession.sparkContext
    flat_net = new_network()
    per_share = -(-len(flat_net) // SHARES)
    for turn in range(ROUNDS):
        shared = context.broadcast(flat_net)

        def run(batches, shared=shared):
            mine, squares, seen = shared.value.copy(), np.zeros(_size(), dtype=np.float32), 0
            for batch in batches:
                ids, lengths = _ids(batch)
                chosen = np.random.default_rng(len(ids)).permutation(len(ids))  # mixes documents of a batch
                train(mine, squares, contexts(ids, lengths)[chosen], ids[chosen])
                seen += len(chosen)
            if seen:
                padded = np.zeros(per_share * SHARES)
                padded[: len(mine)] = mine.astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(SHARES), pa.int32()), pa.array(padded.reshape(SHARES, -1).tolist(), pa.list_(pa.float64())),
                     pa.array([seen] * SHARES, pa.int64())], names=["share", "sums", "seen"],
                )

        copies = tokens.filter(F.col("turn") == turn).select("ids").mapInArrow(
            run, "share int, sums array<double>, seen long"
        )
        # Copies are added up in tasks; the driver gets one network whatever the number of partitions.
        added = copies.select("share", "seen", F.posexplode("sums").alias("at", "value")).groupBy("share", "at").agg(
            (F.sum("value") / F.sum("seen")).alias("value")
        )
        found = added.collect()
        if found:
            fresh = np.zeros(per_share * SHARES, dtype=np.float32)
            for r in found:
                fresh[r["share"] * per_share + r["at"]] = r["value"]
            flat_net = fresh[: len(flat_net)]
    return flat_net


def score(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens``, ``log_prob`` (the sum) and ``mean_log_prob`` in place of ``text``."""
    context = docs.sparkSession.sparkContext
    vocab = context.broadcast(vocabulary(word_counts(docs)))
    rest = [c for c in docs.columns if c not in ("text", "ids", "turn", "n_tokens", "log_prob", "mean_log_prob")]
    dealt = docs.select(*rest, "text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS)).alias("turn"))
    # 16-bit ids instead of texts: read once per round and once to score.
    tokens = store(
        map_texts(spread(dealt), lambda texts: {"ids": token_ids(vocab.value, texts)}, "ids array<smallint>"), "lm-tokens"
    )
    net = context.broadcast(fit(tokens))
    schema = docs.sparkSession.createDataFrame([], "n_tokens bigint, log_prob double").schema
    out_schema = tokens.select(*rest).schema
    for field in schema:
        out_schema = out_schema.add(field)

    def run(batches):
        parts = views(net.value)
        for batch in batches:
            ids, lengths = _ids(batch)
            logs = log_probs(parts, contexts(ids, lengths), ids).astype(np.float64)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            total = np.bincount(doc, weights=logs, minlength=len(lengths))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(lengths, pa.int64()), pa.array(total, pa.float64())],
                names=[*rest, "n_tokens", "log_prob"],
            )

    scored = tokens.select(*rest, "ids").mapInArrow(run, out_schema)
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def op2(documents: DataFrame) -> DataFrame:
    return score(documents.select("doc_id", "text"))
