"""Toxicity of a text: a bidirectional gated recurrent network with attention over overlapping word windows.

Every word enters as a vector of word inputs (a learned embedding and the log odds of the word in labelled
texts) and character inputs (a learned embedding and log odds of its character n-grams).  A gated recurrent
layer reads a window in both directions, attention pools its states, and a logistic unit scores the window.
A text scores as its highest window; windows overlap by half and cover the whole text.

Labels say only that a text is toxic somewhere, so training first takes the windows with the strongest log
odds as examples, then those that the network itself finds strongest.  Log odds used in training come from
the other half of the labelled texts.

Null, empty and wordless texts score 0.  Without labels of both kinds every text scores 0.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import bounded_sample, held_out, map_texts, slices, spread

#: Labelled rows of each kind that the network is fitted on, and characters of the longest text among them.
FIT_TOXIC = 1000
FIT_CLEAN = 1600
FIT_CHARS = 8000
FIT_SLICE = 50
WINDOW, STRIDE = 32, 16
THRESHOLD = 0.3
ORDERS = range(4, 7)
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 4
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 15
TURNS, STEPS, BATCH, RATE = 3, 300, 64, 0.01
#: Share of words whose learned embeddings are hidden in a training step, so that the network cannot learn texts by heart.
HIDE = 0.5
PIECE = 1 << 21


class Features:
    """Inputs of the distinct words of some texts."""

    def __init__(self, texts: list[str]):
        self.words = flat.Words(texts, digits=True)
        self.keys, index, self.word_of = self.words.unique()
        owners, grams = [np.zeros(0, int)], [np.zeros(0, np.uint64)]
        for _, owner, gram in self.words.grams(index, ORDERS):
            owners.append(owner)
            grams.append(gram)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.owner, self.gram = owner[order], np.concatenate(grams)[order]
        self.n_grams = np.bincount(self.owner, minlength=len(self.keys))
        self.first_gram = np.concatenate(([0], np.cumsum(self.n_grams)))
        self.bucket = (self.keys & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
        self.gram_bucket = (self.gram & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64)

    def odds(self, tables) -> np.ndarray:
        """Log odds of each word, the largest of its n-grams and their mean."""
        out = np.zeros((len(self.keys), 3), dtype=np.float32)
        for column, keys in ((0, self.keys), (1, self.gram)):
            known, value = tables[column]
            at = flat.find(known, keys)
            found = np.where(at >= 0, value[at] if len(value) else 0, 0).astype(np.float32)
            if column == 0:
                out[:, 0] = found
            elif len(found):
                has = self.n_grams > 0
                begin = self.first_gram[:-1][has]
                out[has, 1] = np.maximum.reduceat(found, begin)
                out[has, 2] = np.add.reduceat(found, begin) / self.n_grams[has]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of every window (the pad is one past the last word) and its text."""
        count = np.bincount(self.words.doc, minlength=self.words.n_docs)
        begin = np.concatenate(([0], np.cumsum(count)[:-1]))
        each = np.where(count > 0, np.maximum(0, -(-(count - WINDOW) // STRIDE)) + 1, 0)
        doc = np.repeat(np.arange(len(count)), each)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        at = begin[doc][:, None] + (number * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < (begin + count)[doc][:, None]
        padded = np.append(self.word_of, len(self.keys))
        return padded[np.where(inside, at, len(self.word_of))], doc


def log_odds(features: Features, labels: np.ndarray, among: np.ndarray | None = None):
    """For words and n-grams: sorted keys and shrunken log odds by the number of texts that hold them."""
    among = np.ones(len(labels), dtype=bool) if among is None else among
    words, n_words = features.words, max(1, len(features.keys))
    pair = flat.distinct(words.doc * n_words + features.word_of)
    doc, word = np.divmod(pair, n_words)
    gram_keys, gram_number = np.unique(features.gram, return_inverse=True)
    counts = [np.zeros((2, len(features.keys)), dtype=np.int64), np.zeros((2, len(gram_keys)), dtype=np.int64)]
    for lo in range(0, len(labels), FIT_SLICE):  # some texts at a time: their n-grams are many
        of = slice(*np.searchsorted(doc, [lo, lo + FIT_SLICE]))
        n = features.n_grams[word[of]]
        held = gram_number[np.repeat(features.first_gram[word[of]], n) + _ranges(n)]
        in_doc, gram = np.divmod(flat.distinct(np.repeat(doc[of], n) * max(1, len(gram_keys)) + held), max(1, len(gram_keys)))
        for count, number, texts in ((counts[0], word[of], doc[of]), (counts[1], gram, in_doc)):
            for kind in (0, 1):
                count[kind] += np.bincount(number[(labels[texts] == kind) & among[texts]], minlength=count.shape[1])
    tables = []
    toxic, clean = labels[among].sum(), (1 - labels[among]).sum()
    for keys, (c, t) in ((features.keys, counts[0]), (gram_keys, counts[1])):
        value = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        value *= (t + c) / (t + c + 4)
        often = t + c >= 2
        tables.append((keys[often], value[often].astype(np.float32)))
    return tables


def _ranges(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_network(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = 3 + WORD_DIM + CHAR_DIM, HIDDEN
    net = {
        "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "char": rng.normal(0, 0.1, (CHAR_BUCKETS, CHAR_DIM)),
        "W": rng.normal(0, d**-0.5, (2, d, 3 * h)), "U": rng.normal(0, h**-0.5, (2, h, 3 * h)),
        "b": np.zeros((2, 1, 3 * h)), "a": np.zeros(2 * h), "w": rng.normal(0, 0.3, 2 * h), "c": np.full(1, -2.0),
    }
    return {k: v.astype(np.float32) for k, v in net.items()}


def word_inputs(net: dict, features: Features, odds: np.ndarray) -> np.ndarray:
    """Vector of every distinct word, and of the pad."""
    chars = np.zeros((len(features.keys), CHAR_DIM), dtype=np.float32)
    if len(features.gram):
        has = features.n_grams > 0
        sums = np.add.reduceat(net["char"][features.gram_bucket], features.first_gram[:-1][has], axis=0)
        chars[has] = sums / features.n_grams[has][:, None]
    x = np.concatenate([odds, net["word"][features.bucket], chars], axis=1)
    return np.concatenate([x, np.zeros((1, x.shape[1]), dtype=np.float32)])


def read(net: dict, projected: np.ndarray, windows: np.ndarray, pad: int, trace: list | None = None):
    """Logit of each window.  ``projected``: input part of the gates of each word and direction."""
    h, size = HIDDEN, len(windows)
    state = np.zeros((2, size, h), dtype=np.float32)
    states = np.empty((WINDOW, size, 2 * h), dtype=np.float32)
    for t in range(WINDOW):
        x = np.stack([projected[0][windows[:, t]], projected[1][windows[:, WINDOW - 1 - t]]])
        g = state @ net["U"]
        zr = _sigmoid(x[..., : 2 * h] + g[..., : 2 * h])
        z, r = zr[..., :h], zr[..., h:]
        n = np.tanh(x[..., 2 * h :] + r * g[..., 2 * h :])
        new = n + z * (state - n)
        if trace is not None:
            trace.append((state, z, r, n, g[..., 2 * h :]))
        state = new
        states[t, :, :h], states[WINDOW - 1 - t, :, h:] = new[0], new[1]
    e = states @ net["a"]
    e[(windows == pad).T] = -1e9
    e = np.exp(e - e.max(0))
    weight = e / e.sum(0)
    pooled = (weight[..., None] * states).sum(0)
    return pooled @ net["w"] + net["c"][0], states, weight, pooled


def _sum_by(values: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their number below ``n``."""
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    if len(number):
        order = np.argsort(number, kind="stable")
        there, begin = np.unique(number[order], return_index=True)
        out[there] = np.add.reduceat(values[order], begin, axis=0)
    return out


def _step(net: dict, features: Features, odds: np.ndarray, windows: np.ndarray, y: np.ndarray, rng) -> tuple:
    """Gradients of the cross entropy of a batch of windows: of dense parts, and of rows of the embeddings."""
    pad, h = len(features.keys), HIDDEN
    used, local = np.unique(windows, return_inverse=True)
    local = local.reshape(windows.shape)
    real = used[used < pad]
    n = features.n_grams[real]
    grams = features.gram_bucket[np.repeat(features.first_gram[real], n) + _ranges(n)]
    owner = np.repeat(np.arange(len(real)), n)
    share = (1 / np.maximum(n, 1))[:, None].astype(np.float32)
    shown = (rng.random((len(real), 1)) >= HIDE).astype(np.float32)
    learned = np.concatenate([net["word"][features.bucket[real]], _sum_by(net["char"][grams], owner, len(real)) * share], 1)
    x = np.concatenate([odds[real], learned * shown], axis=1)
    x = np.concatenate([x, np.zeros((len(used) - len(real), x.shape[1]), dtype=np.float32)])
    trace: list = []
    logit, states, weight, pooled = read(net, x @ net["W"] + net["b"], local, len(real), trace)
    grad = {}
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    grad["c"], grad["w"] = d.sum(keepdims=True), pooled.T @ d
    d_pooled = d[:, None] * net["w"]
    d_weight = (states * d_pooled).sum(-1)
    d_e = weight * (d_weight - (weight * d_weight).sum(0))
    grad["a"] = (d_e[..., None] * states).sum((0, 1))
    d_states = weight[..., None] * d_pooled + d_e[..., None] * net["a"]
    d_gates = np.empty((2, WINDOW, len(y), 3 * h), dtype=np.float32)
    d_next = np.zeros((2, len(y), h), dtype=np.float32)
    grad["U"] = np.zeros_like(net["U"])
    for t in reversed(range(WINDOW)):
        before, z, r, new, g_n = trace[t]
        d_h = d_next + np.stack([d_states[t, :, :h], d_states[WINDOW - 1 - t, :, h:]])
        a_n = d_h * (1 - z) * (1 - new * new)
        a_r = a_n * g_n * r * (1 - r)
        a_z = d_h * (before - new) * z * (1 - z)
        d_g = np.concatenate([a_z, a_r, a_n * r], axis=-1)
        d_gates[:, t] = np.concatenate([a_z, a_r, a_n], axis=-1)
        grad["U"] += np.swapaxes(before, 1, 2) @ d_g
        d_next = d_h * z + d_g @ np.swapaxes(net["U"], 1, 2)
    place = local.T
    d_words = np.stack([_sum_by(d_gates[k].reshape(-1, 3 * h), p.ravel(), len(used)) for k, p in ((0, place), (1, place[::-1]))])
    grad["b"] = d_words.sum(1, keepdims=True)
    grad["W"] = np.swapaxes(x[None], 1, 2) @ d_words
    d_in = (d_words @ np.swapaxes(net["W"], 1, 2)).sum(0)[: len(real), 3:] * shown
    rows = {}
    for name, at, value in (
        ("word", features.bucket[real], d_in[:, :WORD_DIM]), ("char", grams, (d_in[:, WORD_DIM:] * share)[owner]),
    ):
        there, number = np.unique(at, return_inverse=True)
        rows[name] = there, _sum_by(value, number, len(there))
    return grad, rows


def train(net: dict, features: Features, odds: np.ndarray, windows: np.ndarray, y: np.ndarray, seed: int) -> None:
    """Adam over batches of which a quarter is toxic; embeddings by the sum of their squared gradients."""
    rng = np.random.default_rng(seed)
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    m = {k: np.zeros_like(net[k]) for k in ("W", "U", "b", "a", "w", "c")}
    v = {k: np.zeros_like(p) for k, p in m.items()}
    squares = {k: np.full((len(net[k]), 1), 1e-4, dtype=np.float32) for k in ("word", "char")}
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(toxic, BATCH // 4), rng.choice(clean, BATCH - BATCH // 4)])
        grad, rows = _step(net, features, odds, windows[pick], y[pick], rng)
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        for k, (at, g) in rows.items():
            squares[k][at] += (g * g).mean(1, keepdims=True)
            net[k][at] -= rate * g / np.sqrt(squares[k][at])


def window_logits(net: dict, features: Features, odds: np.ndarray, windows: np.ndarray) -> np.ndarray:
    projected = word_inputs(net, features, odds) @ net["W"] + net["b"]
    out = [read(net, projected, windows[i : i + 1024], len(features.keys))[0] for i in range(0, len(windows), 1024)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.float32)


def _strongest(score: np.ndarray, doc: np.ndarray, per_doc: int) -> np.ndarray:
    """Positions of the highest scores of each text."""
    order = np.lexsort((-score, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    return order[rank < per_doc]


def fit_texts(texts: list[str], labels: list[int], seed: int = 7) -> dict | None:
    """Network and tables from labelled texts; None without texts of both kinds."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    half = rng.permutation(len(y)) % 2
    features = Features(texts)
    windows, doc = features.windows()
    parts = []
    for k in (0, 1):
        other = half != k if (half != k).any() else half == k
        parts.append(features.odds(log_odds(features, y, other)))
    # A word's odds depend on the half its text is in: words are numbered once per half.
    odds = np.concatenate(parts)
    both = _doubled(features)
    pad = len(features.keys)
    shifted = np.where(windows == pad, 2 * pad, windows + half[doc][:, None] * pad)
    strength = np.append(odds[:, :2].max(1), -9.0)[shifted].max(1)
    net = new_network(seed)
    for turn in range(TURNS):
        score = strength if turn == 0 else window_logits(net, both, odds, shifted)
        toxic = y[doc] == 1
        best = _strongest(score, doc, 1)
        hard = _strongest(score, doc, 2)
        some = rng.random(len(doc)) < 0.1
        some[hard] = True
        # A label may be wrong, or its reason unseen elsewhere: toxic texts without stronger evidence
        # than nearly all clean ones teach nothing, as long as they are the smaller part.
        bar = np.quantile(score[best[~toxic[best]]], 0.98) if (~toxic[best]).any() else -np.inf
        positive = best[toxic[best]]
        clear = positive[score[positive] > bar]
        if 2 * len(clear) >= len(positive):
            positive = clear
        chosen = np.concatenate([positive, np.flatnonzero(some & ~toxic)])
        if not len(positive) or toxic[chosen].all():
            return None
        train(net, both, odds, shifted[chosen], toxic[chosen].astype(np.float32), seed + turn)
    return {"net": net, "tables": log_odds(features, y)}


def _doubled(features: Features) -> Features:
    """The same distinct words twice, one after the other."""
    twice = object.__new__(Features)
    twice.keys = np.concatenate([features.keys] * 2)
    twice.owner = np.concatenate([features.owner, features.owner + len(features.keys)])
    for name in ("gram", "n_grams", "bucket", "gram_bucket"):
        setattr(twice, name, np.concatenate([getattr(features, name)] * 2))
    twice.first_gram = np.concatenate(([0], np.cumsum(twice.n_grams)))
    return twice


def score_texts(model: dict | None, texts: list[str]) -> np.ndarray:
    scores = np.zeros(len(texts))
    if model is None:
        return scores
    for lo, hi in slices([len(t) for t in texts], PIECE):
        features = Features(texts[lo:hi])
        windows, doc = features.windows()
        if len(doc):
            logits = window_logits(model["net"], features, features.odds(model["tables"]), windows)
            at, begin = np.unique(doc, return_index=True)
            scores[lo + at] = _sigmoid(np.maximum.reduceat(logits.astype(np.float64), begin))
    return scores


def fit(documents: DataFrame, labels: DataFrame, n_toxic: int = FIT_TOXIC, n_clean: int = FIT_CLEAN) -> dict | None:
    """Model from a bounded sample of the labelled rows that are not held out."""
    of_doc = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    texts = documents.filter(F.length("text").between(1, FIT_CHARS)).select("doc_id", "text")
    parts = []
    for kind, n in ((1, n_toxic), (0, n_clean)):
        # At most 2 n ids are broadcast, and as many texts taken.
        wanted = bounded_sample(of_doc.filter(F.col("toxic") == kind), n, "doc_id")
        parts.append(texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "toxic").limit(2 * n))

    def work(batches):
        rows = sorted(
            (r["doc_id"], r["toxic"], r["text"]) for b in batches for r in b.to_pylist()
        )
        model = fit_texts([r[2] for r in rows], [r[1] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The bounded sample is fitted in one task: it needs no memory of the driver and is repeated if lost.
    fitted = parts[0].unionByName(parts[1]).repartition(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else None


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` in place of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        found = score_texts(shared.value, texts)
        return {"score": found, "predicted": (found >= THRESHOLD).astype(np.int32)}

    return map_texts(spread(docs.drop("score", "predicted")), work, "score double, predicted int")


def op10(documents: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(documents.select("doc_id", "text"), fit(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
