"""Passages of a benchmark inside documents, by the q-gram lemma and banded alignment.

Texts are compared in lower case with runs of white space as one space.  A benchmark item is cut into
segments of ``SEGMENT`` characters that overlap by half (a shorter item is one segment).  A segment of ``m``
characters may differ from a region of a document by ``m // EDIT_SHARE`` edits ``k``.  Then both share at least
``m - q + 1 - k q`` q-grams whose diagonals lie within ``k`` of each other; ``Q`` is so short that this is 1 or more
for every size.  Shared q-grams are counted in bands of ``2 k + 1`` diagonals that overlap by ``k``; bands that reach
the bound are verified by alignment inside the band.  Nothing within the budget is lost.  Items of fewer than
``MIN_CHARS`` characters have no edits: they are found as they are, between characters that are no letters or digits.

The benchmark is a stated query set: it is compared in blocks of at most about ``BLOCK_CHARS`` characters,
of which each is broadcast.  Equal segments are compared once.  Null and blank texts match nothing.  Repeated rows of documents are reported each; a null
``item_id`` is reported as null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import flat
from .common import spread

Q = 10  # MIN_CHARS // 2 at most
SEGMENT = 80
EDIT_SHARE = 16
MIN_CHARS = 20
BLOCK_CHARS = 4 << 20
GAP = 8  # separators between texts: more than the edits of a segment
FILTER_BITS = 22
PIECE = 1 << 20

MATCH = "array<struct<item_id: bigint, start: int, end: int, edits: int>>"


class Normal:
    """Normalised texts in one array of code points, with the place of each in its text."""

    def __init__(self, texts: list[str]):
        _, lower = flat._tables(False)
        gap = "\0" * GAP
        code = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        begins = GAP + np.cumsum(lengths + GAP) - (lengths + GAP)
        blank = _blank()[code]
        zero = np.zeros(len(code), dtype=bool)  # the separators
        zero[(begins[:, None] - 1 - np.arange(GAP)).ravel()] = True
        zero[len(code) - GAP :] = True
        # A blank stays if a character of the text comes right before it, and another one later.
        follows = np.concatenate(([False], ~blank[:-1] & ~zero[:-1]))
        keep = ~blank | follows
        at = np.flatnonzero(keep)
        self.code = np.where(blank[at], np.uint32(32), lower[code[at]])
        ends_blank = (self.code == 32) & np.append(zero[at][1:], True)
        at, self.code = at[~ends_blank], self.code[~ends_blank]
        self.doc = np.searchsorted(begins, at, side="right") - 1
        self.place = at - begins[np.maximum(self.doc, 0)]


_BLANK: list[np.ndarray] = []


def _blank() -> np.ndarray:
    if not _BLANK:
        _BLANK.append(np.array([chr(c).isspace() for c in range(0x110000)]))
    return _BLANK[0]


def _grams(code: np.ndarray) -> np.ndarray:
    """Hash of each run of Q code points."""
    b1, b2, b4 = (np.uint64(pow(int(flat.BASE), e, 1 << 64)) for e in (1, 2, 4))
    h1 = code.astype(np.uint64) * flat.ODD
    h2 = h1[:-1] * b1 + h1[1:]
    h4 = h2[:-2] * b2 + h2[2:]
    h8 = h4[:-4] * b4 + h4[4:]
    return flat.mix(h8[:-2] * b2 + h2[8:])


def edit_budget(size):
    """Edits that a segment of this size may have."""
    return np.where(size < MIN_CHARS, 0, size // EDIT_SHARE)


def _is_word(code: np.ndarray) -> np.ndarray:
    """Which code points are letters or digits."""
    known, which = np.unique(code, return_inverse=True)
    return np.array([chr(c).isalnum() for c in known.tolist()], dtype=bool)[which]


def _power_sums(code: np.ndarray, m: int) -> np.ndarray:
    """Hash of each run of ``m`` code points, for small ``m``."""
    if len(code) < m:
        return np.zeros(0, np.uint64)
    n, values = len(code) - m + 1, code.astype(np.uint64) * flat.ODD
    total = np.zeros(n, dtype=np.uint64)
    for j in range(m):
        total = total * np.uint64(flat.BASE) + values[j : j + n]
    return flat.mix(total)


class Index:
    """q-grams of the segments of some items, and the hashes of whole short ones (unless ``short`` is false)."""

    def __init__(self, items: list[tuple[int | None, str]], short: bool = True):
        places: dict[bytes, set] = {}
        for item, text in items:
            normal = Normal([text]).code[GAP:-GAP]
            n = len(normal)
            if not n or n < MIN_CHARS and not short:
                continue
            starts = sorted({*range(0, max(1, n - SEGMENT + 1), SEGMENT // 2), max(0, n - SEGMENT)})
            for s in starts:
                places.setdefault(normal[s : s + SEGMENT].tobytes(), set()).add(item)
        self.segments = [np.frombuffer(b, dtype=np.uint32) for b in places]
        self.items = [sorted(i, key=lambda x: (x is None, x)) for i in places.values()]
        self.size = np.array([len(s) for s in self.segments], dtype=np.int64)
        self.edits = edit_budget(self.size)
        self.bound = self.size - Q + 1 - self.edits * Q
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by size: hashes and numbers of short items
        for m in np.unique(self.size[self.size < MIN_CHARS]).tolist():
            number = np.flatnonzero(self.size == m)
            keys = np.array([_power_sums(self.segments[i], m)[0] for i in number], dtype=np.uint64)
            order = np.argsort(keys, kind="stable")
            self.whole[m] = keys[order], number[order]
        none = np.zeros(0, np.uint64)
        hashes = [_grams(s) if len(s) >= MIN_CHARS else none for s in self.segments]
        number = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, int)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.number, self.place = number[order], place[order]
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def candidates(self, code: np.ndarray):
        """(segment, first diagonal of the band) of the bands that reach the bound."""
        found = []
        for lo in range(0, max(1, len(code) - Q + 1), PIECE):
            # A region reaches at most one segment and its edits beyond its first character.
            part = code[lo : lo + PIECE + 2 * SEGMENT]
            if len(part) < Q:
                continue
            grams = _grams(part)
            at = np.flatnonzero(self.filter[grams >> np.uint64(64 - FILTER_BITS)])
            key = flat.find(self.keys, grams[at])
            at, key = at[key >= 0], key[key >= 0]
            n = self.count[key]
            entry = np.repeat(self.first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            segment = self.number[entry]
            diagonal = np.repeat(at, n) - self.place[entry] + lo + SEGMENT
            step = self.edits[segment] + 1
            band, rest = np.divmod(diagonal, step)
            both = rest < step - 1  # also in the band before
            wide = len(code) + 2 * SEGMENT
            pairs = np.concatenate([segment * wide + band, segment[both] * wide + band[both] - 1])
            pair, hits = np.unique(pairs, return_counts=True)
            number, band = pair // wide, pair % wide
            ok = (hits >= self.bound[number]) & (band >= 0)
            found.append(np.stack([number[ok], band[ok] * (self.edits[number[ok]] + 1) - SEGMENT], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)

    def short_matches(self, code: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(segment, first place, place after the last, 0) of the short items in ``code``."""
        out = []
        if not self.whole:
            return out
        word = np.concatenate([[False], _is_word(code), [False]])
        for m, (keys, numbers) in self.whole.items():
            runs = _power_sums(code, m)
            # No word goes on over the edges of a run.
            at = np.flatnonzero(~(word[: len(runs)] & word[1 : len(runs) + 1]) & ~(word[m : m + len(runs)] & word[m + 1 : m + 1 + len(runs)]))
            known, first = np.unique(keys, return_index=True)
            key = flat.find(known, runs[at])
            for place, k in zip(at[key >= 0].tolist(), key[key >= 0].tolist()):
                alike = numbers[first[k] : np.searchsorted(keys, known[k], side="right")]
                out += [(int(i), place, place + m, 0) for i in alike if (self.segments[i] == code[place : place + m]).all()]
        return out

    def search(self, code: np.ndarray):
        """(segment, first place, place after the last, edits) of verified regions."""
        out = self.short_matches(code)
        number, first = self.candidates(code).T
        for m in np.unique(self.size[number]):
            of = np.flatnonzero(self.size[number] == m)
            for i in range(0, len(of), 4096):
                pick = of[i : i + 4096]
                rows = np.stack([self.segments[s] for s in number[pick]])
                start, end, edits = align(code, rows, first[pick], int(edit_budget(m)))
                ok = edits <= int(edit_budget(m))
                out += zip(number[pick][ok].tolist(), start[ok].tolist(), end[ok].tolist(), edits[ok].tolist())
        return out


def align(code: np.ndarray, rows: np.ndarray, first: np.ndarray, k: int):
    """Best alignment of each row whose diagonals stay within ``k`` of the band from ``first``.

    The row is used whole, the text from any place to any place.  Returns start, end and edits.
    """
    m, wide = rows.shape[1], 4 * k + 1
    column = np.arange(wide)
    base = first - k
    cost = np.zeros((len(rows), wide), dtype=np.int32)
    start = base[:, None] + column
    big = np.int32(1 << 20)
    for i in range(m):
        at = base[:, None] + i + column
        inside = (at >= 0) & (at < len(code))
        letter = np.where(inside, code[np.clip(at, 0, len(code) - 1)], np.uint32(0))
        best = cost + (letter != rows[:, i : i + 1])
        begun = start.copy()
        skip = np.concatenate([cost[:, 1:] + 1, np.full((len(rows), 1), big, np.int32)], 1)
        less = skip < best
        best = np.where(less, skip, best)
        begun = np.where(less, np.concatenate([start[:, 1:], start[:, -1:]], 1), begun)
        # Characters of the text without a partner: the cheapest column to the left, plus the distance.
        level = best - column
        run = np.minimum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == run, column, 0), axis=1)
        cost = (run + column).astype(np.int32)
        start = np.take_along_axis(begun, source, 1)
    end = cost.argmin(1)
    row = np.arange(len(rows))
    return np.maximum(start[row, end], 0), np.minimum(base + m + end, len(code)), cost[row, end]


def search_texts(index: Index, texts: list[str]) -> list[list[dict]]:
    """For each whole text: spans (code points) of each item, overlapping ones joined."""
    out: list[list[dict]] = [[] for _ in texts]
    if not texts or not index.segments:
        return out
    normal = Normal(texts)
    by: dict[tuple, list] = {}
    for segment, start, end, edits in index.search(normal.code):
        doc = int(normal.doc[start])
        span = int(normal.place[start]), int(normal.place[end - 1]) + 1, edits
        for item in index.items[segment]:
            by.setdefault((doc, item), []).append(span)
    for (doc, item), spans in sorted(by.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1])):
        joined: list[list[int]] = []
        for lo, hi, edits in sorted(spans):
            if joined and lo <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], hi)
                joined[-1][2] = min(joined[-1][2], edits)
            else:
                joined.append([lo, hi, edits])
        out[doc] += [{"item_id": item, "start": lo, "end": hi, "edits": e} for lo, hi, e in joined]
    return out


def _blocks(benchmark: DataFrame) -> list[list[tuple]]:
    """The benchmark in blocks of about ``BLOCK_CHARS`` characters."""
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_CHARS))
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def matches(docs: DataFrame, benchmark: DataFrame, short: bool = True) -> DataFrame:
    """``docs`` with ``matches``: the benchmark's passages in each whole text; ``short`` items only if wanted."""
    context = docs.sparkSession.sparkContext
    docs = spread(docs.drop("matches"))
    added = docs.sparkSession.createDataFrame([], f"matches {MATCH}").schema
    schema = StructType([*docs.schema.fields, *added.fields])
    kind = to_arrow_schema(schema).field("matches").type
    done = docs
    for n, items in enumerate(_blocks(benchmark)):
        shared = context.broadcast(Index(items, short))

        def run(batches, shared=shared, n=n):
            for batch in batches:
                found = search_texts(shared.value, [t or "" for t in batch.column("text").to_pylist()])
                if n:
                    found = [a + b for a, b in zip(batch.column("matches").to_pylist(), found)]
                columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "matches"]
                names = [name for name in batch.schema.names if name != "matches"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, type=kind)], names=[*names, "matches"])

        done = done.mapInArrow(run, schema)
    return done


def op9(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and passage found in it."""
    found = matches(documents.select("doc_id", "text"), benchmark).filter(F.size("matches") > 0)
    return found.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", "m.item_id", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"), "m.edits"
    )
