"""Alignment of the tokens of two tokenizers over the bytes of a text.

Tokenizer A is a byte-level one of ``tokenizers``, B one of ``sentencepiece``.  Both tell where their tokens lie: A by
character offsets, B by the byte spans of its proto (``return_type="proto"``; the installed release has it in place of
the immutable proto).  These are coarse cuts: the tokens of one multibyte character share its place, and so do byte
fallback tokens.  Between two coarse cuts the lengths of the decoded bytes of the tokens give the exact ends.  Byte
offsets where tokens of both end cut the text into groups; tokens that overlap are linked.

Texts are aligned unit by unit, cut where neither tokenizer can join what lies on both sides: before a lone space and
around a lone line end between two visible characters, and between a letter and a mark.  That holds for A by its
pattern, and for B if none of its pieces spans such a place, which is looked up in its vocabulary.  Equal units are
aligned once per task.  Texts with a unit that doesn't give back its bytes are aligned whole.

A linked pair of ids counts the documents that hold it.  Every document is stored with its distinct linked pairs and
their number of occurrences; counting them and looking the counts up are plain aggregations and joins.

Null and empty texts, and texts whose tokens don't spell a space and the text, have no tokens: zeros and an empty
``groups_sha256``.  A repeated row is one more document, null ids are kept, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import hot_join, spread, store

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Units and words a task remembers; it forgets them all beyond that.
REMEMBERED = 1_000_000
#: Characters of new units that are encoded in one call; the libraries take longer for each in long texts.
CALL_CHARS = 1500
#: Linked pairs of ids whose counts may be broadcast (about 50 bytes each); beyond that they are joined by shuffle.
BROADCAST_PAIRS = 2_000_000

VISIBLE = r"[!-~\w]"
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: Before a lone space, around a lone line end, and between a letter and a mark.
CUT = rf"(?<={VISIBLE})(?= {VISIBLE}|\n{VISIBLE})|(?<={VISIBLE}\n)(?={VISIBLE})|(?<={LETTER})(?=[!-&(-/:-@\[-`{{-~])"
INNER = re.compile(f" ?{VISIBLE}(?:.*{VISIBLE})?", re.DOTALL).fullmatch
WORD = re.compile(f"{VISIBLE}(?:.*{VISIBLE})?", re.DOTALL).fullmatch
#: In place of a number: texts with such a unit are aligned whole; words with white space at an end aren't cut off.
WHOLE, ALONE = -1, -2
#: Stands before units whose place isn't the begin of a text.
BEFORE = " a\n"
COLUMNS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in the entries of a byte-level vocabulary: visible ones stand for themselves."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def refined(coarse: np.ndarray, exact: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse end where it is exact, and decoded lengths from the last such cut on."""
    total = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(exact, np.arange(len(total)), -1))
    return total + np.where(last >= 0, coarse[last] - total[last], 0)


class Aligned:
    """Tokens of one text and how they overlap."""

    def __init__(self, a_ids, a_ends, b_ids, b_ends, n_b_ids: int):
        self.a_ids, self.b_ids = a_ids, b_ids
        # Between two neighbouring ends of any token there is one token of A and one of B: a link.
        self.link_ends = np.union1d(a_ends, b_ends)
        self.links = a_ids[np.searchsorted(a_ends, self.link_ends)] * n_b_ids
        self.links += b_ids[np.searchsorted(b_ends, self.link_ends)]
        # A group ends where tokens of both do.
        self.cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(self.cuts, a_ends), np.searchsorted(self.cuts, b_ends)
        self.a_last = (self.cuts[self.a_group] == a_ends).astype(int)
        self.b_last = (self.cuts[self.b_group] == b_ends).astype(int)

    def strings(self, a_text: np.ndarray, b_text: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Ids with the mark behind each, in order of groups; and how many of them the groups so far have."""
        texts = np.concatenate((a_text[self.a_ids, self.a_last], b_text[self.b_ids, self.b_last]))
        order = np.argsort(np.concatenate((2 * self.a_group, 2 * self.b_group + 1)), kind="stable")
        sizes = np.bincount(self.a_group, minlength=len(self.cuts)) + np.bincount(self.b_group, minlength=len(self.cuts))
        return texts[order].tolist(), np.concatenate(([0], np.cumsum(sizes)))


class Grown:
    """Rows of numbers that are added to."""

    def __init__(self, *width: int):
        self.data, self.size = np.zeros((1024, *width), dtype=np.int64), 0

    def add(self, rows: np.ndarray) -> None:
        if self.size + len(rows) > len(self.data):
            more = np.zeros((2 * (self.size + len(rows)), *self.data.shape[1:]), dtype=np.int64)
            more[: self.size] = self.data[: self.size]
            self.data = more
        self.data[self.size : self.size + len(rows)] = rows
        self.size += len(rows)


class Aligner:
    def __init__(self, name_a: str = VOCABULARY_A, name_b: str = VOCABULARY_B):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(name_a))
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(name_b))
        self.n_b_ids = self.b.get_piece_size()
        alphabet = byte_alphabet()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = entry.encode() if entry in special else bytes(map(alphabet.__getitem__, entry))
        self.b_bytes = [piece_bytes(self.b, i) for i in range(self.n_b_ids)]
        self.a_length = np.array(list(map(len, self.a_bytes)))
        self.b_length = np.array(list(map(len, self.b_bytes)))
        self.a_text = np.array([(f"{i},", f"{i}|") for i in range(len(self.a_bytes))], dtype=object)
        self.b_text = np.array([(f"{i},", f"{i};") for i in range(self.n_b_ids)], dtype=object)
        made = lambda i: not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))
        pieces = [self.b.id_to_piece(i) for i in filter(made, range(self.n_b_ids))]
        apart = not any(re.search(f"[^▁]▁|{LETTER}[^\\w▁]|\n", p) for p in pieces)
        self.split = re.compile(CUT).split if apart else None
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}  # what follows a space
        self.units: dict[str, int] = {}
        self.text: list[str] = []  # groups of each unit or word
        self.numbers = Grown(4)  # tokens of A and B, groups, links
        self.first = Grown()  # of the links of each of them
        self.links = Grown()

    def _add(self, numbers: list[np.ndarray], links: list[np.ndarray]) -> None:
        for n, of in zip(numbers, links):
            self.first.add(self.links.size + np.cumsum(n[:, 3]) - n[:, 3])
            self.numbers.add(n)
            self.links.add(of)

    def _links_of(self, which: np.ndarray) -> np.ndarray:
        size = self.numbers.data[which, 3]
        return self.links.data[np.arange(size.sum()) + np.repeat(self.first.data[which] - (np.cumsum(size) - size), size)]

    def _ends_a(self, spaced: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and byte ends; ``starts`` are the byte offsets of the characters and of the end."""
        code = self.a.encode(spaced, add_special_tokens=False)
        ids = np.array(code.ids)
        offsets = np.fromiter(chain.from_iterable(code.offsets), dtype=np.int64, count=2 * len(ids)).reshape(-1, 2)
        exact = np.append(offsets[1:, 0] >= offsets[:-1, 1], True)  # no other token begins in this character
        return ids, refined(starts[offsets[:, 1]], exact, self.a_length[ids])

    def _ends_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.b.encode(text, return_type="proto").pieces
        spans = np.array([(p.id, p.begin, p.end) for p in pieces], dtype=np.int64).reshape(-1, 3)
        ids, begin, end = spans.T
        # Spans of byte tokens are empty but for the last of a character; B puts a space before the text.
        return ids, refined(end + 1, end > begin, self.b_length[ids])

    def align(self, spaced: str) -> Aligned | None:
        """A space and a text, whole; None if the tokens don't spell them."""
        data = spaced.encode()
        code = np.frombuffer(data, dtype=np.uint8)
        starts = np.append(np.flatnonzero((code & 0xC0) != 0x80), len(code))
        a_ids, a_ends = self._ends_a(spaced, starts)
        b_ids, b_ends = self._ends_b(spaced[1:])
        spelt = lambda ids, table: b"".join(map(table.__getitem__, ids.tolist()))
        if spelt(a_ids, self.a_bytes) != data or spelt(b_ids, self.b_bytes) != data:
            return None
        if not (np.array_equal(a_ends, np.cumsum(self.a_length[a_ids]))
                and np.array_equal(b_ends, np.cumsum(self.b_length[b_ids]))):
            raise ValueError("spans and decoded bytes of a text disagree")
        return Aligned(a_ids, a_ends, b_ids, b_ends, self.n_b_ids)

    def _learn(self, units: list[str]) -> None:
        """Align units that begin and end with visible characters, some at a time as lines of one text."""
        lo = 0
        while lo < len(units):
            hi, size = lo, 0
            while hi < len(units) and (hi == lo or size + len(units[hi]) <= CALL_CHARS):
                size += len(units[hi])
                hi += 1
            part = units[lo:hi]
            sizes = [len(u.encode()) + 1 for u in part]
            ends = len(BEFORE) + np.cumsum(sizes) - 1
            if not self._keep(part, BEFORE + "\n".join(part), ends - np.array(sizes) + 1, ends):
                for unit in part:
                    self._learn_alone(unit)
            lo = hi

    def _learn_alone(self, unit: str) -> None:
        before = "" if unit[0] == " " else BEFORE
        behind = "a" if unit == "\n" else ""
        begin = len(before)
        text = before[:-1] + unit + behind if behind else before + unit
        begin -= len(behind)
        if not self._keep([unit], text, np.array([begin]), np.array([begin + len(unit.encode())])):
            self.units[unit] = WHOLE

    def _keep(self, units: list[str], text: str, begin: np.ndarray, end: np.ndarray) -> bool:
        """Remember what the units at these bytes of a text have; False if they can't be told from their neighbours."""
        found = self.align(text)
        if found is None or not (np.isin(end, found.cuts).all() and np.isin(begin[begin > 0], found.cuts).all()):
            return False
        upto = lambda ends, at: np.searchsorted(ends, at, side="right")
        lo, hi = upto(found.cuts, begin), upto(found.cuts, end)
        link_lo, link_hi = upto(found.link_ends, begin), upto(found.link_ends, end)
        a_upto, b_upto = np.cumsum(np.bincount(found.a_group)), np.cumsum(np.bincount(found.b_group))
        a_upto, b_upto = np.append(0, a_upto), np.append(0, b_upto)
        self._new.append(np.stack((a_upto[hi] - a_upto[lo], b_upto[hi] - b_upto[lo], hi - lo, link_hi - link_lo), 1))
        inside = np.zeros(len(found.links) + 1, dtype=np.int64)
        np.add.at(inside, link_lo, 1)
        np.add.at(inside, link_hi, -1)
        self._new_links.append(found.links[np.cumsum(inside[:-1]) > 0])
        strings, sizes = found.strings(self.a_text, self.b_text)
        for unit, i, j in zip(units, sizes[lo].tolist(), sizes[hi].tolist()):
            self.units[unit] = len(self.text)
            self.text.append("".join(strings[i:j]))
        return True

    def _learn_units(self, parted: list[list[str]]) -> None:
        known = self.units
        new = list({u for units in parted for u in units if u not in known})
        self._new, self._new_links = [], []
        # Others begin or end a text with white space, or are a line end.
        lines = list(filter(INNER, new))
        self._learn(lines)
        if len(lines) < len(new):
            for u in new:
                if u not in known:
                    self._learn_alone(u)
        self._add(self._new, self._new_links)

    def _learn_words(self, words: list[str]) -> None:
        """A word has what its units have together; one that its neighbours may join stays unknown."""
        words = [w for w in words if WORD(w) or self.words.setdefault(w, ALONE) != ALONE]
        parted = [self.split(" " + w) for w in words]
        self._learn_units(parted)
        get, several, at = self.units.__getitem__, [], []
        for w, units in zip(words, parted):
            if len(units) == 1:
                self.words[w] = get(units[0])
                continue
            which = list(map(get, units))
            if min(which) < 0:
                self.words[w] = WHOLE
                continue
            self.words[w] = len(self.text)
            self.text.append("".join(map(self.text.__getitem__, which)))
            several.append(len(which))
            at += which
        if several:
            at = np.array(at)
            numbers = np.add.reduceat(self.numbers.data[at], np.cumsum([0, *several[:-1]]))
            self._add([numbers], [self._links_of(at)])

    def _indexes(self, texts: list[str]) -> list[np.ndarray]:
        """Where the words or units of each text are; a text with a number below zero is aligned whole."""
        if len(self.text) > REMEMBERED:
            self._forget()
        parted = [t.split(" ") if t else [] for t in texts]
        known = self.words
        self._learn_words(list({w for words in parted for w in words if w not in known}))
        get = known.__getitem__
        at = [np.fromiter(map(get, words), dtype=np.int64, count=len(words)) for words in parted]
        apart = [i for i, of in enumerate(at) if len(of) and of.min() == ALONE]
        units = [self.split(" " + texts[i]) for i in apart]
        self._learn_units(units)
        get = self.units.__getitem__
        for i, of in zip(apart, units):
            at[i] = np.fromiter(map(get, of), dtype=np.int64, count=len(of))
        return at

    def __call__(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, distinct links, how often each) of whole texts."""
        if self.split is None:
            return [self._whole(" " + t) for t in texts]
        out = []
        for text, units in zip(texts, self._indexes(texts)):
            if not len(units) or units.min() < 0:
                out.append(self._whole(" " + text))
                continue
            which, times = np.unique(units, return_counts=True)
            pairs, n = _summed(self._links_of(which), np.repeat(times, self.numbers.data[which, 3]))
            groups = "".join(map(self.text.__getitem__, units.tolist()))[:-1]
            sha = hashlib.sha256(groups.encode()).hexdigest()
            out.append((*(times @ self.numbers.data[which]).tolist(), sha, pairs, n))
        return out

    def _whole(self, spaced: str) -> tuple:
        found = self.align(spaced) if len(spaced) > 1 else None
        if found is None:
            return (0, 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        text = "".join(found.strings(self.a_text, self.b_text)[0])[:-1]
        numbers = len(found.a_ids), len(found.b_ids), len(found.cuts), len(found.links)
        return (*numbers, hashlib.sha256(text.encode()).hexdigest(), *np.unique(found.links, return_counts=True))


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=int)
    return keys[first], np.add.reduceat(weights[order], first) if len(keys) else weights


@lru_cache(maxsize=2)
def _aligner(name_a: str, name_b: str) -> Aligner:
    return Aligner(name_a, name_b)


@lru_cache(maxsize=2)
def _link_type(name_a: str, name_b: str) -> str:
    """Type of a number for any pair of ids, and the number of ids of B."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    n_a = Tokenizer.from_file(public_tokenizers.path(name_a)).get_vocab_size(with_added_tokens=True)
    n_b = SentencePieceProcessor(model_file=public_tokenizers.path(name_b)).get_piece_size()
    return ("int" if n_a * n_b < 1 << 31 else "bigint"), n_b


def aligned(docs: DataFrame, name_a: str = VOCABULARY_A, name_b: str = VOCABULARY_B) -> DataFrame:
    """``docs`` with the columns of ``COLUMNS``, ``uid`` and ``links`` (pair, n) in place of ``text``."""
    kind, _ = _link_type(name_a, name_b)
    kept = [c for c in docs.columns if c not in {"text", "links", "uid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"}]
    fields = docs.sparkSession.createDataFrame([], f"{COLUMNS}, links array<struct<pair:{kind},n:int>>").schema
    schema = StructType([*docs.select(*kept).schema.fields, *fields.fields])
    types = to_arrow_schema(fields)
    pair = types.field("links").type.value_type

    def run(batches):
        align = _aligner(name_a, name_b)
        for batch in batches:
            rows = align(batch.column("text").to_pylist())
            *plain, pairs, n = zip(*rows) if rows else ([],) * 7
            size = np.cumsum([0, *map(len, pairs)])
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(v) if len(v) else [], type=f.type) for v, f in zip((pairs, n), pair)],
                fields=list(pair),
            )
            links = pa.ListArray.from_arrays(pa.array(size, pa.int32()), flat).cast(types.field("links").type)
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(v, type=t) for v, t in zip(plain, types.types)]
            yield pa.RecordBatch.from_arrays([*arrays, links], names=[*kept, *types.names])

    texts = spread(docs.select(*kept, F.coalesce("text", F.lit("")).alias("text")))
    return texts.mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id())


def pair_counts(found: DataFrame, name_a: str = VOCABULARY_A, name_b: str = VOCABULARY_B) -> DataFrame:
    """``pair, a_id, b_id, n_docs, best`` of every linked pair; ``best`` if no other of its A id counts more."""
    _, n_b = _link_type(name_a, name_b)
    pairs = found.select(F.explode("links.pair").alias("pair"))
    counts = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")).select(
        "pair", F.floor(F.col("pair") / n_b).cast("int").alias("a_id"), (F.col("pair") % n_b).cast("int").alias("b_id"),
        "n_docs",
    )
    counts = store(counts, "pair-counts")
    # A token of A meets at most as many tokens as B has, so the maxima are as few as A has ids.
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(
    docs: DataFrame, name_a: str = VOCABULARY_A, name_b: str = VOCABULARY_B, broadcast_pairs: int = BROADCAST_PAIRS
) -> tuple[DataFrame, DataFrame]:
    """Documents with their numbers of tokens, groups and links, and the counted pairs of ids of the corpus."""
    found = store(aligned(docs, name_a, name_b), "aligned")
    counts = store(pair_counts(found, name_a, name_b), "pairs")
    each = found.select("uid", F.inline("links"))
    dim = counts.select("pair", "n_docs", "best")
    joined = each.join(F.broadcast(dim), "pair") if counts.count() <= broadcast_pairs else hot_join(each, dim, "pair")
    sums = joined.groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("n") * F.col("n_docs")).cast("long").alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    out = found.drop("links").join(sums, "uid", "left").drop("uid")
    return out.withColumn("n_best", F.coalesce("n_best", zero)).withColumn("count_sum", F.coalesce("count_sum", zero)), counts


def op11(documents: DataFrame) -> DataFrame:
    docs, _ = align(documents.select("doc_id", "text"))
    return docs.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
