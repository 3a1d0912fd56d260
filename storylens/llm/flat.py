"""Words and character n-grams of many texts at once, as numpy arrays over their code points.

A batch of texts becomes one array of code points with a separator after each text.  Words are runs of
word characters; a word is known by a 64-bit hash of its lower-case letters.  No Python code runs per word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
STEP = 1 << 16  # words hashed at once
EDGE = np.uint64(1)  # stands for the border of a word in n-grams


@lru_cache(maxsize=2)
def _tables(digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it part of a word, and its lower-case form."""
    word = np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha() or (digits and (s.isalnum() or s == "_")):
            word[c] = True
            small = s.lower()
            if len(small) == 1:
                lower[c] = ord(small)
    return word, lower


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash (uint64)."""
    h = (h ^ (h >> np.uint64(29))) * ODD
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a batch of texts.

    ``doc`` and ``hash`` have a value per word occurrence, in order of the texts; ``first`` and ``last``
    are the code point range of the word in the flat array.
    """

    def __init__(self, texts: list[str], digits: bool = False):
        is_word, lower = _tables(digits)
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.code = lower[code]
        inside = is_word[code]
        del code
        # Texts end with a separator, so a word ends before the array does.
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        self.first = np.flatnonzero(starts)
        self.last = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(ends, self.first, side="right")
        self.n_docs = len(texts)
        self.hash = np.zeros(len(self.first), dtype=np.uint64)
        for lo in range(0, len(self.first), STEP):  # some words at a time, to save memory
            part = slice(lo, lo + STEP)
            size = self.last[part] - self.first[part]
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(begin, size)
            values = self.code[np.repeat(self.first[part], size) + place].astype(np.uint64)
            values *= _powers(int(size.max()))[place]
            self.hash[part] = mix(np.add.reduceat(values, begin))

    def unique(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, an occurrence of each, and the number of each occurrence's hash."""
        return np.unique(self.hash, return_index=True, return_inverse=True)

    def grams(self, which: np.ndarray, orders: range):
        """For each order: (order, number of the word in ``which``, gram hash), borders included."""
        first, size = self.first[which], (self.last - self.first)[which] + 2
        if not len(which):
            return
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        owner = np.repeat(np.arange(len(which)), size)
        place = np.arange(len(owner)) - begin[owner]
        at = first[owner] - 1 + place
        border = (place == 0) | (place == size[owner] - 1)
        code = np.where(border, EDGE, self.code[np.where(border, 0, at)].astype(np.uint64))
        left = size[owner] - place  # characters from here to the end of the word
        rolled = np.zeros(len(code), dtype=np.uint64)
        powers = _powers(max(orders))
        wanted = set(orders)
        for n in range(1, min(max(orders), len(code)) + 1):
            rolled[: len(code) - n + 1] += code[n - 1 :] * powers[n - 1]
            if n in wanted:
                ok = ~border if n == 1 else left >= n
                yield n, owner[ok], mix(rolled[ok] ^ np.uint64(n << 56))


@lru_cache(maxsize=8)
def _power_table(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, BASE, dtype=np.uint64))))


def _powers(n: int) -> np.ndarray:
    return _power_table(1 << max(6, int(n - 1).bit_length()))


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in ``sorted_keys``, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
