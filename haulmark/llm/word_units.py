"""Units and keys of words, and the discounts of counts, for the models of ``quality``."""

from __future__ import annotations

import numpy as np

from haulmark.llm.common import Words, mix

BITS = 7
#: Units of the model: 96 buckets of short words and 32 shapes; trigrams of a language are 2**21 at most.
UNITS = 1 << BITS
SHORT_BUCKETS = UNITS - 32
SHORT_BYTES = 5
_U = np.uint64
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>")).astype(np.int64)
_DIGIT = np.isin(np.arange(256), list(b"0123456789")).astype(np.int64)
_UPPER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")).astype(np.int64)
_PLAIN = (np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz")) | (np.arange(256) >= 128)).astype(np.int64)
_MARK = np.isin(np.arange(256), list(b"!?;:=_/@+~^\\{}[]()\"'`")).astype(np.int64)
LEAD = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64)


_HALF = (1 << 32) - 1
#: Two tables side by side, so that one running sum serves both: texts are shorter than 2**32 bytes.
_LETTERS, _SIGNS = _PLAIN | _UPPER << 32, SYMBOL | _MARK | _DIGIT << 32


def running(words: Words, table: np.ndarray) -> np.ndarray:
    """Sums of a table over the bytes before each place."""
    total = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(table.take(np.frombuffer(words.data, np.uint8)), out=total[1:])
    return total


def per_word(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of both halves of a table over each word's bytes."""
    total = running(words, table)
    both = total.take(words.end) - total.take(words.start)
    return both & _HALF, both >> 32


def units(words: Words) -> np.ndarray:
    size = words.end - words.start
    plain, upper = per_word(words, _LETTERS)
    odd, digits = per_word(words, _SIGNS)
    loud = (upper > 1) & (upper * 2 > size)
    last = np.frombuffer(words.data, np.uint8)[words.end - 1] if len(size) else size
    closed = (last == 46) | (last == 44)
    shape = (odd > 0) + 2 * (digits > 0) + 4 * loud + 8 * (size > 8) + 16 * closed
    short = (plain == size) & (size <= SHORT_BYTES)
    return np.where(short, 32 + (words.hash % _U(SHORT_BUCKETS)).astype(np.int64), shape)


def word_keys(words: Words, group: np.ndarray) -> np.ndarray:
    """Hashes of the words, other ones in each language."""
    return mix(words.hash ^ mix(group.astype(np.int64).view(_U))[words.doc_of()])


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more."""
    n = [int((counts == i).sum()) for i in range(1, 5)]
    if not n[0] or not n[1]:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0, 1 - 2 * y * n[1] / n[0]]
    d.append(2 - 3 * y * n[2] / n[1])
    d.append(3 - 4 * y * n[3] / n[2] if n[2] else 3.0)
    return np.clip(np.array(d), [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])


class Places:
    """Where hashes stand in a sorted table, found by their leading bits."""

    def __init__(self, hashes: np.ndarray):
        bits = max(1, len(hashes).bit_length())
        self.shift = _U(64 - bits)
        self.hashes = np.append(hashes, ~_U(0))
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=_U) << self.shift).astype(np.int32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there."""
        at = self.first.take((keys >> self.shift).astype(np.int64)).astype(np.int64)
        below = np.flatnonzero(self.hashes.take(at) < keys)
        while len(below):
            at[below] += 1
            below = below[self.hashes.take(at.take(below)) < keys.take(below)]
        return at, (self.hashes.take(at) == keys) & (at < len(self.hashes) - 1)
