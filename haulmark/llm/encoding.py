"""Ids of a public byte-level tokenizer for many texts, as the library gives them.

The tokenizer splits a text before any space that a visible character follows, and where
letters begin or end; it never looks across such a split. The library encodes each distinct
chunk between them once; a worker keeps the ids in a hash table and looks later chunks up.
A text with any other kind of gap, or with the content of an added token, which the library
looks for before it splits, is encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from haulmark.llm.common import SPACED, Words

#: Chunks a worker keeps at most (about 50 MB); then those that came once leave.
CHUNKS = 700_000

#: Classes of bytes: 1 for ASCII letters; 2 and 3 for other ASCII but the space, 3 where letters after it may belong to it.
_CLASS = bytes(
    0 if b >= 128 or b == 32 else 1 if chr(b).isalpha() else 3 if b < 32 or b == 39 else 2 for b in range(256)
)
#: Bytes of white space, also those that characters of white space beyond ASCII begin with.
_MAY_SPACE = np.array([b <= 32 or b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)], np.int64)
#: Chunks that the library gets as one text; how its vocabulary writes a space.
JOINED = 64
SPACE = "\u0120"

_FIRST = np.uint64(0xA5A5F00DD00F5A5B)
_encoders: dict[str, Encoder] = {}


def letter_edges(raw: np.ndarray) -> np.ndarray:
    """Where ASCII letters end before, or begin after, other ASCII.

    After an apostrophe letters may belong to it, and white space is split by what follows
    it, so letters after these are not cut off.
    """
    kind = np.frombuffer(raw.tobytes().translate(_CLASS), np.uint8)
    pair = kind[:-1] << 2 | kind[1:]
    return np.flatnonzero((pair == 0b0110) | (pair == 0b0111) | (pair == 0b1001)) + 1


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; its lookup outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Lookup:
    """Numbers of 64-bit keys: open addressing, whole arrays at a time."""

    def __init__(self) -> None:
        self.keys, self.numbers, self.count = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32), 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; -1 where there is none."""
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        held = self.keys.take(slot)
        hit = held == keys
        out = np.where(hit, self.numbers.take(slot), np.int32(-1))
        todo = np.flatnonzero(~hit & (held != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            held = self.keys.take(slot)
            hit = held == keys[todo]
            out[todo[hit]] = self.numbers[slot[hit]]
            on = ~hit & (held != 0)
            todo, slot = todo[on], slot[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """New distinct keys get the next numbers."""
        numbers = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            old, held = self.keys, self.numbers
            size = 1 << int(4 * self.count - 1).bit_length()
            self.keys, self.numbers = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(old[old != 0], held[old != 0])
        self._put(keys, numbers)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        slot = keys & mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several keys the last one stays
            won = free & (self.keys[slot] == keys)
            self.numbers[slot[won]] = numbers[won]
            keys, numbers, slot = keys[~won], numbers[~won], (slot[~won] + np.uint64(1)) & mask


class Encoder:
    def __init__(self, path: str, chunks: int = CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.chunks = Tokenizer.from_file(path), chunks
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Tokens that begin with a space.
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known = Lookup()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        # of a chunk: its key, and whether it came again in later texts; one place at the end is of no chunk
        self.keys, self.again = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, bool)

    def thin(self) -> None:
        """Goes on with the chunks that came again, or begins anew if these are most."""
        kept = np.flatnonzero(self.again[: self.known.count])
        if 2 * len(kept) > self.chunks:
            kept = kept[:0]
        keys, size = self.keys[kept], self.size[kept]
        long = np.maximum(size, 0)
        ids = spread(self.flat, self.begin[kept], long)
        self.clear()
        self.hold(keys, ids, long, size)

    def hold(self, keys: np.ndarray, ids: np.ndarray, long: np.ndarray, size: np.ndarray) -> None:
        """Chunks with ``long`` of the ids each, and the size to be known of them."""
        n, total = self.known.count, len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + len(size) >= len(self.begin):
            self.begin, self.size, self.keys, self.again = (
                np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size, self.keys, self.again)
            )
        self.again[n:] = False
        self.flat[self.used : self.used + total] = ids
        self.begin[n : n + len(size)] = self.used + np.cumsum(long) - long
        self.size[n : n + len(size)] = size
        self.keys[n : n + len(size)] = keys
        self.known.add(keys)
        self.used += total

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def learn(self, keys: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> None:
        """Chunks of ``data``; one that is not ``first`` stands for itself with the space before it."""
        raw, long = np.frombuffer(data, np.uint8), end - start
        odd = np.add.reduceat(_MAY_SPACE[spread(raw, start, long)], np.cumsum(long) - long) > 0
        plain, other = np.flatnonzero(~(first | odd)), np.flatnonzero(first | odd)
        chunks = [data[b:e].decode() for b, e in zip(start[other].tolist(), end[other].tolist(), strict=True)]
        given = [c if f else " " + c for c, f in zip(chunks, first[other].tolist(), strict=True)]
        # visible characters with a space before them, some chunks in one text: each begins where a token begins with a space
        text = spread(raw, start[plain] - 1, long[plain] + 1).tobytes()
        cuts = [0, *np.cumsum(long[plain] + 1)[JOINED - 1 :: JOINED].tolist(), len(text)]
        given += [text[a:z].decode() for a, z in zip(cuts, cuts[1:], strict=False) if z > a]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(given, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        size = np.fromiter(map(len, found[: len(other)]), np.int32, len(other))
        begin = int(size.sum()) + np.flatnonzero(self.spaced[ids[int(size.sum()) :]])
        order = np.concatenate((other, plain))
        gap = np.zeros(len(order), bool)
        gap[: len(other)] = [c[0].isspace() for c in chunks]
        keys, first, size = keys[order], first[order], np.concatenate((size, np.diff(begin, append=len(ids)).astype(np.int32)))
        self.hold(keys, ids, size, np.where(gap & ~first, -1, size))

    def encode(self, texts: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by ``last``, and where each begins."""
        if self.known.count > self.chunks:
            self.thin()
        n = len(texts)
        words = Words(texts, SPACED, letter_edges)
        # the first chunk of a text, and one cut off from the chunk before, has no space before it
        first = np.zeros(len(words.hash), bool)
        first[np.searchsorted(words.start, words.cuts)] = True
        joined = np.bincount(words.doc_of()[first], minlength=n)
        first[words.docs[:-1][words.counts > 0]] = True
        keys = np.where(first, words.hash ^ _FIRST, words.hash) | np.uint64(1 << 63)
        at = self.known.get(keys)
        self.again[at] = True  # -1: the place of no chunk
        if (at < 0).any():
            new, where = np.unique(keys[at < 0], return_index=True)
            where = np.flatnonzero(at < 0)[where]
            self.learn(new, words.data, words.start[where], words.end[where], first[where])
            at[at < 0] = self.known.get(keys[at < 0])
        size = self.size[at].astype(np.int64)
        # spaces in a text beyond those between its chunks: it is encoded whole
        length = np.diff(words.bytes_from) - 1
        total = np.concatenate(([0], np.cumsum(words.end - words.start)))
        spaces = length - (total[words.docs[1:]] - total[words.docs[:-1]])
        odd = spaces != np.maximum(words.counts - joined - 1, 0)
        odd[words.doc_of()[size < 0]] = True
        for content in self.added:
            odd |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        size[size < 0] = 0
        ids = spread(self.flat, self.begin[at], size)
        upto = np.concatenate(([0], np.cumsum(size)))[words.docs]
        if odd.any() or last is not None:
            tail = [] if last is None else [np.array([last], np.uint32)]
            each = [
                [self.whole(texts[i].as_py()) if odd[i] else ids[upto[i] : upto[i + 1]], *tail] for i in range(n)
            ]
            upto = np.concatenate(([0], np.cumsum([sum(map(len, x)) for x in each], dtype=np.int64)))
            ids = np.concatenate([p for x in each for p in x]) if each else ids
        return ids, upto


def spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` that begin at ``begin``, one after another."""
    at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    return flat[at]
