"""Perplexity by a modified Kneser-Ney model of word trigrams, each text judged without its own words.

A word is itself if it is among the most frequent of the corpus, else the rare words of its
unit and language. Every trigram of every text is sent to the bucket of its context, as a sorted
64-bit code with the text's number, so a bucket holds all trigrams (u, v, w) of its middle
words v: the counts of trigrams after (u, v), and the distinct u before (v, w), from which the
bigrams are made. There each text is scored on what the other texts hold, and only its sum of
logarithms leaves. A middle word with more occurrences than two buckets hold is a
context of its own in each range of words before it. Discounts are those of the bucket;
below the bigrams stand the words' shares of their language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import AS_WRITTEN, HELD, Tally, Words, arrow_schema, mix, record, slices
from haulmark.llm.word_units import UNITS, Places, discounts, units, word_keys

CLASS_BITS = 18
CLASSES = 1 << CLASS_BITS
#: Classes up to here are words, the others units of a language (of several beyond a thousand).
MOST_WORDS = 1 << 17
SLOTS = (CLASSES - MOST_WORDS) // UNITS
TEXT_BITS = 64 - 3 * CLASS_BITS
#: The last word and the text of a code; whole bytes of the difference of two contexts.
REST_BITS = CLASS_BITS + TEXT_BITS
STEP_BYTES = 5
#: Trigrams that a bucket holds, about, and buckets at least.
BUCKET_TRIGRAMS = 1 << 22
LEAST_BUCKETS = 24

MESSAGE = "bucket int, slice long, n int, codes binary"
REPLY = "slice long, contents binary, texts binary, logs binary"
SUMS = "content long, logs double, n long"
_U = np.uint64
_CLASS = _U(CLASSES - 1)
_codec = pa.Codec("zstd", compression_level=1)


@dataclass
class Vocabulary:
    """Classes of words, their shares of their language, and the first context of each bucket but one."""

    groups: np.ndarray
    places: Places
    ids: np.ndarray
    share: np.ndarray
    bounds: np.ndarray

    def __init__(self, groups: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, counts: np.ndarray, of: np.ndarray):
        """``sizes`` are the words of each unit of each language, ``of`` the flat place in it of each frequent word."""
        rest = (sizes.ravel() - np.bincount(of, counts, minlength=sizes.size)).astype(np.int64)
        slot = np.arange(len(groups)) % SLOTS
        total = np.bincount(slot, sizes.sum(axis=1), minlength=SLOTS)
        n = np.zeros(CLASSES, np.int64)
        rank = np.argsort(-counts, kind="stable")
        self.groups, self.places, self.ids = groups, Places(hashes), np.zeros(len(hashes) + 1, np.int64)
        self.ids[rank] = np.arange(len(rank))
        n[: len(rank)] = counts[rank]
        np.add.at(n, MOST_WORDS + np.repeat(slot, UNITS) * UNITS + np.tile(np.arange(UNITS), len(groups)), rest)
        whole = np.ones(CLASSES)
        whole[: len(rank)] = total[slot[of[rank] // UNITS]]
        whole[MOST_WORDS : MOST_WORDS + SLOTS * UNITS] = np.repeat(np.maximum(total, 1), UNITS)
        self.share = n / whole
        self.bounds = bounds(n)

    def classes(self, keys: np.ndarray, row: np.ndarray, unit: np.ndarray) -> np.ndarray:
        rare = MOST_WORDS + row % SLOTS * UNITS + unit
        at, known = self.places.get(keys)
        return np.where(known, self.ids.take(at), rare).astype(_U)


def bounds(n: np.ndarray) -> np.ndarray:
    """First contexts (middle word, word before) of the buckets after the first, from the counts of classes."""
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_TRIGRAMS))
    if not total:
        return np.zeros(0, _U)
    goal = total * (np.arange(1, buckets) / buckets)
    middle = np.searchsorted(upto, goal, side="right")
    part = (goal - (upto[middle] - n[middle])) / n[middle]
    before = np.searchsorted(upto, part * total, side="right")
    split = n[middle] > 2 * max(BUCKET_TRIGRAMS, total / buckets)
    return np.unique(middle << CLASS_BITS | np.where(split, before, 0)).astype(_U)


def pack(codes: np.ndarray) -> bytes:
    """Sorted codes byte by byte: contexts as differences, what follows them as it is."""
    steps = np.diff(codes >> _U(REST_BITS), prepend=_U(0)).view(np.uint8).reshape(-1, 8)
    rest = (codes & _U((1 << REST_BITS) - 1)).astype(np.uint32).view(np.uint8).reshape(-1, 4)
    return _codec.compress(np.concatenate((steps.T[:STEP_BYTES], rest.T)).tobytes(), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_codec.decompress(data, (STEP_BYTES + 4) * n, asbytes=True), np.uint8).reshape(-1, n)
    steps, rest = np.zeros((n, 8), np.uint8), np.empty((n, 4), np.uint8)
    steps[:, :STEP_BYTES], rest[:] = planes[:STEP_BYTES].T, planes[STEP_BYTES:].T
    return np.cumsum(steps.view(_U).ravel(), dtype=_U) << _U(REST_BITS) | rest.view(np.uint32).ravel()


def codes_of(classes: np.ndarray, words: Words) -> np.ndarray:
    """The trigrams of each text, sorted by middle word, word before, last word and text."""
    at = np.flatnonzero(np.arange(len(classes)) + 3 <= np.repeat(words.docs[1:], words.counts))
    u, v, w = (classes[at + i] for i in range(3))
    code = ((v << _U(CLASS_BITS) | u) << _U(CLASS_BITS) | w) << _U(TEXT_BITS)
    return np.sort(code | words.doc_of()[at].astype(_U))


def messages(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All trigrams by bucket; and, with no codes, the texts of each slice and their numbers of trigrams."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = arrow_schema(MESSAGE)

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        known = held.value
        content, group = (part.column(c).to_numpy() for c in ("content", "group"))
        words = Words(part.column("text"), AS_WRITTEN)
        row = np.searchsorted(known.groups, group)[words.doc_of()]
        codes = codes_of(known.classes(word_keys(words, group), row, units(words)), words)
        name = int(mix(np.array([mix(content.view(_U) + np.arange(len(content), dtype=_U)).sum()]))[0].view(np.int64))
        cuts = [0, *np.searchsorted(codes, known.bounds << _U(CLASS_BITS + TEXT_BITS)).tolist(), len(codes)]
        rows = [(b, z - a, pack(codes[a:z])) for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)) if z > a]
        rows.append((name % (len(known.bounds) + 1), 0, np.concatenate((content, np.maximum(words.counts - 2, 0))).tobytes()))
        bucket, n, data = zip(*rows, strict=True)
        return record({"bucket": bucket, "slice": [name] * len(rows), "n": n, "codes": data}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for i in range(0, part.num_rows, 1 << TEXT_BITS):
                    yield of(part.slice(i, 1 << TEXT_BITS))

    return docs.mapInArrow(run, MESSAGE)


# --- a bucket ----------------------------------------------------------------------------


class Bucket:
    """Counts of all trigrams of a bucket's contexts, and of the distinct ones for bigrams."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.codes, self.n = codes, n
        self.off3 = discounts(n)
        self.context = numbered(codes >> _U(CLASS_BITS))
        self.total3 = np.bincount(self.context, n)
        self.mass3 = np.bincount(self.context, self.off3[np.minimum(n, 3)])
        pair = (codes >> _U(2 * CLASS_BITS)) << _U(CLASS_BITS) | codes & _CLASS
        order = np.argsort(pair)
        pair = pair[order]
        number = numbered(pair)
        self.pair = np.empty(len(codes), np.int32)
        self.pair[order] = number
        self.left = np.bincount(number)
        first = np.flatnonzero(np.diff(number, prepend=np.int32(-1)))
        self.off2 = discounts(self.left)
        self.middle = numbered(pair[first] >> _U(CLASS_BITS))
        self.total2 = np.bincount(self.middle, self.left)
        self.mass2 = np.bincount(self.middle, self.off2[np.minimum(self.left, 3)])

    def probability(self, code: np.ndarray, text: np.ndarray, times: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Of trigrams that texts hold ``times`` times, each by what other texts hold."""

        def less(of: np.ndarray, own: np.ndarray) -> np.ndarray:
            return np.bincount(of, own)[of]

        def off(table: np.ndarray, n: np.ndarray) -> np.ndarray:
            return table[np.minimum(n, 3)]

        at = np.searchsorted(self.codes, code)
        n, context, pair = self.n[at], self.context[at], self.pair[at]
        middle, others = self.middle[pair], n - times
        alone = others == 0
        # contexts are numbered by middle word, so one order serves both
        keyed = text << 32
        by_context, by_middle = grouped(keyed | context, keyed | middle)
        (by_pair,) = grouped(keyed | pair)
        # bigrams: words before that no other text has there leave the count
        before = self.left[pair]
        left = before - less(by_pair, alone).astype(np.int64)
        place = np.arange(len(code))
        one = np.empty(int(by_pair.max(initial=-1)) + 1, np.int64)
        one[by_pair] = place
        once = one[by_pair] == place
        total = self.total2[middle] - less(by_middle, alone)
        mass = self.mass2[middle] - less(by_middle, np.where(once, off(self.off2, before) - off(self.off2, left), 0.0))
        low = share[(code & _CLASS).astype(np.int64)]
        with np.errstate(divide="ignore", invalid="ignore"):
            low = np.where(total > 0, (left - off(self.off2, left) + mass * low) / total, low)
            total = self.total3[context] - less(by_context, times)
            mass = self.mass3[context] - less(by_context, off(self.off3, n) - off(self.off3, others))
            return np.where(total > 0, (others - off(self.off3, others) + mass * low) / total, low)


def numbered(keys: np.ndarray) -> np.ndarray:
    """Numbers of the distinct ones of sorted keys."""
    new = np.zeros(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.cumsum(new, dtype=np.int32)


def grouped(keys: np.ndarray, *coarser: np.ndarray) -> list[np.ndarray]:
    """Numbers of equal keys, and of equal coarser ones, which the order of the keys sorts as well."""
    order = np.argsort(keys)
    out = []
    for some in (keys, *coarser):
        number = np.empty(len(keys), np.int32)
        number[order] = numbered(some[order])
        out.append(number)
    return out


def chunks(parts: list[tuple[int, int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Messages by about as many as a task holds codes of at once."""
    own, size = [], 0
    for part in parts:
        own.append(part)
        size += part[1]
        if size > HELD // 4:
            yield own
            own, size = [], 0
    if own:
        yield own


def scored(parts: list[tuple[int, int, bytes]], share: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What each text of a bucket's messages (slice, number of codes, codes) has there in logarithms."""
    tally = Tally()
    for some in chunks(parts):
        codes = np.sort(np.concatenate([unpack(data, n) for _, n, data in some]) >> _U(TEXT_BITS))
        new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        tally.add(codes[new], np.zeros(len(new), np.int8), np.diff(np.append(new, len(codes))))
    codes, _, n = tally.take()
    bucket = Bucket(codes, n)
    for some in chunks(parts):
        sizes = [x[1] for x in some]
        own = np.concatenate([unpack(data, n) for _, n, data in some])
        which = np.repeat(np.arange(len(some)), sizes)
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (which[1:] != which[:-1]))))
        times = np.diff(np.append(new, len(own)))
        own, which = own[new], which[new]
        text = which << TEXT_BITS | (own & _U((1 << TEXT_BITS) - 1)).astype(np.int64)
        logs = np.log(bucket.probability(own >> _U(TEXT_BITS), text, times, share))
        texts, where = np.unique(text, return_inverse=True)
        total = np.bincount(where, logs * times)
        cuts = np.searchsorted(texts, np.arange(len(some) + 1) << TEXT_BITS).tolist()
        inside = (texts & ((1 << TEXT_BITS) - 1)).astype(np.uint16)
        spans = [slice(a, z) for a, z in zip(cuts, cuts[1:], strict=False)]
        cols = {
            "slice": [x[0] for x in some],
            "contents": pa.nulls(len(some), pa.binary()),
            "texts": [inside[x].tobytes() for x in spans],
            "logs": [total[x].tobytes() for x in spans],
        }
        yield record(cols, schema)


class Sums:
    """Logarithms of the texts of one slice, from the replies of all buckets."""

    def __init__(self) -> None:
        self.logs, self.n = np.zeros(1 << TEXT_BITS), np.zeros(1 << TEXT_BITS, np.int64)
        self.content = np.zeros(0, np.int64)

    def add(self, contents: bytes | None, texts: bytes, logs: bytes) -> None:
        if contents is None:
            self.logs[np.frombuffer(texts, np.uint16)] += np.frombuffer(logs)
            return
        # slices of equal texts have one name: their sums and numbers both double
        self.content, n = np.frombuffer(contents, np.int64).reshape(2, -1)
        self.n[: len(n)] += n

    def columns(self) -> dict:
        size = len(self.content)
        return {"content": self.content, "logs": self.logs[:size], "n": self.n[:size]}


def word_perplexity(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``content`` and ``word_log_ppl`` of the texts with three words; needs ``content``, ``text`` and ``group``.

    ``content`` is a hash of text and language: rows with equal ones have equal results, in one row.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary.share)
    schema = arrow_schema(REPLY)
    sent = messages(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        for batch in batches:
            for b, name, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and parts:
                    yield from scored(parts, held.value, schema)
                    parts = []
                bucket = b
                if n:
                    parts.append((name, n, data))
                    continue
                yield record({"slice": [name], "contents": [data], "texts": [None], "logs": [None]}, schema)
        if parts:
            yield from scored(parts, held.value, schema)
        pa.default_memory_pool().release_unused()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, Sums()
        for batch in batches:
            for name, *reply in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if now is not None:
                        yield record(sums.columns(), total)
                    now, sums = name, Sums()
                sums.add(*reply)
        if now is not None:
            yield record(sums.columns(), total)

    total = arrow_schema(SUMS)
    replies = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, REPLY)
    by_text = replies.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, SUMS)
    sums = by_text.groupBy("content").agg(F.sum("logs").alias("logs"), F.sum("n").alias("n"))
    return sums.filter("n > 0").select("content", (-F.col("logs") / F.col("n")).alias("word_log_ppl"))
