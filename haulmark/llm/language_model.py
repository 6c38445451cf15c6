"""Scoring of texts by a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) * P(word | class). The most frequent words and the
end of a text are classes of their own, other words share a class by their ending. The
class is predicted by a softmax over hashed n-gram and skip features. All training texts
are counted by Spark; the weights are trained by gradient updates whose sums of observed and
expected class counts for each feature are gathered from all training texts in each round.

Within a class, and in the unigram baseline, a word counts with half an occurrence more. The
counts of the most frequent words are broadcast, a table of fixed size; all other words of a
text meet their counts in hash buckets, in sorted numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import HELD, LOWER, Tally, Words, arrow_schema, keep, map_slices, mix, record, slices, texts

ENDINGS = 32
SINGLES = 31
CLASSES = ENDINGS + SINGLES + 1
END = CLASSES - 1
#: Rows of the weight table, whatever the corpus.
FEATURES = 1 << 14
ORDERS = 4
ROUNDS = 2
STEP = 0.4
PRIOR = 2.0
#: Words whose counts every task holds.
FREQUENT = 1 << 15
BUCKET_WORDS = 200_000
LEAST_BUCKETS = 24
BATCH = 1 << 13
CHUNK = 1 << 8
#: Rows that one small matrix product adds up.
RUN = 16

_U = np.uint64
_END_HASH = _U(0x5851F42D4C957F2D)


class Tokens:
    """Words and end marks of several texts in one sequence.

    ``place`` is a token's place in its text, so that no context reaches into another one.
    """

    def __init__(self, column: pa.Array):
        words = Words(column, LOWER)
        n, docs = len(words.hash), words.docs
        doc = words.doc_of()
        at = np.arange(n) + doc
        total = n + len(words.counts)
        self.words = at
        self.hash = np.full(total, _END_HASH)
        self.hash[at] = words.hash
        self.doc = np.repeat(np.arange(len(words.counts)), words.counts + 1)
        self.counts = words.counts + 1
        self.place = np.arange(total) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        raw = np.frombuffer(words.data, np.uint8)
        last = words.end - 1
        mark = np.isin(raw[last], _MARKS) & (last > words.start)
        last = last - mark
        ending = raw[last].astype(_U) << _U(8) | np.where(last > words.start, raw[last - 1], 0).astype(_U)
        self.ending = np.full(total, END)
        self.ending[at] = (mix(ending) % _U(ENDINGS)).astype(np.int64)


_MARKS = np.frombuffer(b".,;:!?", np.uint8)


@dataclass
class Vocabulary:
    """Frequent words by hash, with counts and classes; totals of the corpus and of each class."""

    hashes: np.ndarray
    counts: np.ndarray
    single: np.ndarray
    ends: int
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray

    def find(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its place among the frequent words (-1: not there)."""
        at = np.full(len(t.hash), -1)
        kind = t.ending.copy()
        if len(self.hashes):
            near = np.minimum(np.searchsorted(self.hashes, t.hash[t.words]), len(self.hashes) - 1)
            hit = self.hashes[near] == t.hash[t.words]
            at[t.words[hit]] = near[hit]
            own = self.single[near[hit]]
            kind[t.words[hit]] = np.where(own >= 0, ENDINGS + own, kind[t.words[hit]])
        return kind, at


def features(t: Tokens, kind: np.ndarray) -> np.ndarray:
    """Rows of the weight table for each token: a word, two classes, and two skips."""

    def before(values: np.ndarray, k: int, start: int) -> np.ndarray:
        out = np.full(len(values), start, values.dtype)
        out[k:] = values[:-k] if k < len(values) else values[:0]
        out[t.place < k] = start
        return out

    c1, c2, c3 = (before(kind, k, END).astype(_U) for k in (1, 2, 3))
    w1, w2 = (before(t.hash, k, int(_END_HASH)) for k in (1, 2))
    codes = (w1, _U(1) + (c2 * _U(CLASSES) + c1), w2 * _U(3), _U(1 << 40) + (c3 * _U(CLASSES) + c2))
    return np.stack([(mix(c + _U(i << 56)) % _U(FEATURES)).astype(np.int32) for i, c in enumerate(codes)])


def scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores of the classes, one row a token, the largest of a row 0."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z += bias
    top = z
    while (n := top.shape[1]) > 1:
        half = np.maximum(top[:, : n // 2], top[:, n // 2 : n // 2 * 2])
        top = np.maximum(half, top[:, -1:]) if n % 2 else half
    z -= top
    return z


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes, one row a token."""
    z = scores(weights, bias, rows)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of the classes, one row a token."""
    p = scores(weights, bias, rows)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def add_rows(grid: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each of ``values`` to its row of the grid.

    Sorted by row, RUN values at a time are added up by a product with a matrix of zeros and
    ones; only rows that go on in the next run have several sums.
    """
    n = len(rows)
    order = np.argsort(rows.astype(np.int16) if len(grid) <= 1 << 15 else rows, kind="stable")
    own = rows[order]
    begins = np.ones(n, bool)
    np.not_equal(own[1:], own[:-1], out=begins[1:])
    new = begins.copy()
    new[::RUN] = True
    at = np.arange(n)
    lead = at - at % RUN
    part = np.cumsum(new)
    place = part - part[lead] + lead
    runs = -(-n // RUN)
    ones = np.zeros((runs, RUN, RUN), values.dtype)
    ones.reshape(-1)[place * RUN + at - lead] = 1
    sorted_ = np.zeros((runs * RUN, values.shape[1]), values.dtype)
    np.take(values, order, axis=0, out=sorted_[:n], mode="clip")
    sums = np.matmul(ones, sorted_.reshape(runs, RUN, -1)).reshape(sorted_.shape)
    grid[own[begins]] += sums[place[begins]]
    on = np.flatnonzero(new & ~begins)
    if len(on):
        first = np.flatnonzero(np.concatenate(([True], own[on][1:] != own[on][:-1])))
        grid[own[on][first]] += np.add.reduceat(sums[place[on]], first, axis=0)


# --- counting ----------------------------------------------------------------------------

COUNTED = "hash long, ending int, n long"


def count_words(rows: DataFrame) -> DataFrame:
    """Hash, ending and count of each distinct word of the training texts."""
    schema = arrow_schema(COUNTED)

    def out(keys: np.ndarray, ending: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return record({"hash": keys.view(np.int64), "ending": ending, "n": n}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for part in slices(batch):
                t = Tokens(part.column("text"))
                keys, first, n = np.unique(t.hash[t.words], return_index=True, return_counts=True)
                tally.add(keys, t.ending[t.words][first], n)
                if tally.held > HELD and (sums := tally.take()):
                    yield out(*sums)
        if sums := tally.take():
            yield out(*sums)

    train = rows.filter(~F.col("held_out")).select("text")
    return train.mapInArrow(run, COUNTED).groupBy("hash").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    hashes, ending, n = (top.column(c).to_numpy() for c in ("hash", "ending", "n"))
    single = np.full(len(n), -1)
    single[:SINGLES] = np.arange(min(SINGLES, len(n)))
    total = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    class_tokens, class_distinct = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    class_tokens[total.column("ending").to_numpy()] = total.column("n").to_numpy()
    class_distinct[total.column("ending").to_numpy()] = total.column("v").to_numpy()
    tokens, distinct = int(class_tokens.sum()) + ends, int(class_distinct.sum()) + (ends > 0)
    np.subtract.at(class_tokens, ending[:SINGLES], n[:SINGLES])
    np.subtract.at(class_distinct, ending[:SINGLES], 1)
    order = np.argsort(hashes.view(_U))
    return Vocabulary(
        hashes.view(_U)[order], n[order], single[order], ends, tokens, distinct, class_tokens, class_distinct
    )


# --- training ----------------------------------------------------------------------------

SUMS = "chunk int, sums binary"


def gather(rows: DataFrame, sums: DataFrame) -> np.ndarray:
    """The weight-sized table whose chunks the tasks summed, added up by chunk."""
    schema = arrow_schema(SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                part = np.frombuffer(data, np.float32).astype(np.float64)
                total[chunk] = total[chunk] + part if chunk in total else part
        if total:
            yield record({"chunk": list(total), "sums": [v.tobytes() for v in total.values()]}, schema)

    table = np.zeros((FEATURES, CLASSES))
    for row in sums.repartition("chunk").mapInArrow(run, SUMS).toLocalIterator():
        table[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.sums).reshape(CHUNK, CLASSES)
    return table


def class_counts(rows: DataFrame, held, weights=None) -> np.ndarray:
    """Observed class counts of each feature, or those that ``weights`` and bias expect."""
    schema = arrow_schema(SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, total = held.value, np.zeros(FEATURES * CLASSES)
        for batch in batches:
            for part in slices(batch):
                t = Tokens(part.column("text"))
                kind, _ = vocab.find(t)
                f = features(t, kind)
                if weights is None:
                    total += np.bincount((f * CLASSES + kind).ravel(), minlength=len(total))
                    continue
                w, bias = weights.value
                grid = np.zeros((FEATURES, CLASSES), np.float32)
                for b in range(0, f.shape[1], BATCH):
                    p = softmax(w, bias, f[:, b : b + BATCH])
                    for r in f[:, b : b + BATCH]:
                        add_rows(grid, r, p)
                total += grid.reshape(-1)
        if total.any():
            table = total.astype(np.float32).reshape(-1, CHUNK * CLASSES)
            some = np.flatnonzero(table.any(axis=1))
            yield record({"chunk": some, "sums": [table[i].tobytes() for i in some]}, schema)

    return gather(rows, rows.filter(~F.col("held_out")).select("text").mapInArrow(run, SUMS))


def train(rows: DataFrame, held) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ROUNDS updates over all training texts.

    An update adds STEP times the log ratio of observed and expected counts. The first
    round expects the class frequencies, which needs no pass over the texts.
    """
    context = rows.sparkSession.sparkContext
    observed = class_counts(rows, held)
    prior = (observed.sum(axis=0) / ORDERS + 0.5) / (observed.sum() / ORDERS + 0.5 * CLASSES)
    bias = np.log(prior).astype(np.float32)
    expected = observed.sum(axis=1, keepdims=True) * prior
    weights = np.zeros_like(observed, dtype=np.float32)
    for i in range(ROUNDS):
        if i:
            expected = class_counts(rows, held, context.broadcast((weights, bias)))
        weights = weights + (STEP * np.log((observed + PRIOR * prior) / (expected + PRIOR * prior))).astype(np.float32)
    return weights, bias


# --- scoring -----------------------------------------------------------------------------

REST = "bucket:int,keys:binary,hashes:binary,docs:binary,times:binary"
LOCAL = (
    "key array<bigint>, doc_id array<bigint>, held_out array<boolean>, n_tokens array<bigint>, known array<bigint>, "
    f"own array<double>, shared array<double>, classes array<double>, rest array<struct<{REST}>>"
)


def score_slices(rows: DataFrame, held, model, buckets: int) -> DataFrame:
    """Sums over the frequent words of each text, and its other words by bucket; one row a slice."""

    def score(part: pa.RecordBatch) -> dict:
        vocab, (weights, bias) = held.value, model.value
        t = Tokens(part.column("text"))
        kind, at = vocab.find(t)
        f = features(t, kind)
        n = part.num_rows
        logs = np.concatenate(
            [
                log_softmax(weights, bias, f[:, b : b + BATCH])[np.arange(len(k)), k]
                for b in range(0, len(kind), BATCH)
                for k in [kind[b : b + BATCH]]
            ]
        ).astype(np.float64) / np.log(10)
        # words of a class that share it: its size is the denominator
        within = kind < ENDINGS
        size = np.log10(vocab.class_tokens + 0.5 * (vocab.class_distinct + 1))
        logs[within] -= size[kind[within]]
        frequent = at >= 0
        value = np.zeros(len(kind))
        value[frequent] = np.log10(vocab.counts[at[frequent]] + 0.5)
        value[kind == END] = np.log10(vocab.ends + 0.5)
        known = frequent | (kind == END) & (vocab.ends > 0)
        other = ~frequent & (kind != END)
        key = part.column("key").to_numpy()
        return {
            **{c: [part.column(c)] for c in ("key", "doc_id", "held_out")},
            "n_tokens": [t.counts],
            "known": [np.bincount(t.doc, known, minlength=n).astype(np.int64)],
            "own": [np.bincount(t.doc[~within], value[~within], minlength=n)],
            "shared": [np.bincount(t.doc[within], value[within], minlength=n)],
            "classes": [np.bincount(t.doc, logs, minlength=n)],
            "rest": [rest(t.hash[other], t.doc[other], key, buckets)],
        }

    def rest(hashes: np.ndarray, doc: np.ndarray, key: np.ndarray, buckets: int) -> list[dict]:
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))[: len(hashes)]
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(hashes)))
        hashes, doc = hashes[first], doc[first]
        bucket = hashes.view(np.int64) % buckets
        out = []
        for b in np.unique(bucket).tolist():
            mine = bucket == b
            own, idx = np.unique(doc[mine], return_inverse=True)
            out.append(
                {
                    "bucket": b,
                    "keys": key[own].tobytes(),
                    "hashes": hashes[mine].tobytes(),
                    "docs": idx.astype(np.int32).tobytes(),
                    "times": times[mine].astype(np.int32).tobytes(),
                }
            )
        return out

    return map_slices(rows, score, LOCAL)


ADDED = "key long, known long, shared double"


def look_up(slices_: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """Known words and summed logs of the words that were not frequent, by text.

    A bucket's counts come first; the words of one slice after the other look them up.
    """
    none = F.lit(None)
    table = counts.select(
        F.pmod("hash", F.lit(buckets)).cast("int").alias("bucket"), "hash", "n",
        *(none.cast("binary").alias(c) for c in ("keys", "hashes", "docs", "times")),
    )
    asked = slices_.select(F.explode("rest").alias("r")).select(
        "r.bucket", none.cast("long").alias("hash"), none.cast("long").alias("n"),
        "r.keys", "r.hashes", "r.docs", "r.times",
    )
    dealt = table.union(asked).repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_last("hash"))
    schema = arrow_schema(ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = None, []
        hashes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for b in dict.fromkeys(batch.column("bucket").to_pylist()):
                own = batch.filter(pc.equal(batch.column("bucket"), b))
                if b != bucket:
                    bucket, parts = b, []
                is_count = own.column("hash").is_valid()
                given = own.filter(is_count)
                if given.num_rows:
                    parts.append((given.column("hash").to_numpy(), given.column("n").to_numpy()))
                words = own.filter(pc.invert(is_count))
                if not words.num_rows:
                    continue
                if parts is not None:
                    hashes = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
                    n = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
                    parts = None
                for row in words.select(["keys", "hashes", "docs", "times"]).to_pylist():
                    keys = np.frombuffer(row["keys"], np.int64)
                    h = np.frombuffer(row["hashes"], np.int64)
                    docs, times = (np.frombuffer(row[c], np.int32) for c in ("docs", "times"))
                    count = np.zeros(len(h), np.int64)
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                        count = np.where(hashes[at] == h, n[at], 0)
                    yield record(
                        {
                            "key": keys,
                            "known": np.bincount(docs, times * (count > 0), minlength=len(keys)).astype(np.int64),
                            "shared": np.bincount(docs, times * np.log10(count + 0.5), minlength=len(keys)),
                        },
                        schema,
                    )

    return dealt.mapInArrow(run, ADDED).groupBy("key").agg(F.sum("known").alias("more"), F.sum("shared").alias("added"))


def score(docs: DataFrame) -> DataFrame:
    """Base and model scores (log10 probabilities) of every text.

    Texts whose ``crc32(doc_id as text) mod 5`` is 1 are held out of all counts and updates;
    a missing id counts as an empty text there. A missing or empty text is its end mark
    alone. Without training texts every word is unknown. Rows that repeat id and text are
    trained on and scored as often as they come. Needs ``doc_id`` and ``text``; other
    columns are ignored.
    """
    held_out = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1).alias("held_out")
    rows = texts(docs, "doc_id", "text", F.monotonically_increasing_id().alias("key"), held_out)
    counts = keep(count_words(rows), "counts")
    vocab = vocabulary(counts, rows.filter(~F.col("held_out")).count())
    context = docs.sparkSession.sparkContext
    held = context.broadcast(vocab)
    model = context.broadcast(train(rows, held))
    buckets = max(LEAST_BUCKETS, -(-vocab.distinct // BUCKET_WORDS))
    # the keys number the rows of this one pass, so that equal rows stay apart
    read = keep(score_slices(rows, held, model, buckets), "slices")
    each = read.select(
        F.explode(F.arrays_zip("key", "doc_id", "held_out", "n_tokens", "known", "own", "shared", "classes")).alias("d")
    ).select("d.*")
    shared = F.col("shared") + F.coalesce("added", F.lit(0.0))
    base_size = float(np.log10(vocab.tokens + 0.5 * (vocab.distinct + 1)))
    return each.join(look_up(read, counts, buckets), "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("own") + shared - F.col("n_tokens") * base_size).alias("base_score"),
        (shared + F.col("classes")).alias("score"),
    )
