"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte
n-grams of lower-cased letters tells the languages coded 1 from those coded 0: naive Bayes,
each language of a side with the same weight, so that a frequent language does not drown the
others. A text's bits are decoded by loss: the codeword whose weighted loss is smallest wins,
a bit counting for a language by how often it was right on that language's own texts
(loss-weighted decoding). Where two codewords are about as near the text is flagged.

N-gram counts are taken over all training texts by Spark. The share of right bits and the
usual size of a margin come from a sample of at most about ``SAMPLE`` training texts of each
language, drawn by a row hash. The model holds ``BUCKETS`` x bits weights; there are about
10 log2(languages) bits, so 8,000 languages, more than there are, need 34 MB. This is all that
reaches the driver or is broadcast.

Defined results: a missing text, or one without a letter, is ``und`` with score 0. A row
without a language teaches nothing. With no language to learn all texts are ``und``; with one
every text with a letter has it, with score 1. Repeated rows count as often as they occur and
each gets a row. Two codewords at the same distance: the smaller language name. A missing
doc_id is not held out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import arrow_schema, keep, map_slices, record, slices

#: Sizes of the byte n-grams, and the hash buckets they share.
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
#: Added to every count.
PRIOR = 0.5
#: Languages up to which a codeword holds every way to part them.
EXHAUSTIVE = 5
#: Training texts of a language, about, that bits are judged on.
SAMPLE = 2000
#: Grams that count as undecided beside a text's own, so that short texts stay near the middle.
SHRINK = 20.0
#: The second language must be farther by this loss, about half a bit that is wrong.
CLEAR = 1.0

_WINDOW = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 1_000_000


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 for each language, far from all other rows.

    Few languages get every way to part them in two. For more, the best of 200 draws of
    balanced random columns, about 10 log2(languages) of them, with a fixed seed.
    """
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=languages - 1)]
        return np.array([c for c in columns if -1 in c], dtype=float).T
    rng, width = np.random.default_rng(languages), max(15, ceil(10 * log2(languages)))
    best, far = None, -1.0
    for _ in range(200 if languages <= 200 else 3):
        half = np.where(np.arange(languages) % 2 == 0, 1.0, -1.0)
        code = np.stack([rng.permutation(half) for _ in range(width)], axis=1)
        apart = (width - code @ code.T) / 2
        np.fill_diagonal(apart, width)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


def letters(text: Column) -> Column:
    """Lower-cased runs of letters and marks between single spaces; missing where no letter is."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))
    return F.when(text.rlike(r"\p{L}"), F.concat(F.lit(" "), words, F.lit(" ")))


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of several texts, a window at a time.

    With the buckets come the texts that have any there and where each one's begin.
    """
    data = [t.encode() for t in column.to_pylist()]
    ends = np.cumsum([len(t) for t in data], dtype=np.int64)
    begins = ends - [len(t) for t in data]
    raw = np.frombuffer(b"".join(data) + bytes(max(ORDERS)), dtype=np.uint8)
    for low in range(0, int(ends[-1]) if len(ends) else 0, _WINDOW):
        high = low + _WINDOW
        code = raw[low : high + max(ORDERS)].astype(np.uint64) + np.uint64(1)
        gram = code
        for k in range(2, max(ORDERS) + 1):
            gram = gram[:-1] | (code[k - 1 :] << np.uint64(9 * (k - 1)))
            if k not in ORDERS:
                continue
            bucket = (((gram ^ np.uint64(k << 56)) * _FACTOR) >> np.uint64(48)).astype(np.int64)
            first, last = np.clip(begins, low, high) - low, np.clip(ends - k + 1, low, high) - low
            some = np.flatnonzero(last > first)
            if not len(some):
                continue
            size = (last - first)[some]
            start = np.cumsum(size) - size
            yield bucket[np.arange(int(size.sum())) + np.repeat(first[some] - start, size)], some, start


def count_grams(labelled: DataFrame) -> DataFrame:
    """Language, bucket and count; bucket -1 counts the texts."""
    schema = arrow_schema(_COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                buckets = np.append(at, -1)
                cols = {"lang": [lang] * len(buckets), "bucket": buckets, "n": np.append(n[at], texts[lang])}
                yield record(cols, schema)
            held.clear()
            texts.clear()

        for batch in batches:
            for part in slices(batch):
                langs = part.column("lang").to_pylist()
                for lang in langs:
                    held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    texts[lang] = texts.get(lang, 0) + 1
                for bucket, some, start in grams(part.column("text")):
                    stop = np.append(start[1:], len(bucket))
                    of = [langs[i] for i in some.tolist()]
                    for lang in set(of):
                        taken = [bucket[b:e] for b, e, x in zip(start, stop, of, strict=True) if x == lang]
                        held[lang] += np.bincount(np.concatenate(taken), minlength=BUCKETS)
                if len(held) > 32:
                    yield from flush()
        yield from flush()

    rows = labelled.select("lang", "text").mapInArrow(count, _COUNTS)
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


_COUNTS = "lang string, bucket long, n long"
_WEIGHTS = "chunk long, weights binary"
_BITS = "lang int, bit int, n long, right long, size long"


@dataclass(frozen=True)
class Model:
    """Learned languages, their codewords and the classifiers of the bits."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        """For each text and bit the mean log odds of a gram, positive for 1."""
        total, n = np.zeros((len(column), self.code.shape[1])), np.zeros((len(column), 1))
        if self.code.shape[1]:
            for bucket, some, start in grams(column):
                for j, weights in enumerate(self.weights):
                    total[some, j] += np.add.reduceat(weights.take(bucket), start)
                n[some, 0] += np.diff(np.append(start, len(bucket)))
        return total / (n + SHRINK)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The weighted loss of each text and codeword."""
        bits = margins / self.scale
        out = np.zeros((len(bits), len(self.languages)))
        for j in range(self.code.shape[1]):
            wrong = np.logaddexp(0.0, -2.0 * np.outer(bits[:, j], self.code[:, j]))
            out += wrong * self.trust[:, j]
        return out


def learn(labelled: DataFrame) -> Model:
    """The model of rows with ``text`` (as ``letters`` gives it), ``lang`` and ``draw`` (a hash)."""
    spark = labelled.sparkSession
    counts = keep(count_grams(labelled), "language-grams")
    texts = F.sum(F.when(F.col("bucket") < 0, F.col("n")))
    found = counts.groupBy("lang").agg(texts.alias("texts"), (F.sum("n") - texts).alias("grams")).collect()
    found = sorted((r.lang, r.texts, r.grams) for r in found)
    languages = [f[0] for f in found]
    code = codewords(len(languages))
    width = code.shape[1]
    plain = Model(languages, code, np.zeros((width, BUCKETS)), np.ones(width), np.ones(code.shape))
    if width == 0:
        return plain
    place = {lang: i for i, lang in enumerate(languages)}
    total = np.array([f[2] for f in found], dtype=float) + PRIOR * BUCKETS
    side = (code > 0).astype(float)

    weights_schema = arrow_schema(_WEIGHTS)

    def weigh(key: tuple, rows: pa.Table) -> pa.Table:
        n = np.full((256, len(languages)), PRIOR)
        bucket = rows.column("bucket").to_numpy() & 255
        n[bucket, [place[lang] for lang in rows.column("lang").to_pylist()]] += rows.column("n").to_numpy()
        share = n / total
        odds = np.log(share @ (side / side.sum(0))) - np.log(share @ ((1 - side) / (1 - side).sum(0)))
        return pa.Table.from_batches([record({"chunk": [key[0].as_py()], "weights": [odds.tobytes()]}, weights_schema)])

    chunk = F.shiftrightunsigned("bucket", 8).alias("chunk")
    groups = counts.filter(F.col("bucket") >= 0).select("lang", "bucket", "n", chunk).groupBy("chunk")
    weights = np.zeros((BUCKETS >> 8, 256, width))
    # a chunk without any gram has even odds
    even = np.log(side.T @ (PRIOR / total) / side.sum(0)) - np.log((1 - side).T @ (PRIOR / total) / (1 - side).sum(0))
    weights[:] = even
    for row in groups.applyInArrow(weigh, _WEIGHTS).collect():
        weights[row.chunk] = np.frombuffer(bytes(row.weights)).reshape(256, width)
    weights = np.ascontiguousarray(weights.reshape(BUCKETS, width).T)
    plain = Model(languages, code, weights, plain.scale, plain.trust)

    sent = spark.sparkContext.broadcast(plain)

    def judge(part: pa.RecordBatch) -> dict:
        model = sent.value
        margins = model.margins(part.column("text"))
        own = np.array([place[lang] for lang in part.column("lang").to_pylist()])
        cols: dict[str, list] = {name: [] for name in ("lang", "bit", "n", "right", "size")}
        for i in np.unique(own).tolist():
            mine = margins[own == i]
            right = (mine * model.code[i] > 0).sum(0)
            size = np.rint(np.abs(mine) * _UNIT).astype(np.int64).sum(0)
            for j in range(width):
                for name, value in zip(cols, (i, j, len(mine), right[j], size[j]), strict=True):
                    cols[name].append(int(value))
        return cols

    part_of = spark.createDataFrame([(lang, min(1.0, SAMPLE / max(n, 1))) for lang, n, _ in found], "lang string, part double")
    drawn = labelled.join(F.broadcast(part_of), "lang").filter(F.col("draw") < F.col("part") * float(1 << 30))
    judged = map_slices(drawn.select("lang", "text"), judge, _BITS)
    sums = judged.groupBy("lang", "bit").agg(*[F.sum(c).alias(c) for c in ("n", "right", "size")]).collect()
    right, size = np.full(code.shape, 0.5), np.zeros(code.shape)
    for r in sums:
        right[r.lang, r.bit] = (r.right + 0.5) / (r.n + 1)
        size[r.lang, r.bit] = r["size"] / _UNIT / r.n
    scale = size.mean(0)
    trust = right * width / right.sum(1, keepdims=True)
    sent.unpersist()
    return Model(languages, code, plain.weights, np.where(scale > 0, scale, 1.0), trust)


_PREDICTED = (
    "doc_id long, held_out boolean, lang_pred string, score double, runner_up string, margin double, ambiguous boolean"
)


def predict(texts: DataFrame, model: Model) -> DataFrame:
    """Rows with ``doc_id``, ``held_out`` and ``text`` (as ``letters`` gives it) with their language."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> dict:
        model = sent.value
        n, names = part.num_rows, np.array([*model.languages, "und"], dtype=object)
        known = np.array(part.column("text").is_valid()) & (len(model.languages) > 0)
        best, second = np.full(n, len(names) - 1), np.full(n, len(names) - 1)
        score, margin = np.zeros(n), np.zeros(n)
        if known.any():
            loss = model.losses(model.margins(part.column("text").filter(pa.array(known))))
            order = np.argsort(loss, axis=1, kind="stable")
            near = np.take_along_axis(loss, order, axis=1)
            best[known] = order[:, 0]
            score[known] = 1.0 / np.exp(near[:, :1] - near).sum(1)
            if near.shape[1] > 1:
                second[known], margin[known] = order[:, 1], near[:, 1] - near[:, 0]
            else:
                margin[known] = np.inf
        return {
            "doc_id": part.column("doc_id"),
            "held_out": part.column("held_out"),
            "lang_pred": names[best],
            "score": score,
            "runner_up": names[second],
            "margin": margin,
            "ambiguous": margin < CLEAR,
        }

    return map_slices(texts, run, _PREDICTED)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every text, learned from the labelled rows that are not held out.

    Held out are rows whose crc32 of the id as text leaves 2 when divided by 4. ``score`` is
    the share of the nearest codeword among all, by the exponential of their losses;
    ``margin`` is the loss by which the next, ``runner_up``, is farther, and ``ambiguous``
    says that it is less than ``CLEAR``.
    """
    held_out = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out.alias("held_out"),
        letters(text).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 30)).alias("draw"),
    )
    wanted = ~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()
    model = learn(rows.filter(wanted).select("lang", "text", "draw"))
    return predict(rows.select("doc_id", "held_out", "text"), model)
