"""Quality rules: surface counts and perplexities, by a class n-gram model of each language and by word trigrams.

P(word | context) = P(unit | two units before) * P(word | unit). A word's unit is its hash if
it is short and plain, else its shape (case, digits, symbols, length, closing punctuation).
Spark counts all trigrams of units, and all words, of the whole corpus, for each language
however many there are. From the trigrams a modified Kneser-Ney model is built and kept as
sorted arrays of n-gram codes; a word within its unit has a discounted share of all words
there, and a text's own words are taken out of the counts that it is judged by. The order of
words is judged by ``word_trigrams``. Documents outside their language's band of log perplexity,
on either side, and those above that of word trigrams are rejected.

Models are files in the shared folder, which tasks read for the languages that they meet. The
counts of the most frequent words are broadcast; all others are looked up in hash buckets.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import (
    AS_WRITTEN,
    HELD,
    Tally,
    Words,
    arrow_schema,
    keep,
    keep_lean,
    map_slices,
    mix,
    new_folder,
    record,
    row_key,
    runs,
    slices,
    texts,
)
from haulmark.llm.decontaminate import bloom, may_hold
from haulmark.llm.word_trigrams import Vocabulary, word_perplexity
from haulmark.llm.word_units import BITS, LEAD, SYMBOL, UNITS, Places, discounts, running, units, word_keys

#: Bytes of models a worker holds; beyond them it drops those unused for longest.
MODEL_BYTES = 160 << 20
#: Trigrams from which on a worker holds a model as a table of all codes (16 MB).
TABLE_FROM = 1 << 16
#: Words whose counts every task holds; all others are looked up.
FREQUENT = 1 << 17
#: Words of the corpus for each bucket of counts.
BUCKET_WORDS = 8_000_000
LEAST_BUCKETS = 24
#: Documents of all languages, about, whose deviation a small language's own is weighed with.
POOLED = 20
#: Half the width of a band, in robust standard deviations of the log perplexity.
WIDTH = 5.0
#: Words whose sampling error doubles the variance of a document's log perplexity.
SAMPLING_WORDS = 100
MIN_WORDS = 50

#: Words by hash; trigrams of units, whose unit is TRIGRAM, by code.
COUNTED = "group long, unit int, hash long, n long"
FOLDED = f"{COUNTED}, words long"
TRIGRAM = -1
SURFACE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_U = np.uint64


def trigrams(unit: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of three units that follow each other in one text, and the first one's word."""
    at = np.flatnonzero(np.arange(len(unit)) + 3 <= np.repeat(words.docs[1:], words.counts))
    return (unit[at] << 2 * BITS) | (unit[at + 1] << BITS) | unit[at + 2], at


class Numbers:
    """Small numbers for the languages that a task meets."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}

    def of(self, groups: np.ndarray) -> np.ndarray:
        return np.array([self.known.setdefault(g, len(self.known)) for g in groups.tolist()], np.int64)

    def groups(self) -> np.ndarray:
        return np.array(list(self.known), np.int64)


def count(docs: DataFrame) -> DataFrame:
    """How often each word of each language occurs, with its unit, and each trigram of units."""
    schema = arrow_schema(COUNTED)
    size = 1 << 3 * BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, words_held, trigrams_held = Numbers(), Tally(), Tally()

        def of_words(keys: np.ndarray, note: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            group = numbers.groups()[note >> BITS]
            return record({"group": group, "unit": note & (UNITS - 1), "hash": keys.view(np.int64), "n": n}, schema)

        def of_trigrams(keys: np.ndarray, _: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            unit = np.full(len(keys), TRIGRAM)
            return record({"group": numbers.groups()[keys // size], "unit": unit, "hash": keys % size, "n": n}, schema)

        held = ((words_held, of_words), (trigrams_held, of_trigrams))
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), AS_WRITTEN)
                unit, group = units(words), part.column("group").to_numpy()
                number = numbers.of(group)[words.doc_of()]
                keys, first, n = np.unique(word_keys(words, group), return_index=True, return_counts=True)
                words_held.add(keys, (number << BITS | unit)[first], n)
                code, at = trigrams(unit, words)
                codes, n = np.unique(number[at] * size + code, return_counts=True)
                trigrams_held.add(codes, np.zeros(len(codes), np.int8), n)
                for tally, out in held:
                    if tally.held > HELD and (sums := tally.take()):
                        yield out(*sums)
        for tally, out in held:
            if sums := tally.take():
                yield out(*sums)

    summed = docs.mapInArrow(run, COUNTED).groupBy("hash", "group", "unit").agg(F.sum("n").alias("n"))
    return fold(summed.select("group", "unit", "hash", "n"))


def fold(counts: DataFrame) -> DataFrame:
    """The counts with those words that occur once in a row for each unit, which tells how many ``words`` they are."""
    schema = arrow_schema(FOLDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, once = Numbers(), np.zeros(0, np.int64)
        for batch in batches:
            group, unit, key, n = (c.to_numpy() for c in batch.columns)
            single = (n == 1) & (unit != TRIGRAM)
            groups, where = np.unique(group[single], return_inverse=True)
            place = numbers.of(groups)[where] * UNITS + unit[single]
            sums = np.bincount(place, minlength=len(numbers.known) * UNITS)
            sums[: len(once)] += once
            once, more = sums, ~single
            yield record(dict(zip(schema.names, (group[more], unit[more], key[more], n[more], np.ones(more.sum(), np.int64)), strict=True)), schema)
        at = np.flatnonzero(once)
        zero = np.zeros(len(at), np.int64)
        yield record(dict(zip(schema.names, (numbers.groups()[at // UNITS], at % UNITS, zero, zero + 1, once[at]), strict=True)), schema)
        pa.default_memory_pool().release_unused()

    return counts.mapInArrow(run, FOLDED)


# --- the model ---------------------------------------------------------------------------


@dataclass
class Level:
    """One order: sorted codes with their discounted probability, sorted contexts with their back-off weight."""

    codes: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        d = discounts(counts)
        context = codes >> BITS
        self.codes = codes
        self.contexts, where = np.unique(context, return_inverse=True)
        total = np.bincount(where, counts)
        cut = d[np.minimum(counts, 3)]
        self.share = (counts - cut) / total[where]
        self.weight = np.bincount(where, cut) / total

    def probability(self, code: np.ndarray, lower: np.ndarray) -> np.ndarray:
        share = found(self.codes, self.share, code, 0.0)
        return share + found(self.contexts, self.weight, code >> BITS, 1.0) * lower

    def table(self, lower: np.ndarray) -> np.ndarray:
        """The probability of every code of the order, from those of the order below."""
        share, weight = np.zeros(len(lower) * UNITS), np.ones(len(lower))
        share[self.codes], weight[self.contexts] = self.share, self.weight
        return share + np.repeat(weight, UNITS) * np.tile(lower, UNITS)


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


class KneserNey:
    """Trigram model over units; lower orders count distinct left neighbours."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        mask = (1 << 2 * BITS) - 1
        pairs, n_pairs = np.unique(codes & mask, return_counts=True)
        single, n_single = np.unique(pairs & (UNITS - 1), return_counts=True)
        order = np.argsort(codes)
        self.three = Level(codes[order], counts[order])
        self.two = Level(pairs, n_pairs)
        self.one = Level(single, n_single)

    def log_table(self) -> np.ndarray:
        """What ``log_probability`` gives for each code."""
        low = np.full(1, 1.0 / UNITS)
        for level in (self.one, self.two, self.three):
            low = level.table(low)
        return np.log(low)

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        uniform = np.full(len(code), 1.0 / UNITS)
        one = self.one.probability(code & (UNITS - 1), uniform)
        two = self.two.probability(code & ((1 << 2 * BITS) - 1), one)
        return np.log(self.three.probability(code, two))


@dataclass
class LogTable:
    """A model as the log probabilities of all codes."""

    logs: np.ndarray

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        return self.logs.take(code)


def build_models(counts: DataFrame) -> str:
    """The folder with the model of each language, a file for each; the counts of one are 2**21 at most."""
    folder = new_folder(counts.sparkSession, "models")
    schema = arrow_schema("group long")

    def build(rows: pa.Table) -> pa.Table:
        group, code, n = (rows.column(c).to_numpy() for c in ("group", "code", "n"))
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = model_file(root, int(group[0]))
        own = f"{name}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(own, compression=None) as out:
            out.write(pickle.dumps(KneserNey(code.astype(np.int64), n)))
        fs.move(own, name)
        return pa.table({"group": group[:1]}, schema=schema)

    counts.groupBy("group").applyInArrow(build, "group long").count()
    return folder


def model_file(root: str, group: int) -> str:
    return f"{root}/{group & (1 << 64) - 1:016x}.model"


_models: OrderedDict[tuple[str, int], tuple[KneserNey | LogTable | None, int]] = OrderedDict()


def model_of(folder: str, group: int) -> KneserNey | LogTable | None:
    """A language's model; None if no text of it has three words. Those of another folder go."""
    key = (folder, group)
    if _models and next(iter(_models))[0] != folder:
        _models.clear()
    if key not in _models:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, model, size = model_file(root, group), None, 0
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            with fs.open_input_file(name) as file:
                data = file.read()
            model, size = pickle.loads(data), len(data)
            if len(model.three.codes) >= TABLE_FROM:
                model = LogTable(model.log_table())
                size = model.logs.nbytes
        _models[key] = model, size
        while len(_models) > 1 and sum(n for _, n in _models.values()) > MODEL_BYTES:
            _models.popitem(last=False)
    _models.move_to_end(key)
    return _models[key][0]


@dataclass
class Shares:
    """Discounts and sizes of the units of each language, and the counts of frequent words.

    A word that others hold c times has max(c - discount, 0) + rest of ``exp(log_size)``.
    """

    groups: np.ndarray
    discount: np.ndarray
    rest: np.ndarray
    log_size: np.ndarray
    places: Places
    counts: np.ndarray
    words: int

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts of the frequent words among the keys, 0 for others."""
        at, known = self.places.get(keys)
        return np.where(known, np.append(self.counts, 0).take(at), 0)


def word_shares(counts: DataFrame) -> tuple[Shares, Vocabulary, DataFrame]:
    """What every task holds, a row for each unit of each language; and the counts with their unit's discount."""
    once, twice = (F.sum(F.when(F.col("n") == i, F.col("words")).otherwise(0)) for i in (1, 2))
    v = F.sum("words")
    discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.75)
    size = F.sum(F.col("n") * F.col("words"))
    sizes = keep(
        counts.groupBy("group", "unit").agg(
            discount.alias("discount"), (discount * v / (v + 1)).alias("rest"), size.alias("size")
        ),
        "units",
    )
    group, unit, off, rest, size = (c.to_numpy() for c in sizes.toArrow().columns)
    groups, row = np.unique(group, return_inverse=True)
    tables = [np.ones((len(groups), UNITS)) for _ in range(3)]
    for table, values in zip(tables, (off, rest, np.log(size)), strict=True):
        table[row, unit] = values
    top = counts.filter("n > 1").orderBy(F.desc("n"), "hash").limit(FREQUENT).select("hash", "n", "group", "unit").toArrow()
    hashes, n = top.column("hash").to_numpy().view(_U), top.column("n").to_numpy()
    order = np.argsort(hashes)
    place = np.searchsorted(groups, top.column("group").to_numpy()) * UNITS + top.column("unit").to_numpy()
    sizes_of = np.zeros((len(groups), UNITS))
    sizes_of[row, unit] = size
    vocabulary = Vocabulary(groups, sizes_of, hashes[order], n[order], place[order])
    shares = Shares(groups, *tables, vocabulary.places, n[order], int(size.sum()))
    # a word that occurs once is in no other text
    shared = counts.filter("n > 1").join(F.broadcast(sizes.drop("size")), ["group", "unit"])
    return shares, vocabulary, shared.select("hash", "n", "discount", "rest")


# --- documents ---------------------------------------------------------------------------


def repeated_words(words: Words) -> np.ndarray:
    """Words of each text in windows of three that the text holds twice or more."""
    window, at = runs(words.hash, words.docs, words.counts, 3)
    doc = words.doc_of()
    if not len(at):
        return np.zeros(len(words.counts), np.int64)
    own = mix(window + doc[at].astype(_U) * _U(0x9E3779B97F4A7C15))
    _, where, n = np.unique(own, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words.hash), bool)
    for i in range(3):
        covered[at[n[where] > 1] + i] = True
    return np.bincount(doc[covered], minlength=len(words.counts))


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


REST = "bucket:int,keys:binary,hashes:binary,docs:binary,times:binary"
PER_DOC = ("key", "content", "doc_id", "group", "own", *SURFACE)
LOCAL = (
    ", ".join(f"{c} array<bigint>" for c in PER_DOC)
    + f", unit_logs array<double>, word_logs array<double>, rest array<struct<{REST}>>"
)


def words_by_text(keys: np.ndarray, words: Words, unit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct word of each text, by key: its key, text, unit, and how often it is there."""
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], words.doc_of()[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))[: len(keys)]
    first = np.flatnonzero(new)
    return keys[first], doc[first], unit[order[first]], np.diff(np.append(first, len(keys)))


def asked(key: np.ndarray, hashes: np.ndarray, doc: np.ndarray, times: np.ndarray, buckets: int) -> list[dict]:
    """Words to be looked up, by bucket."""
    bucket = hashes.view(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    upto = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for b in np.flatnonzero(np.diff(upto)).tolist():
        mine = order[upto[b] : upto[b + 1]]
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


def measure(docs: DataFrame, folder: str, shares: Shares, buckets: int) -> DataFrame:
    """Surface counts and sums of log probabilities of each text, and its words to look up; a row a slice.

    Words that are not frequent count as words of no other text.
    """
    held = docs.sparkSession.sparkContext.broadcast(shares)

    def one(part: pa.RecordBatch) -> dict:
        shares = held.value
        words = Words(part.column("text"), AS_WRITTEN)
        n, doc, unit = part.num_rows, words.doc_of(), units(words)
        code, at = trigrams(unit, words)
        group = part.column("group").to_numpy()
        logs = np.zeros(len(code))
        for g in np.unique(group).tolist():
            own = group[doc[at]] == g
            if own.any():
                logs[own] = model_of(folder, g).log_probability(code[own])
        keys, text, kind, times = words_by_text(word_keys(words, group), words, unit)
        row = np.searchsorted(shares.groups, group)[text]
        count = shares.count(keys)
        left = np.where(count > times, count - times - shares.discount[row, kind], 0)
        word_logs = times * (np.log(left + shares.rest[row, kind]) - shares.log_size[row, kind])
        other = count == 0
        signs = running(words, SYMBOL | LEAD << 32)
        symbols = signs & (1 << 32) - 1
        cols = {c: part.column(c) for c in PER_DOC[:5]} | {
            "n_words": words.counts,
            "word_chars": np.bincount(doc, signs.take(words.end) - signs.take(words.start) >> 32, minlength=n).astype(np.int64),
            "n_symbols": symbols[words.bytes_from[1:]] - symbols[words.bytes_from[:-1]],
            "n_dup_lines": [repeated_lines(t) for t in part.column("text").to_pylist()],
            "n_repeat_words": repeated_words(words),
            "unit_logs": np.bincount(doc[at], logs, minlength=n),
            "word_logs": np.bincount(text, word_logs, minlength=n),
            "rest": asked(part.column("key").to_numpy(), keys[other], text[other], times[other], buckets),
        }
        return {c: [v] for c, v in cols.items()}

    return map_slices(docs, one, LOCAL)


GAINS = "key long, gain double"


def look_up(local: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """What each text gains by the words that other texts hold as well.

    A bucket's counts come first; the words of one slice after the other look them up.
    """
    none = F.lit(None)
    names = ("keys", "hashes", "docs", "times")
    table = shared.select(
        F.pmod("hash", F.lit(buckets)).cast("int").alias("bucket"), "hash", "n", "discount", "rest",
        *(none.cast("binary").alias(c) for c in names),
    )
    wanted = local.select(F.explode("rest").alias("r")).select(
        "r.bucket", *(none.cast("long").alias(c) for c in ("hash", "n")),
        *(none.cast("double").alias(c) for c in ("discount", "rest")), *(f"r.{c}" for c in names),
    )
    dealt = table.union(wanted).repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_last("hash"))
    schema = arrow_schema(GAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, held = None, [], None
        for batch in batches:
            for b in dict.fromkeys(batch.column("bucket").to_pylist()):
                own = batch.filter(pc.equal(batch.column("bucket"), b))
                if b != bucket:
                    bucket, parts, held = b, [], None
                given = own.filter(own.column("hash").is_valid())
                if given.num_rows:
                    parts.append([given.column(c).to_numpy() for c in ("hash", "n", "discount", "rest")])
                asks = own.filter(own.column("hash").is_null())
                if not asks.num_rows or not parts:
                    continue
                if held is None:
                    held = [np.concatenate(x) for x in zip(*parts, strict=True)]
                for row in asks.select(list(names)).to_pylist():
                    if (got := gains(row, *held)) is not None:
                        yield record(got, schema)

    return dealt.mapInArrow(run, GAINS).groupBy("key").agg(F.sum("gain").alias("gain"))


def gains(row: dict, hashes: np.ndarray, n: np.ndarray, discount: np.ndarray, rest: np.ndarray) -> dict | None:
    keys, wanted = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["hashes"], np.int64)
    docs, times = (np.frombuffer(row[c], np.int32) for c in ("docs", "times"))
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    seen = np.flatnonzero((hashes[at] == wanted) & (n[at] > times))
    if not len(seen):
        return None
    at, docs, times = at[seen], docs[seen], times[seen]
    gain = times * np.log1p((n[at] - times - discount[at]) / rest[at])
    total = np.bincount(docs, gain, minlength=len(keys))
    return {"key": keys[total > 0], "gain": total[total > 0]}


def language(lang_col: str) -> Column:
    """A number for each language; a missing one has 0."""
    return F.when(F.col(lang_col).isNull(), F.lit(0)).otherwise(F.xxhash64(lang_col)).cast("long").alias("group")


def bands(found_: DataFrame, measure: str = "log_ppl") -> DataFrame:
    """Median and robust deviation of a log perplexity of each language, a row for each.

    The deviation of a language of few documents is weighed with that of all documents.
    """
    long = found_.filter(F.col("n_words") >= MIN_WORDS)
    middle = keep(
        long.groupBy("group").agg(
            F.percentile_approx(measure, 0.5, 10000).alias("middle"), F.count("*").cast("double").alias("n")
        ),
        "middles",
    )
    off = long.join(F.broadcast(middle), "group").select(
        "group", "middle", "n", (F.abs(F.col(measure) - F.col("middle")) / spread(F.col("n_words"))).alias("off")
    )
    mad = F.percentile_approx("off", 0.5, 10000)
    pooled = off.agg(mad).first()[0] or 0.0
    own = (F.col("n") * mad + POOLED * pooled) / (F.col("n") + POOLED)
    return off.groupBy("group", "middle", "n").agg(F.greatest(1.4826 * own, F.lit(1e-3)).alias("deviation")).drop("n")


def spread(n_words: Column) -> Column:
    """How much wider the deviations of short texts are."""
    return F.sqrt(1 + SAMPLING_WORDS / n_words)


def measured(rows: DataFrame) -> DataFrame:
    """Surface counts and log perplexities of each text."""
    counts = keep_lean(count(rows), "counts")
    is_word = F.col("unit") != TRIGRAM
    folder = build_models(counts.filter(~is_word).select("group", F.col("hash").alias("code"), "n"))
    shares, vocabulary, shared = word_shares(counts.filter(is_word))
    # what is shuffled most comes first, while little else is on disk
    by_content = keep_lean(word_perplexity(rows, vocabulary), "trigrams")
    buckets = max(LEAST_BUCKETS, -(-shares.words // BUCKET_WORDS))
    # the keys number the rows of this one pass, so that equal rows stay apart
    keyed = rows.withColumn("key", F.monotonically_increasing_id())
    local = keep(measure(keyed, folder, shares, buckets), "measured")
    each = local.select(F.explode(F.arrays_zip(*PER_DOC, "unit_logs", "word_logs")).alias("d")).select("d.*")
    word_logs = F.col("word_logs") + F.coalesce("gain", F.lit(0.0))
    log_ppl = -F.col("unit_logs") / (F.col("n_words") - 2) - word_logs / F.col("n_words")
    found_ = each.join(look_up(local, shared, buckets), "key", "left")
    found_ = found_.select(*PER_DOC[1:], F.when(F.col("n_words") > 2, log_ppl).alias("log_ppl"))
    return keep_lean(found_.join(by_content, "content", "left"), "quality")


def deviations(found_: DataFrame, measure: str, name: str) -> DataFrame:
    """The rows with their robust deviations from their language's median."""
    z = (F.col(measure) - F.col("middle")) / (F.col("deviation") * spread(F.col("n_words")))
    rated = found_.join(F.broadcast(bands(found_, measure)), "group", "left")
    return rated.withColumn(name, F.when(F.col("n_words") > 0, z)).drop("middle", "deviation")


def verdicts(docs: DataFrame, lang_col: str, *more: Column) -> DataFrame:
    own = more or (F.lit(None).cast("long").alias("own"),)
    group = language(lang_col)
    content = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.length("text"), group).alias("content")
    found_ = measured(texts(docs, "doc_id", "text", group, content, *own))
    rated = deviations(deviations(found_, "log_ppl", "deviations"), "word_log_ppl", "word_deviations")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # copies of a text make its words too easy to foresee, which is no fault of any of them
    inside = [F.coalesce(c <= WIDTH, F.lit(True)) for c in (F.abs("deviations"), F.col("word_deviations"))]
    return rated.select(
        "own",
        "doc_id",
        *SURFACE,
        failed.alias("base_failed"),
        (~failed & inside[0] & inside[1]).alias("kept"),
        *("log_ppl", "deviations", "word_log_ppl", "word_deviations"),
    )


def judge(docs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Surface counts, log perplexity and the verdict on each document.

    ``kept`` is false for fewer than MIN_WORDS words, for more than half of the words in
    repeated windows, and outside the language's band: its median log perplexity, give or
    take WIDTH robust deviations, wider for short texts; for the model of units with each
    word's share on both sides, and above for that of word trigrams (``word_log_ppl``), whose lower end is where
    copies are. A missing or empty text has no
    words and is rejected. A missing language is one of its own. Rows with equal or
    missing ids are judged one by one. Needs ``doc_id``, ``text`` and the language column;
    others are ignored. An empty table gives no rows.
    """
    return verdicts(docs, lang_col).drop("own")


def keep_good(docs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """The documents that ``judge`` keeps, all columns as they are.

    Rows of equal id, text and language have equal verdicts, so the rejected ones leave by a
    hash of these. Rows that a filter of the rejected hashes does not hold are not moved.
    """
    own = "__row_key"
    key = F.xxhash64(row_key(), F.col(lang_col), F.col(lang_col).isNull())
    gone = verdicts(docs, lang_col, key.alias("own")).filter("NOT kept").select(F.col("own").alias(own)).distinct()
    gone = keep(gone, "rejected")
    held = docs.sparkSession.sparkContext.broadcast(bloom(gone.select(F.col(own).alias("hash"))))

    @F.pandas_udf("boolean")
    def suspect(keys: pd.Series) -> pd.Series:
        return pd.Series(may_hold(held.value, keys.to_numpy().view(_U)))

    keyed = docs.withColumn(own, key)
    judged = keyed.filter(suspect(own)).join(gone, own, "left_anti")
    return keyed.filter(~suspect(own)).unionByName(judged).drop(own)
