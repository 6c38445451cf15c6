"""Removal of word sequences that an earlier document holds, by windows grouped by their least grams.

The places where WINDOW words begin are called suffixes. A suffix belongs to the group, called
subtree, of the smallest hash of its GRAM-word runs, so equal windows meet in one subtree and
neighbours that share that run travel as one row with their common words. Subtrees that
only one document reaches are never sent; subtrees with many rows are split by the smallest
hash of longer runs in the window, which neighbours mostly share too, so that a row falls into
two or three parts, however large its subtree is. In a part, windows are told apart by the
hashes of their first 16, 32 and 50 words. This stands in for a suffix tree: no branching
nodes or maximal repeats are built.

Documents with the words of an earlier one are folded before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import (
    AS_WRITTEN, Words, arrow_schema, binary_column, keep, list_column, map_slices, mix, powers, record, row_key,
    texts,
)
from haulmark.llm.decontaminate import bloom, may_hold

WINDOW = 50
GRAM = 8
#: Path lengths at which nodes split.
DEPTHS = (16, 32, WINDOW)
#: Words of the longer runs by which a large subtree is split, and its rows in a part.
LONGER = 16
PART_ROWS = 4096

_U = np.uint64

ROWS = (
    "key long, doc_id long, n_words long, low long, high long, kept_sha256 string, "
    "prefix array<bigint>, start array<bigint>, size array<bigint>"
)
SUFFIXES = "prefix long, part long, doc_id long, key long, start long, size long, mask long, words binary"
COVERED = "key long, first long, last long"


def suffix_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, first suffix and number of suffixes of each run of neighbours with one prefix."""
    _, begin = words.windows(WINDOW)
    if not len(begin):
        return np.zeros(0, _U), begin, begin
    least = least_gram(words, begin, GRAM)
    new = np.concatenate(([True], (begin[1:] != begin[:-1] + 1) | (least[1:] != least[:-1])))
    first = np.flatnonzero(new)
    # a run repeated in its text may stand for more suffixes than one occurrence can: cut to 64
    size = np.diff(np.append(first, len(begin)))
    parts = -(-size // 64)
    own = np.repeat(np.arange(len(first)), parts)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
    return least[first][own], begin[first][own] + 64 * nth, np.minimum(size[own] - 64 * nth, 64)


def least_gram(words: Words, begin: np.ndarray, k: int) -> np.ndarray:
    """The smallest hash of k words in each of the windows that begin at ``begin``."""
    gram, at = words.windows(k)
    least = np.zeros(len(words.hash), _U)
    least[at] = gram
    width, grams = 1, WINDOW - k + 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (grams - width)], least[grams - width :])[begin]


def path(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each place on."""
    power, inverse = powers(len(hashes) + 1)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(hashes * power[: len(hashes)], dtype=_U)))
    return mix((total[at + k] - total[at]) * inverse[at])


def document_rows(part: pa.RecordBatch) -> dict:
    words = Words(part.column("text"), AS_WRITTEN)
    prefix, start, size = suffix_runs(words)
    doc = words.doc_of()[start] if len(start) else start
    counts = np.bincount(doc, minlength=part.num_rows)
    n = words.counts
    power, inverse = powers(len(words.hash) + 1)
    whole = []
    for h in (words.hash, mix(words.hash ^ _U(0xD6E8FEB86659FD93))):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(h * power[: len(h)], dtype=_U)))
        whole.append(((total[words.docs[1:]] - total[words.docs[:-1]]) * inverse[words.docs[:-1]]).view(np.int64))
    return {
        "key": part.column("key"),
        "doc_id": part.column("doc_id"),
        "n_words": n,
        "low": whole[0],
        "high": whole[1],
        "kept_sha256": [joined_sha256(words, np.arange(b, e)) for b, e in zip(words.docs, words.docs[1:], strict=False)],
        "prefix": list_column(prefix.view(np.int64), counts),
        "start": list_column(start - words.docs[:-1][doc], counts),
        "size": list_column(size, counts),
    }


def joined_sha256(words: Words, at: np.ndarray) -> str:
    """SHA-256 of the given words, joined by one space; bytes split at the white space that ends words."""
    if not len(at):
        return hashlib.sha256(b"").hexdigest()
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    bounds = np.concatenate(([0], cut, [len(at)]))
    out = []
    for b, e in zip(bounds[:-1], bounds[1:], strict=True):
        run = words.data[words.start[at[b]] : words.end[at[e - 1]]]
        out.append(b" ".join(run.split()))
    return hashlib.sha256(b" ".join(out)).hexdigest()


def touched_documents(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Key, id and text of the documents that hold a shared prefix, with their runs.

    A filter of fixed size keeps most other texts from being shuffled.
    """
    runs = shared.groupBy("key").agg(F.collect_list(F.struct("prefix", "parts", "start", "size")).alias("runs"))
    runs = keep(runs, "runs")
    held = rows.sparkSession.sparkContext.broadcast(bloom(runs.select(F.xxhash64("key").alias("hash"))))

    def some(part: pa.RecordBatch) -> dict | None:
        part = part.filter(pa.array(may_hold(held.value, part.column("key_hash").to_numpy().view(_U))))
        return {c: part.column(c) for c in ("key", "doc_id", "text")} if part.num_rows else None

    near = map_slices(
        rows.select("key", "doc_id", "text", F.xxhash64("key").alias("key_hash")), some, "key long, doc_id long, text string"
    )
    return keep(near.distinct().join(runs, "key"), "touched")


def suffixes(touched: DataFrame) -> DataFrame:
    """A row for each run, and for each part of a split subtree that its suffixes fall into."""

    def rows(part: pa.RecordBatch) -> dict:
        words = Words(part.column("text"), AS_WRITTEN)
        lists = part.column("runs")
        doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        prefix, parts, start, size = (flat.field(c).to_numpy() for c in ("prefix", "parts", "start", "size"))
        at = start + words.docs[:-1][doc]
        run = np.repeat(np.arange(len(at)), size)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        longer = least_gram(words, at[run] + nth, LONGER) if len(run) else np.zeros(0, _U)
        # mixed, as the least of many hashes is small
        where = (mix(longer) % parts[run].astype(_U)).astype(np.int64)
        order = np.lexsort((nth, where, run))
        run, nth, where = run[order], nth[order], where[order]
        new = np.concatenate(([True], (run[1:] != run[:-1]) | (where[1:] != where[:-1]))) if len(run) else run
        mask = np.bitwise_or.reduceat(np.left_shift(_U(1), nth.astype(_U)), np.flatnonzero(new)) if len(run) else longer
        own, where = run[new.astype(bool)], where[new.astype(bool)]
        count = size[own] + WINDOW - 1
        take = np.arange(int(count.sum())) + np.repeat(at[own] - (np.cumsum(count) - count), count)
        return {
            "prefix": prefix[own],
            "part": where,
            "doc_id": part.column("doc_id").take(pa.array(doc[own])),
            "key": part.column("key").take(pa.array(doc[own])),
            "start": start[own],
            "size": size[own],
            "mask": mask.view(np.int64),
            "words": binary_column(words.hash[take], count),
        }

    return map_slices(touched, rows, SUFFIXES)


def deep_nodes(hashes: np.ndarray, at: np.ndarray, may_stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below nodes of depth WINDOW, and the node of each; a node has two suffixes or more.

    Suffixes in ``may_stay`` are kept without a partner: theirs may have come before.
    """
    left = np.arange(len(at))
    node = np.zeros(len(at), _U)
    for depth in DEPTHS:
        node = path(hashes, at[left], depth)
        _, which, n = np.unique(node, return_inverse=True, return_counts=True)
        stay = (n[which] > 1) | may_stay[left]
        left, node = left[stay], node[stay]
    return left, node


def grow(dealt: DataFrame) -> DataFrame:
    """Words of each document under suffixes whose node an earlier document reaches.

    Rows come sorted by subtree and document. A subtree that goes on in the next batch hands
    its deep paths and their first documents on.
    """
    schema = arrow_schema(COVERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[int, int] | None = None
        seen, seen_doc = np.zeros(0, _U), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, part, doc, key, start, size = (
                batch.column(c).to_numpy() for c in ("prefix", "part", "doc_id", "key", "start", "size")
            )
            mask = batch.column("mask").to_numpy().view(_U)
            hashes = np.frombuffer(b"".join(batch.column("words").to_pylist()), _U)
            count = size + WINDOW - 1
            base = np.cumsum(count) - count
            row = np.repeat(np.arange(len(size)), size)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            mine = (mask[row] >> nth.astype(_U)) & _U(1) == 1
            row, nth = row[mine], nth[mine]
            first = (prefix == prefix[0]) & (part == part[0]) if open_ == (prefix[0], part[0]) else np.zeros(len(size), bool)
            final = (prefix == prefix[-1]) & (part == part[-1])
            left, node = deep_nodes(hashes, base[row] + nth, (first | final)[row])
            row, nth = row[left], nth[left]
            if open_ is not None and not first.any():
                seen, seen_doc = seen[:0], seen_doc[:0]
            everywhere, where = np.unique(np.concatenate((seen, node)), return_inverse=True)
            least = np.full(len(everywhere), np.iinfo(np.int64).max)
            np.minimum.at(least, where, np.concatenate((seen_doc, doc[row])))
            where = where[len(seen) :]
            again = doc[row] > least[where]
            # what the next batch may need: paths of the last subtree
            last = np.unique(where[final[row]])
            if first.any() and final.all():
                seen, seen_doc = everywhere, least
            else:
                seen, seen_doc = everywhere[last], least[last]
            open_ = (prefix[-1], part[-1])
            row, nth = row[again], nth[again]
            if len(row):
                order = np.lexsort((nth, row))
                row, nth = row[order], nth[order]
                new = np.concatenate(([True], (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)))
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(row)) - 1
                yield record(
                    {
                        "key": key[row[begin]],
                        "first": start[row[begin]] + nth[begin],
                        "last": start[row[end]] + nth[end] + WINDOW - 1,
                    },
                    schema,
                )

    return dealt.mapInArrow(run, COVERED)


def cut(touched: DataFrame, covered: DataFrame) -> DataFrame:
    """Removed words and checksum of what is left, of the documents with covered words."""
    spans = covered.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def rows(part: pa.RecordBatch) -> dict:
        words = Words(part.column("text"), AS_WRITTEN)
        removed, sha = [], []
        for i, spans_ in enumerate(part.column("spans").to_pylist()):
            gone = np.zeros(int(words.counts[i]) + 1, np.int64)
            for s in spans_:
                gone[s["first"]] += 1
                gone[s["last"] + 1] -= 1
            left = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + words.docs[i]
            removed.append(int(words.counts[i]) - len(left))
            sha.append(joined_sha256(words, left))
        return {"key": part.column("key"), "n_removed": removed, "cut_sha256": sha}

    both = touched.select("key", "text").join(spans, "key")
    return map_slices(both, rows, "key long, n_removed long, cut_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Words, removed words and the checksum of the kept words of each document.

    A word goes if a window of WINDOW words over it also begins in a document of a smaller
    doc_id. Windows are those of the input. Missing, empty and shorter texts lose nothing;
    a document without an id neither loses words nor takes them from others. Rows with
    equal ids are not earlier than each other. Needs ``doc_id`` and ``text``; other columns
    are ignored.
    """
    rows = texts(docs, "doc_id", "text", row_key().alias("key"))
    read = keep(map_slices(rows, document_rows, ROWS), "words")
    long = read.filter(f"n_words >= {WINDOW} AND doc_id IS NOT NULL")
    same = ["n_words", "low", "high"]
    earliest = keep(long.groupBy(*same).agg(F.min("doc_id").alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n"), "same")
    alone = F.col("earliest").isNull() | (F.col("earliest") == F.col("doc_id"))
    runs = (
        long.join(earliest, same, "left")
        .filter(alone)
        .select("key", "doc_id", F.explode(F.arrays_zip("prefix", "start", "size")).alias("r"))
        .select("key", "doc_id", "r.prefix", "r.start", "r.size")
    )
    reached = (
        runs.groupBy("prefix")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
        .filter("low < high")
        .select("prefix", F.ceil(F.col("n") / PART_ROWS).alias("parts"))
    )
    shared = runs.join(reached, "prefix").select("key", "prefix", "parts", "start", "size").distinct()
    touched = touched_documents(rows, shared)
    dealt = suffixes(touched).repartition("prefix", "part").sortWithinPartitions("prefix", "part", "doc_id")
    changed = cut(touched, grow(dealt))
    copy = F.coalesce(F.col("earliest") < F.col("doc_id"), F.lit(False))
    return (
        read.drop("prefix", "start", "size")
        .join(earliest, same, "left")
        .join(changed, "key", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"),
        )
    )
