"""Benchmark decontamination by winnowing.

Both sides hash every run of GRAM words and keep the smallest hash of each GRAMS
consecutive ones, so that any shared window of SPAN words has a kept hash in common. A
Bloom filter of fixed size, filled from the benchmark's hashes, lets a document send only
hashes that the benchmark may hold; the join is on the hash. Every kept hash carries the
words around it, and hits are extended over them word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import (
    LOWER_ALNUM, Words, arrow_schema, binary_column, keep, list_column, map_slices, mix, record, row_key, texts,
)

SPAN = 10
GRAM = 6
GRAMS = SPAN - GRAM + 1
#: Words on each side that a hit may be extended over: every longer hit has another kept hash there.
REACH = GRAMS - 1
AROUND = GRAM + 2 * REACH

FINGERPRINTS = "hash long, pos long, around binary"
DOCUMENTS = "key long, doc_id long, n_words long, hashes array<bigint>, pos array<bigint>, around array<binary>"
_U = np.uint64


def winnow(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes kept by winnowing and the word each begins at."""
    grams, at = words.windows(GRAM)
    full = np.zeros(len(words.hash), _U)
    full[at] = grams
    _, begin = words.windows(SPAN)
    if not len(begin):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    least, pos = full[begin], begin.copy()
    for i in range(1, GRAMS):
        less = full[begin + i] < least
        least = np.where(less, full[begin + i], least)
        pos[less] = begin[less] + i
    pos = np.unique(pos)
    return full[pos], pos


def around(words: Words, pos: np.ndarray, filler: int) -> np.ndarray:
    """The words about each kept hash, one row each; ``filler`` stands where a text ends."""
    at = pos[:, None] + np.arange(-REACH, GRAM + REACH)
    doc = words.doc_of()[pos] if len(pos) else pos
    inside = (at >= words.docs[:-1][doc][:, None]) & (at < words.docs[1:][doc][:, None])
    return np.where(inside, words.hash[np.clip(at, 0, max(0, len(words.hash) - 1))], _U(filler))


def short(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, kept apart from those of other lengths."""
    grams, at = words.windows(k)
    return mix(grams ^ _U(k)), at


def item_rows(part: pa.RecordBatch) -> dict:
    words = Words(part.column("text"), LOWER_ALNUM)
    hashes, pos = winnow(words)
    rows = [(hashes, words.doc_of()[pos] if len(pos) else pos, around(words, pos, 1), np.zeros(len(pos), np.int64))]
    for k in range(1, SPAN):
        whole, at = short(words, k)
        doc = words.doc_of()[at] if len(at) else at
        own = words.counts[doc] == k
        rows.append((whole[own], doc[own], np.ones((own.sum(), AROUND), _U), np.full(own.sum(), k)))
    hashes, doc, near, size = (np.concatenate(x) for x in zip(*rows, strict=True))
    return {
        "hash": hashes.view(np.int64),
        "item_id": part.column("item_id").take(pa.array(doc)),
        "short": size,
        "item_around": binary_column(near.ravel(), np.full(len(near), AROUND)),
    }


#: Bits of the filter: 1 MB, whatever the benchmark's size; a full one only lets more hashes through.
FILTER_BITS = 1 << 23


def bloom(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits over the column ``hash``; words that are set, at most, reach the driver."""
    bit = F.explode(F.array(*(F.shiftrightunsigned("hash", s).bitwiseAND(FILTER_BITS - 1) for s in (0, 32)))).alias("bit")
    rows = (
        hashes.select(bit)
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(_U)


def may_hold(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for shift in (0, 32):
        bit = (hashes >> _U(shift)) & _U(FILTER_BITS - 1)
        out &= (filter_[bit >> _U(6)] >> (bit & _U(63))) & _U(1) == 1
    return out


def document_rows(docs: DataFrame, filter_: np.ndarray, shorts: list[int]) -> DataFrame:
    """Word count, and the kept hashes that the filter holds, of each document."""
    held = docs.sparkSession.sparkContext.broadcast(filter_)

    def rows(part: pa.RecordBatch) -> dict:
        words = Words(part.column("text"), LOWER_ALNUM)
        found = [winnow(words)] + [short(words, k) for k in shorts]
        kept = [may_hold(held.value, h) for h, _ in found]
        size = np.concatenate([np.full(k.sum(), s) for k, s in zip(kept, [0, *shorts], strict=True)])
        hashes = np.concatenate([h[k] for (h, _), k in zip(found, kept, strict=True)])
        pos = np.concatenate([p[k] for (_, p), k in zip(found, kept, strict=True)])
        doc = words.doc_of()[pos] if len(pos) else pos
        order = np.argsort(doc, kind="stable")
        hashes, pos, doc, size = hashes[order], pos[order], doc[order], size[order]
        near = around(words, pos, 0)
        near[size > 0] = 0
        counts = np.bincount(doc, minlength=part.num_rows)
        near = binary_column(near.ravel(), np.full(len(pos), AROUND))
        upto = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        return {
            "key": part.column("key"),
            "doc_id": part.column("doc_id"),
            "n_words": words.counts,
            "hashes": list_column(hashes.view(np.int64), counts),
            "pos": list_column(pos - words.docs[:-1][doc], counts),
            "around": pa.ListArray.from_arrays(upto, near),
        }

    return map_slices(docs, rows, DOCUMENTS)


MATCHED = "key long, item_id string, first long, last long"


def extend(joined: DataFrame) -> DataFrame:
    """Spans of words of a document that occur in an item, from kept hashes that match."""
    schema = arrow_schema(MATCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), _U).reshape(-1, AROUND)
                for c in ("around", "item_around")
            )
            same = a == b
            left = np.cumprod(same[:, :REACH][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, REACH + GRAM :], axis=1).sum(axis=1)
            size = batch.column("short").to_numpy()
            hit = (size > 0) | same[:, REACH : REACH + GRAM].all(axis=1) & (left + GRAM + right >= SPAN)
            pos = batch.column("pos").to_numpy()
            yield record(
                {
                    "key": batch.column("key").filter(pa.array(hit)),
                    "item_id": batch.column("item_id").filter(pa.array(hit)),
                    "first": (pos - left * (size == 0))[hit],
                    "last": (pos + np.where(size > 0, size, GRAM + right) - 1)[hit],
                },
                schema,
            )

    return joined.select("key", "item_id", "pos", "short", "around", "item_around").mapInArrow(run, MATCHED)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, doc_id, n_words`` of each document, and ``key, item_id, first, last`` of each hit.

    ``first`` and ``last`` are word numbers from 0 in the document.
    """
    items = texts(
        benchmark.select(F.col("item_id").alias("own"), "text"), "own", "text",
        F.coalesce(F.col("own").cast("string"), F.lit("")).alias("item_id"),
    )
    prints = keep(map_slices(items, item_rows, "hash long, item_id string, short long, item_around binary"), "prints")
    shorts = [r[0] for r in prints.filter("short > 0").select("short").distinct().collect()]  # 9 at most
    rows = texts(docs, "doc_id", "text", row_key().alias("key"))
    found = keep(document_rows(rows, bloom(prints.select("hash")), sorted(shorts)), "found")
    kept = (
        found.select("key", F.explode(F.arrays_zip("hashes", "pos", "around")).alias("f"))
        .select("key", F.col("f.hashes").alias("hash"), F.col("f.pos").alias("pos"), F.col("f.around").alias("around"))
        .distinct()
    )
    hits = extend(kept.join(prints.distinct(), "hash")).distinct()
    return found.select("key", "doc_id", "n_words"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words of each document inside a window of a benchmark item, and the items.

    A window is SPAN consecutive words of an item, or a shorter item as a whole. Items
    without words, or missing ones, match nothing; a missing item id is listed as empty. A
    document without words has no hits. Rows with equal or missing ids are judged one by
    one. Needs ``doc_id`` and ``text``, ``item_id`` and ``text``; other columns are ignored.
    """
    rows, hits = find_leaks(docs, benchmark)
    spans = hits.groupBy("key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.collect_set(F.struct("first", "last")).alias("spans")
    )
    words = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"]))))
    return (
        rows.join(spans, "key", "left")
        .withColumn("n_hit", F.when(F.col("spans").isNull(), F.lit(0)).otherwise(F.size(words)).cast("long"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.sha2(F.encode(F.coalesce(F.array_join("items", ","), F.lit("")), "UTF-8"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, all columns as they are."""
    _, hits = find_leaks(docs, benchmark)
    own = "__row_key"
    keys = keep(hits.select(F.col("key").alias(own)).distinct(), "leaks")
    return docs.withColumn(own, row_key()).join(keys, own, "left_anti").drop(own)
