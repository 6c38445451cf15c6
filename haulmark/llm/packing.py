"""Packing: first-fit decreasing over a tournament tree, in randomised groups of documents.

A document is cut into full sequences and one rest. Rests of a group, longest first, go
into the first sequence with room, which a tree of the largest free room finds in
logarithmic time. Groups are drawn by a hash of the row and hold a few thousand documents,
so no key decides how large one gets; only lengths and checksums are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import arrow_schema, map_slices, record, texts
from haulmark.llm.encoding import encoder

#: Rows of a group that are packed together; a group with more (one row repeated) is packed in parts.
UNIT = 1 << 17

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class Bins:
    """Free room of numbered bins; each inner node holds the largest room below it."""

    def __init__(self, most: int, room: int):
        self.leaves = 1
        while self.leaves < most:
            self.leaves *= 2
        self.room = room
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size`` and the place in it."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        offset = self.room - tree[at]
        tree[at] -= size
        node = at
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return at - self.leaves, offset


def first_fit(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the given order."""
    full = 0
    while full < len(sizes) and sizes[full] == room:
        full += 1
    bins = Bins(max(1, len(sizes) - full), room)
    placed = [(i, 0) for i in range(full)]
    for size in sizes[full:]:
        bin_, offset = bins.place(size)
        placed.append((full + bin_, offset))
    return [p[0] for p in placed], [p[1] for p in placed]


def pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, group: str = "grp") -> DataFrame:
    """The pieces of each document: full sequences and a rest, with the checksum of their ids."""

    def cut(part: pa.RecordBatch) -> dict:
        ids, upto = encoder(tokenizer).encode(part.column("text"), last=end_id)
        n = np.diff(upto)
        count = -(-n // length)
        doc = np.repeat(np.arange(len(n)), count)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
        size = np.minimum(length, n[doc] - start)
        raw, begin = memoryview(ids.astype("<u4").tobytes()), upto[doc] + start
        crc = [zlib.crc32(raw[4 * b : 4 * (b + s)]) for b, s in zip(begin.tolist(), size.tolist(), strict=True)]
        return {
            "doc_id": part.column("doc_id").take(pa.array(doc)),
            "start": start,
            "length": size,
            "ids_crc32": crc,
            "doc_tokens": n[doc],
            "grp": part.column(group).take(pa.array(doc)),
        }

    return map_slices(docs, cut, PIECES + ", grp long")


def pack(
    docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, group_docs: int = 4096, seed: int = 1
) -> DataFrame:
    """One row for each piece of each document with its sequence and the offset there.

    Ids are those of the tokenizer file, closed by ``end_id``; a missing or empty text is
    its end id alone. Every row is packed, rows with equal or missing ids too. Sequences
    hold at most ``length`` ids and pieces follow each other from 0 without a gap. An empty
    table gives no rows. Needs ``doc_id`` and ``text``; other columns are ignored.
    """
    rows = texts(docs)
    groups = max(1, -(-rows.count() // group_docs))
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(groups)).alias("grp")
    cut = pieces(rows.select("doc_id", "text", drawn), tokenizer, length, end_id)
    dealt = cut.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "start", "ids_crc32")
    schema = arrow_schema(PACKED)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: dict[int, int] = {}
        for unit in units(batches, "grp"):
            grp = unit.column("grp")[0].as_py()
            bin_, offset = first_fit(unit.column("length").to_pylist(), length)
            first = bins.get(grp, 0)
            bins = {grp: first + max(bin_) + 1}
            cols = {name: unit.column(name) for name in PIECES.replace(" long", "").split(", ")}
            yield record(cols | {"sequence_id": (grp << 32) + first + np.array(bin_), "offset": offset}, schema)

    return dealt.mapInArrow(fill, PACKED)


def units(batches: Iterator[pa.RecordBatch], key: str, most: int = UNIT) -> Iterator[pa.RecordBatch]:
    """Rows that follow each other with the same key, at most ``most`` at once."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if held and (held[-1].column(key)[0].as_py() != keys[begin] or sum(b.num_rows for b in held) >= most):
                yield joined()
                held = []
            held.append(batch.slice(begin, end - begin))
    if held:
        yield joined()
