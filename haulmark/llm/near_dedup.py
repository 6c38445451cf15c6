"""Near-duplicate documents by odd sketches.

A document's set of five-word shingles gives SAMPLES MinHash values (one permutation, empty
bins filled from others) and from them an odd sketch: a bitmap whose bit is set where an odd
number of samples falls. Equal sets are folded first. Bands of samples propose candidates,
the population count of the XOR of two sketches estimates their similarity, and pairs that
may reach the threshold are confirmed on the full sets.

A member is first compared with the smallest one of all its bands, so a group of near copies
costs one comparison a member. Where a band still holds several components, its members meet
in blocks with their full sets: pairs of different components are confirmed there, nearest
sketches first, each in the first band they share, and a pair leaves the task only if it is
a link that joins two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import (
    LOWER, Words, arrow_schema, binary_column, keep, map_slices, mix, record, runs, texts,
)
from haulmark.llm.decontaminate import bloom, may_hold
from haulmark.llm.graphs import components

SHINGLE = 5
SAMPLES = 128
ROWS = 4
BANDS = SAMPLES // ROWS
SKETCH_BITS = 512
#: The threshold as a fraction: 100 * intersection >= 75 * union.
PARTS, OF = 75, 100
#: Estimates are off by 0.05 at the threshold (one deviation); candidates below are not confirmed.
LEAST_ESTIMATE = 0.45
#: Members of a band in a block; two blocks meet in one task.
BLOCK = 2048

_U = np.uint64
_ORDER = np.argsort(mix(np.arange(SAMPLES * SAMPLES, dtype=_U)).reshape(SAMPLES, SAMPLES), axis=1)
_SALT = mix(np.arange(1, SAMPLES + 1, dtype=_U))
_EDGES = np.arange(SAMPLES, dtype=_U) << _U(64 - 7)

SIGNED = "doc_id long, n long, low long, high long, bands array<bigint>, sketch binary"


def odd_bits(similarity: float) -> float:
    """Expected number of set bits in the XOR of two sketches of sets this similar."""
    return SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - similarity))) / 2


MOST_ODD = int(odd_bits(LEAST_ESTIMATE))


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; short texts give one, empty ones none."""
    window, at = words.windows(SHINGLE)
    cut = np.searchsorted(at, words.docs)
    out = []
    for i, n in enumerate(words.counts.tolist()):
        if n >= SHINGLE:
            h = np.sort(window[cut[i] : cut[i + 1]])
            h = h[np.concatenate(([True], h[1:] != h[:-1]))]
        elif n:
            own = words.hash[words.docs[i] : words.docs[i + 1]]
            h = runs(own, np.array([0, n]), np.array([n]), n)[0]
        else:
            h = np.zeros(0, _U)
        out.append(h)
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin of the hash range; an empty bin takes another's."""
    at = np.searchsorted(shingles, _EDGES)
    inside = np.append(at[1:], len(shingles)) > at
    value = shingles[np.minimum(at, len(shingles) - 1)]
    if not inside.all():
        empty = np.flatnonzero(~inside)
        order = _ORDER[empty]
        value[empty] = value[order[np.arange(len(empty)), inside[order].argmax(axis=1)]]
    return value


SAME = ["n", "low", "high"]


def identity(sets: list[np.ndarray]) -> dict:
    """Size and a 128-bit hash of each set."""
    return {
        "n": [len(s) for s in sets],
        "low": np.array([s.sum(dtype=_U) for s in sets], _U).view(np.int64),
        "high": np.array([mix(s).sum(dtype=_U) for s in sets], _U).view(np.int64),
    }


def sign(part: pa.RecordBatch) -> dict:
    sets = shingle_sets(Words(part.column("text"), LOWER))
    some = [s for s in sets if len(s)]
    value = np.stack([samples(s) for s in some]) if some else np.zeros((0, SAMPLES), _U)
    salted = mix(value ^ _SALT)
    bit = (salted % _U(SKETCH_BITS)).astype(np.int64)
    odd = np.zeros((len(some), SKETCH_BITS), np.uint8)
    np.add.at(odd, (np.arange(len(some))[:, None], bit), 1)
    sketch = np.packbits(odd & 1, axis=1)
    band = mix(salted.reshape(-1, BANDS, ROWS) * _U(0x9E3779B97F4A7C15) ** np.arange(1, ROWS + 1, dtype=_U)).sum(axis=2, dtype=_U)
    has = np.array([len(s) > 0 for s in sets])
    counts = np.where(has, BANDS, 0)
    upto = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    return {
        "doc_id": part.column("doc_id"),
        **identity(sets),
        "bands": pa.ListArray.from_arrays(upto, pa.array(band.ravel().view(np.int64))),
        "sketch": binary_column(sketch.ravel(), np.where(has, SKETCH_BITS // 8, 0)),
    }


def estimated(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose sketches and set sizes allow the threshold."""
    side = signed.select("doc_id", "sketch", "n")
    both = pairs.join(side.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a").join(
        side.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b"
    )
    fits = OF * F.least("na", "nb") >= PARTS * F.greatest("na", "nb")
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (bits(batch.column(c)) for c in ("sa", "sb"))
                near = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= MOST_ODD)
                yield record({c: batch.column(c).filter(near) for c in ("a", "b")}, schema)

    return both.filter(fits).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _U).reshape(-1, SKETCH_BITS // 64)


def full_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Shingle sets of the ``wanted`` documents (id and identity of the set).

    A filter of fixed size spares most other texts the work.
    """
    held = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.xxhash64("doc_id").alias("hash"))))

    def sets(part: pa.RecordBatch) -> dict | None:
        hashes = part.column("id_hash").to_numpy().view(_U)
        part = part.filter(pa.array(may_hold(held.value, hashes)))
        if not part.num_rows:
            return None
        found = shingle_sets(Words(part.column("text"), LOWER))
        flat = np.concatenate(found)
        shingles = binary_column(flat, np.array([len(s) for s in found]))
        return identity(found) | {"doc_id": part.column("doc_id"), "shingles": shingles}

    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("id_hash"))
    made = map_slices(hashed, sets, "doc_id long, n long, low long, high long, shingles binary")
    return keep(made.join(wanted, ["doc_id", *SAME]).drop(*SAME).dropDuplicates(["doc_id"]), "sets")


def confirmed(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold.

    Rows are dealt by the first document and a salt, its set comes first, and one set is
    held at a time.
    """
    salts = F.lit(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), salts))
    heads = pairs.select("a", "salt").distinct().join(shingles.withColumnRenamed("doc_id", "a"), "a")
    members = pairs.join(shingles.withColumnRenamed("doc_id", "b"), "b")
    dealt = (
        heads.select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
        .union(members.select("a", "salt", "b", "shingles"))
        .repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    )
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, np.zeros(0, _U)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "shingles")), strict=True):
                if b is None:
                    head, own = a, np.frombuffer(data, _U)
                elif a == head and linked(own, np.frombuffer(data, _U)):
                    out.append((a, b))
            if out:
                yield record({"a": [p[0] for p in out], "b": [p[1] for p in out]}, schema)

    return dealt.mapInArrow(run, "a long, b long")


def across(members: DataFrame) -> DataFrame:
    """Links that join different components of a band.

    ``members``: band, i (its number), doc_id, component, size, n, sketch, bands, shingles.
    They are dealt into blocks, and each two blocks of a band meet in one task.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.hash("doc_id"), blocks)
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, own).alias("p"), F.greatest(x, own).alias("q")))
    dealt = (
        members.withColumn("own", own)
        .withColumn("meet", F.explode(every))
        .select("band", "meet.p", "meet.q", "own", "i", "doc_id", "component", "n", "sketch", "bands", "shingles")
        .repartition("band", "p", "q")
        .sortWithinPartitions("band", "p", "q", "doc_id")
    )
    schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("band", "p", "q")):
            if links := joining(group):
                yield record({"a": [x[0] for x in links], "b": [x[1] for x in links]}, schema)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def joining(group: pa.RecordBatch) -> list[tuple[int, int]]:
    """Pairs of a group that are links and join components that no earlier one joined."""
    doc, comp, n, own = (group.column(c).to_numpy() for c in ("doc_id", "component", "n", "own"))
    index, p, q = (group.column(c)[0].as_py() for c in ("i", "p", "q"))
    label = comp.copy()
    if (label == label[0]).all():
        return []
    sketch = bits(group.column("sketch"))
    bands = group.column("bands").flatten().to_numpy().reshape(-1, BANDS)
    sets = [np.frombuffer(s, _U) for s in group.column("shingles").to_pylist()]
    most = np.unique(comp, return_counts=True)
    main = most[0][most[1].argmax()]
    out = []
    for i in np.flatnonzero(comp != main).tolist():
        # pairs within the largest component need no comparison, others are met from one side
        other = (label != label[i]) & ((comp == main) | (doc > doc[i]))
        if p != q:
            other &= own != own[i]
        other &= OF * np.minimum(n, n[i]) >= PARTS * np.maximum(n, n[i])
        j = np.flatnonzero(other)
        odd = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1)
        near = odd <= MOST_ODD
        j, odd = j[near], odd[near]
        j, odd = (x[(bands[j] == bands[i]).argmax(axis=1) == index] for x in (j, odd))
        for k in j[np.argsort(odd, kind="stable")].tolist():
            if label[k] != label[i] and linked(sets[i], sets[k]):
                out.append((min(int(doc[i]), int(doc[k])), max(int(doc[i]), int(doc[k]))))
                label[label == label[k]] = label[i]
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b.take(np.searchsorted(b, a), mode="clip") == a).sum())
    return OF * both >= PARTS * (len(a) + len(b) - both)


def in_several(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the bands that hold several components."""
    component = F.coalesce("component", "doc_id")
    placed = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", component)
    mixed = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return placed.join(mixed.filter("least < most").select("band"), "band")


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(v[begin] for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Set size, component and whether it is kept, for each document.

    Documents are linked if 100 * intersection >= 75 * union of their shingle sets. The
    component is the smallest doc_id reachable over links; the document of that id is kept.
    A text of fewer than SHINGLE words is one shingle; one without words, or a missing one,
    is linked with nothing and kept. Rows that repeat an id are one document; of different
    texts under one id that with the largest set counts. A missing id gives a missing
    component and is kept. Needs ``doc_id`` and ``text``; other columns are ignored.
    """
    rows = texts(docs)
    signed = keep(map_slices(rows, sign, SIGNED), "signed")
    some = signed.filter("n > 0 AND doc_id IS NOT NULL")
    own = keep(some.groupBy("doc_id").agg(F.max(F.struct(*SAME)).alias("own")).select("doc_id", "own.*"), "own")
    first = own.groupBy(*SAME).agg(F.min("doc_id").alias("rep"))
    copies = own.join(first, SAME)
    reps = copies.filter("doc_id = rep").drop("rep").join(some, ["doc_id", *SAME]).dropDuplicates(["doc_id"])
    reps = keep(reps.select("doc_id", *SAME, "bands", "sketch"), "reps")
    banded = reps.select("doc_id", F.posexplode("bands").alias("i", "value")).select(
        "doc_id", "i", F.xxhash64("i", "value").alias("band")
    )
    leads = banded.groupBy("band").agg(F.min("doc_id").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    members = keep(banded.join(leads, "band"), "members")
    star = members.filter("doc_id > lead").groupBy(F.col("doc_id").alias("b")).agg(F.min("lead").alias("a"))
    near = members.select("doc_id").distinct()
    sets = full_sets(reps.select("doc_id", *SAME).join(near, "doc_id"), rows)
    links = keep(confirmed(estimated(star.select("a", "b"), reps), sets), "links")
    apart = in_several(members, components(links))
    whole = reps.select("doc_id", "n", "bands", "sketch").join(apart.select("doc_id").distinct(), "doc_id").join(sets, "doc_id")
    more = keep(across(apart.join(whole, "doc_id")), "links")
    same = copies.filter("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.union(more).union(same))
    component = F.coalesce("component", "doc_id")
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(
        labels.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, all columns as they are.

    Rows that repeat the id that stays are the same document and stay with it.
    """
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(keep(gone, "gone"), F.col("doc_id") == F.col("__gone"), "left_anti")
