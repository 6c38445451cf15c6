"""Shared storage, Arrow batches and word hashes for the operators of this package.

Texts reach Python in Arrow batches and are cut into slices of a few MB, so memory is
bounded by the slice and the longest single text. A missing text counts as empty.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20
#: Distinct keys a counting task holds before it hands its counts on.
HELD = 1 << 20

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a local session gets a folder of its own; a cluster is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="haulmark-"))
    return _own[0]


def ship(spark: SparkSession) -> None:
    """Sends this library to the executors, once for each Spark application.

    Rows reach Python by the thousand, unless the session says otherwise: whole texts make
    Spark's usual batches of ten thousand rows too large for small executors.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, "1000")
    root = Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="haulmark-")) / "haulmark_library.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/haulmark/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_lean(df: DataFrame, name: str) -> DataFrame:
    """As ``keep``; what was shuffled for it leaves the disk once it is written."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        return keep(df, name)
    finally:
        spark.conf.set(_CLEANUP, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` (missing: empty) alone, so that other columns cannot clash."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *more,
    )


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Tells rows apart that share an id, or have none: equal keys are equal rows."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.length(text_col))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes; one longer text stays whole."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    begin = 0
    while begin < len(size):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def map_slices(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, column: str = "text"
) -> DataFrame:
    """``fn`` gets a slice and returns columns for ``schema`` (None: no rows)."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                if (cols := fn(part)) is not None:
                    yield record(cols, arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def record(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [
        c.cast(f.type) if isinstance(c := cols[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Lists of the given lengths over flat values."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def binary_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values that hold ``counts`` items each of a flat array."""
    offsets = np.concatenate(([0], np.cumsum(counts) * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    )


class Tally:
    """Sums counts by key, with a note on each key; what was added is merged when there is much of it."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.held = 0

    def add(self, keys: np.ndarray, note: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, note, n))
        self.size += len(keys)
        if self.size > 2 * max(self.held, HELD // 4):
            self.merge()

    def merge(self) -> None:
        keys, note, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)])
        n = np.add.reduceat(n[order], first) if len(first) else n
        self.parts, self.size, self.held = [(keys[first], note[order[first]], n)], len(first), len(first)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """All sums; the tally is empty then."""
        if not self.size:
            return None
        self.merge()
        out = self.parts[0]
        self.__init__()
        return out


# --- words -------------------------------------------------------------------------------

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _table(separators: set[int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    sep = np.array([b in separators for b in range(256)])
    code = np.array([(b + 32 if lower and 65 <= b <= 90 else b) + 1 for b in range(256)], dtype=_U)
    return sep, code


_SPACE = {0x20, *range(0x09, 0x0E)}
#: Words between single spaces; between white space, A-Z as they are or lower-cased; words of letters, digits and non-ASCII, lower-cased.
SPACED = _table({0x20}, False)
AS_WRITTEN = _table(_SPACE, False)
LOWER = _table(_SPACE, True)
LOWER_ALNUM = _table({b for b in range(128) if not chr(b).isalnum()}, True)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n + n // 4, base, dtype=_U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Words:
    """Words of several texts: 64-bit hashes, byte positions, and the words of each text.

    ``docs[i]:docs[i + 1]`` are the words of text i; ``data`` are the joined bytes that
    ``start`` and ``end`` point into.
    """

    def __init__(
        self, column: pa.Array, kind: tuple[np.ndarray, np.ndarray], cuts: Callable[[np.ndarray], np.ndarray] | None = None
    ):
        """``cuts`` gives places inside words at which they are cut as well."""
        sep, code = kind
        n = len(column)
        size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data = b" " + b" ".join(column.cast(pa.binary()).to_pylist()) + b" "
        raw = np.frombuffer(self.data, dtype=np.uint8)
        gap = np.frombuffer(self.data.translate(sep.tobytes()), np.uint8)
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        if cuts is not None:
            self.cuts = cuts(raw)
            self.start, self.end = (np.sort(np.concatenate((x, self.cuts)), kind="stable") for x in (self.start, self.end))
        power, inverse = powers(len(raw))
        total = code.take(raw)
        total *= power
        np.cumsum(total, out=total)
        h = (total[self.end - 1] - total[self.start - 1]) * inverse[self.start]
        self.hash = mix(h ^ ((self.end - self.start).astype(_U) << _U(48)))
        begin = np.cumsum(size + 1) - size
        self.bytes_from = np.append(begin, len(raw))
        # a space stands before, between and after the texts
        self.docs = np.append(np.searchsorted(self.start, begin), len(self.start)).astype(np.int64)
        self.counts = np.diff(self.docs) if n else np.zeros(0, np.int64)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one text, and the word each begins at."""
        return runs(self.hash, self.docs, self.counts, k)


def runs(hashes: np.ndarray, docs: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    power, inverse = powers(n + 1)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(hashes * power[:n], dtype=_U)))
    last = np.repeat(docs[1:], counts)
    at = np.flatnonzero(np.arange(n) + k <= last)
    return mix((total[at + k] - total[at]) * inverse[at]), at
