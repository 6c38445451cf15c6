"""Token ids of a corpus in files of range-coded blocks, and back.

Documents are sorted by id over the cluster; each partition encodes its texts and writes one
file. A file holds segments of blocks (see ``range_coder``), then the table of its documents
(id and number of ids) and a trailer that tells where the table begins. Every block and the
table carry a checksum. Files are written under a name of their own and then moved, so a
task that runs twice leaves one file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.llm import range_coder
from haulmark.llm.common import arrow_schema, keep, new_folder, record, slices, texts
from haulmark.llm.encoding import encoder

MAGIC = b"HMTOK02\n"
SEGMENT_IDS = range_coder.BLOCK * range_coder.LANES

MANIFEST = "part int, path string, docs long, ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_HEAD, _BLOCK, _TRAILER = struct.Struct("<I"), struct.Struct("<III"), struct.Struct("<QQII8s")


class BadFile(ValueError):
    """A file that is cut short or fails a checksum."""


class FileWriter:
    """Collects ids and writes whole segments; ``close`` adds the table of documents."""

    def __init__(self, out: BinaryIO):
        self.out, self.held, self.n_held, self.at, self.ids = out, [], 0, 0, 0
        self.doc_ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.sizes.append(sizes)
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        while self.n_held >= SEGMENT_IDS:
            self._segment(SEGMENT_IDS)

    def _segment(self, n: int) -> None:
        ids = np.concatenate(self.held)
        blocks = range_coder.encode(ids[:n])
        self._write(_HEAD.pack(len(blocks)))
        self._write(b"".join(_BLOCK.pack(size, crc, len(code)) for size, crc, code in blocks))
        for _, _, code in blocks:
            self._write(code)
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> int:
        """Writes what is left and gives the number of documents."""
        if self.n_held:
            self._segment(self.n_held)
        self._write(_HEAD.pack(0))
        docs = pa.chunked_array(self.doc_ids, pa.int64())
        known = np.concatenate([d.is_valid().to_numpy(zero_copy_only=False) for d in self.doc_ids]).astype(np.uint8)
        ids = docs.fill_null(0).to_numpy().astype("<i8")
        sizes = np.concatenate(self.sizes).astype("<i8")
        table = zlib.compress(known.tobytes() + ids.tobytes() + sizes.tobytes(), 1)
        begin = self.at
        self._write(table)
        self._write(_TRAILER.pack(begin, len(ids), len(table), zlib.crc32(table), MAGIC))
        return len(ids)


def read_table(file: pa.NativeFile) -> tuple[pa.Array, np.ndarray]:
    """Ids of the documents of a file and how many token ids each has."""
    end = file.size() - _TRAILER.size
    file.seek(max(0, end))
    begin, n, size, crc, magic = _TRAILER.unpack(file.read(_TRAILER.size))
    file.seek(begin)
    table = file.read(size)
    if magic != MAGIC or zlib.crc32(table) != crc:
        raise BadFile("the table of documents is damaged")
    raw = zlib.decompress(table)
    known = np.frombuffer(raw, np.uint8, n)
    ids, sizes = np.frombuffer(raw, "<i8", n, n), np.frombuffer(raw, "<i8", n, 9 * n)
    return pa.array(ids, mask=known == 0), sizes


def read_segments(file: pa.NativeFile) -> Iterator[np.ndarray]:
    """The ids of a file, a segment at a time."""
    file.seek(0)
    if file.read(len(MAGIC)) != MAGIC:
        raise BadFile("not a token file")
    while n := _HEAD.unpack(file.read(_HEAD.size))[0]:
        heads = list(_BLOCK.iter_unpack(file.read(n * _BLOCK.size)))
        yield range_coder.decode([(size, crc, file.read(length)) for size, crc, length in heads])


def write_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Writes all texts, ascending by doc_id, and returns the files with their part number.

    ``docs`` has ``doc_id`` and ``text``; a missing text is empty, missing ids come first
    and equal ids follow each other. An empty table gives no file. ``parts`` is the number
    of ranges of ids, the shuffle partitions of the session if not given.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/part-{part:06d}.tok"
        own, writer = f"{name}.{context.taskAttemptId()}", None
        for batch in batches:
            for rows in slices(batch):
                if not rows.num_rows:
                    continue
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(own, compression=None)
                    writer = FileWriter(out)
                ids, upto = encoder(tokenizer).encode(rows.column("text"), last=end_id)
                writer.add(rows.column("doc_id"), ids, np.diff(upto))
        if writer is not None:
            count = writer.close()
            out.close()
            fs.move(own, name)
            yield record({"part": [part], "path": [name], "docs": [count], "ids": [writer.ids]}, schema)

    ordered = texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return keep(ordered.mapInArrow(write, MANIFEST), "token-files")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """Each document of the files: ids before it, how many it has, and their CRC-32.

    ``files`` is what ``write_files`` returns; only its sums, a row a file, meet in one task.
    """
    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    schema = arrow_schema(DOCS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for path, base in ((r["path"], r["before"]) for b in batches for r in b.to_pylist()):
            with fs.open_input_file(path) as file:
                doc_ids, sizes = read_table(file)
                ends = np.cumsum(sizes)
                crc = checksums(read_segments(file), ends)
                yield record(
                    {"doc_id": doc_ids, "start": base + ends - sizes, "n_tokens": sizes, "ids_crc32": crc}, schema
                )

    tasks = max(1, 2 * files.count())
    return files.withColumn("before", before).repartition(tasks, "path").mapInArrow(read, DOCS)


def checksums(segments: Iterator[np.ndarray], ends: np.ndarray) -> list[int]:
    """CRC-32 of the ids up to each end, over segments that may cut a document."""
    out: list[int] = []
    crc, base, bounds, n = 0, 0, ends.tolist(), 0
    for ids in segments:
        raw, at = memoryview(ids.astype("<u4").tobytes()), 0
        while n < len(bounds) and bounds[n] <= base + len(ids):
            end = bounds[n] - base
            out.append(zlib.crc32(raw[4 * at : 4 * end], crc))
            crc, at, n = 0, end, n + 1
        crc = zlib.crc32(raw[4 * at :], crc)
        base += len(ids)
    if n != len(bounds):
        raise BadFile("the file holds fewer ids than its table says")
    return out


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of all texts to new files in the shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_files(write_files(docs, tokenizer, folder, end_id), folder)
