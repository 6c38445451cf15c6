"""WARC archives: one gzip member for each record, read back in sequence.

Equal payloads are stored once: the page with the smallest id holds the response, the
others are revisits that name it. Archives are written by the tasks that hold the pages,
under a name of their own and then moved, so a task that runs twice leaves one file. The
reader inflates member by member, frames records by their content length and verifies
every digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import arrow_schema, keep, new_folder, record

#: Shorter payloads are never stored as revisits.
REVISIT_BYTES = 100
READ_BYTES = 1 << 16
BATCH_BYTES = 4 << 20

MANIFEST = "path string, records long"
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary"
)


class BadRecord(ValueError):
    """An archive that breaks the framing, or a record that fails its digest."""


# --- one record --------------------------------------------------------------------------


def member(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """The gzip member of a response, or of a revisit that leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["X-Refers-To-Page-Id"] = str(refers_to)
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    data = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def members(file: BinaryIO) -> Iterator[bytes]:
    """The inflated gzip members of an archive, in order."""
    rest = b""
    while True:
        rest = rest or file.read(READ_BYTES)
        if not rest:
            return
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := file.read(READ_BYTES)):
                raise BadRecord("the archive ends inside a record")
            out.append(inflate.decompress(rest))
            rest = inflate.unused_data if inflate.eof else b""
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Headers and payload of one record; its length and digests must hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or not version.startswith(b"WARC/"):
        raise BadRecord("no WARC header")
    fields = dict(line.split(": ", 1) for line in lines.decode().split("\r\n"))
    size = int(fields["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise BadRecord("the content length does not frame the record")
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadRecord("the block fails its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise BadRecord("the payload fails its digest")
    declared = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
        "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": fields["WARC-Type"],
        "refers_to": int(fields["X-Refers-To-Page-Id"]) if revisit else None,
        "payload_digest": digest,
        "payload_bytes": int(declared["Content-Length"]),
        "payload": None if revisit else payload,
    }


# --- tables ------------------------------------------------------------------------------


def with_revisits(pages: DataFrame) -> DataFrame:
    """Digest, record type and the page referred to; only digests move to be counted."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.length("payload") >= REVISIT_BYTES
    first = (
        rows.filter(large)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    again = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id",
        "url",
        "payload",
        "payload_digest",
        F.when(again, F.col("first")).alias("refers_to"),
        again.alias("revisit"),
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages as archives below a folder all executors share; returns their paths.

    ``pages`` needs ``page_id``, ``url`` and ``html``; a missing html is an empty payload,
    missing ids and urls are left out of the header. Rows that repeat the smallest page id
    of their payload are responses too. An empty table gives no archive.
    """
    schema = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():06d}.warc.gz"
        own, out, count = f"{name}.{context.taskAttemptId()}", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(own, compression=None)
                out.write(
                    member(
                        row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"],
                        row["revisit"],
                    )
                )
                count += 1
        if out is not None:
            out.close()
            fs.move(own, name)
            yield record({"path": [name], "records": [count]}, schema)

    return keep(with_revisits(pages).mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives at ``path``, each archive read by one task.

    ``payload`` is missing for revisits, and for all records without ``payloads``.
    """
    schema = arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        rows, size = [], 0
        for path, records in ((r["path"], r["records"]) for b in batches for r in b.to_pylist()):
            count = 0
            with fs.open_input_stream(path, compression=None) as file:
                for data in members(file):
                    row = parse(data)
                    count += 1
                    size += row["payload_bytes"] if payloads else 100
                    rows.append(row if payloads else row | {"payload": None})
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
            if count != records:
                raise BadRecord(f"{path} holds {count} records, {records} were written")
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = max(1, 2 * archives.count())
    return archives.repartition(tasks, "path").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to new archives in the shared folder and reads their headers back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder, payloads=False).drop("payload")
