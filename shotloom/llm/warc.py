"""Web archives written and read as tables of record chunks.

A payload is never copied whole from the row it comes in: it is cut into rows of a
record identifier and a chunk number with the digest of the payload so far, which
a task appends to its archive one after the other, and archives are read back into
such rows. What is known of other payloads meets a record by digest alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.session import broadcast_if_small, cut, fresh_dir

CHUNK_BYTES = 256 * 1024
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 128 * 1024 * 1024
#: Digests of repeated payloads that are broadcast at most; more meet the records by a shuffle.
DIGESTS_AT_ONCE = 500_000
#: Bytes of chunks in a batch.
BATCH_BYTES = 1 << 22
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNKS = "record_id long, record_type string, refers_to long, target string, declared_digest string, chunk_no long, chunk binary, payload_bytes long, payload_digest string, last boolean, archive string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Spark-style URI."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(record_id, target, payload, payload_bytes, digest, refers_to): refers_to names the first record of an equal payload.

    Of equal payloads of at least ``min_bytes`` the smallest id keeps its payload
    and the others refer to it; rows that repeat that id keep theirs too. A null
    payload is empty; a null id never is the first while another id is there.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("target"), F.encode(F.coalesce(payload_col, F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    large = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.unhex("digest").alias("d")).agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = broadcast_if_small(cut(large.where("n > 1").select("d", "first")), DIGESTS_AT_ONCE)
    joined = rows.join(again, F.unhex("digest") == F.col("d"), "left")
    refers = F.when(~F.col("record_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("record_id", "target", "payload", "payload_bytes", "digest", refers.alias("refers_to"))


_PIECES = "record_id long, target string, refers_to long, payload_bytes long, digest string, chunks int, chunk_no int, chunk binary, seen_bytes long, seen_digest string"


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The payload as rows (record_id, ..., chunk_no, chunks, chunk, seen_bytes, seen_digest).

    seen_bytes and seen_digest are those of the payload up to and with this chunk.
    Records that refer to another, and empty ones, have one empty chunk. Chunks are
    slices of the row's own buffer and leave in batches of bounded size.
    """
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for *record, payload in zip(*(batch.column(k) for k in range(6)), strict=True):
                head = [x.as_py() for x in record]
                data = memoryview(payload.as_buffer() if head[2] is None else b"")
                chunks, digest = max(1, -(-len(data) // chunk_bytes)), hashlib.sha256()
                for number in range(chunks):
                    chunk = data[number * chunk_bytes : (number + 1) * chunk_bytes]
                    digest.update(chunk)
                    held.append((*head, chunks, number, bytes(chunk), number * chunk_bytes + len(chunk), digest.hexdigest()))
                    size += 300 + len(chunk)
                    if size > BATCH_BYTES:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return records.select("record_id", "target", "refers_to", "payload_bytes", "digest", "payload").mapInArrow(run, _PIECES)


def _header(record_id: int | None, target: str | None, refers_to: int | None, size: int, digest: str, date: str) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:x-record:{'' if record_id is None else record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(_HTTP) + (size if refers_to is None else 0)}",
    ]
    if target is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", target))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-record:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    return "\r\n".join([*lines, "", ""]).encode()


def write_archives(chunks: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the chunk rows of each partition to gzip-per-record archives in ``folder``.

    Chunks of a record must follow each other in their partition; a stored payload
    that its digest does not fit is an error. Returns the written archives
    (archive, records, bytes), computed once. A task that is run again writes files
    of new names; only those of the listed rows count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        sink, name, records, size, squeeze = None, "", 0, 0, None

        def done() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(k) for k in range(9)]
            for k in range(batch.num_rows):
                record_id, target, refers_to, length, digest, last, at, chunk, seen = (c[k].as_py() for c in columns)
                if at == last - 1 and refers_to is None and seen != digest:
                    raise ValueError(f"the chunks of record {record_id} are not its payload")
                data = b""
                if at == 0:
                    if sink is None:
                        name, records, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink = system.open_output_stream(f"{base}/{name}", compression=None)
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = squeeze.compress(_header(record_id, target, refers_to, length, digest, date) + _HTTP)
                data += squeeze.compress(chunk)
                if at == last - 1:
                    data += squeeze.compress(b"\r\n\r\n") + squeeze.flush()
                    records += 1
                sink.write(data)
                size += len(data)
                if at == last - 1 and size >= archive_bytes:
                    yield done()
                    sink = None
        if sink is not None:
            yield done()

    ordered = chunks.select("record_id", "target", "refers_to", "payload_bytes", "digest", "chunks", "chunk_no", "chunk", "seen_digest")
    return cut(ordered.mapInArrow(run, "archive string, records long, bytes long"))


class _Source:
    """Bytes of a gzip-per-record file, read in bounded pieces."""

    def __init__(self, stream: object, step: int) -> None:
        self.stream, self.step, self.raw, self.buffer = stream, step, b"", b""
        self.gunzip = zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.step)
            if not self.raw:
                return False
            if self.gunzip.eof:
                self.gunzip = zlib.decompressobj(31)
            data = self.gunzip.decompress(self.raw, self.step)
            self.raw = self.gunzip.unused_data if self.gunzip.eof else self.gunzip.unconsumed_tail
            if data:
                self.buffer += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.buffer:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("an archive ends inside a record")
                return None
        got, _, self.buffer = self.buffer.partition(mark)
        return got

    def take(self, most: int) -> bytes:
        if not self.buffer and not self.more():
            raise ValueError("an archive ends inside a record")
        got, self.buffer = self.buffer[:most], self.buffer[most:]
        return got


def _number(uri: str) -> int | None:
    found = re.search(r"(-?\d+)>?$", uri)
    return int(found[1]) if found else None


def read_chunks(archives: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Rows of all records of the listed archives, cut into chunks of at most ``chunk_bytes``.

    payload_bytes and payload_digest are those of the payload up to and with this
    row's chunk; a record's last row (``last``) has them for all of it. ``chunk``
    is null unless data is asked for, and then only the last row is given. A
    broken archive is an error.
    """

    def records(path: str) -> Iterator[dict]:
        system, at = _open(path)
        with system.open_input_stream(at, compression=None) as stream:
            source = _Source(stream, chunk_bytes)
            while (head := source.until(b"\r\n\r\n")) is not None:
                fields = dict(line.split(": ", 1) for line in head.decode().strip("\r\n").split("\r\n")[1:])
                left = int(fields["Content-Length"]) - len(source.until(b"\r\n\r\n")) - 4
                digest, size, number = hashlib.sha256(), 0, 0
                row = {"record_id": _number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": _number(fields.get("WARC-Refers-To", "")), "target": fields.get("WARC-Target-URI"), "declared_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "archive": path}
                while True:
                    parts, want = [], min(left, chunk_bytes)
                    while want:
                        parts.append(source.take(want))
                        want -= len(parts[-1])
                    chunk = b"".join(parts)
                    left -= len(chunk)
                    size += len(chunk)
                    digest.update(chunk)
                    if with_data or not left:
                        yield row | {"chunk_no": number, "chunk": chunk if with_data else None, "payload_bytes": size, "payload_digest": digest.hexdigest(), "last": not left}
                    number += 1
                    if not left:
                        break
                if source.until(b"\r\n\r\n"):
                    raise ValueError("a record is longer than its length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in records(path):
                    held.append(row)
                    size += 300 + len(row["chunk"] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=kinds)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)

    kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in _CHUNKS.split(", "))])
    # A number of partitions keeps Spark from joining these few small rows, each a whole archive, into one task.
    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(run, _CHUNKS)


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, payload_bytes, payload_digest, record_type, refers_to) of records read back; revisits take the figures of what they refer to."""
    read = cut(records.where("last").select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "declared_digest"))
    stored = read.where("record_type = 'response'").groupBy(F.col("record_id").alias("stored_id"), F.col("payload_digest").alias("stored_digest")).agg(F.max("payload_bytes").alias("stored_bytes"))
    joined = read.join(cut(stored), (F.col("refers_to") == F.col("stored_id")) & (F.col("declared_digest") == F.col("stored_digest")), "left")
    own = F.col("record_type") == "response"
    return joined.select("record_id", F.when(own, F.col("payload_bytes")).otherwise(F.col("stored_bytes")).alias("payload_bytes"), F.when(own, F.col("payload_digest")).otherwise(F.col("stored_digest")).alias("payload_digest"), "record_type", "refers_to")


def archive_pages(pages: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES, **columns: str) -> DataFrame:
    """Write a record for each page and list the archives; ``folder`` is one of its own in the shared folder unless given."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")
    return write_archives(chunk_rows(plan_records(pages, **columns), chunk_bytes), folder)
