"""WARC archives through a chunked record table.

A payload travels as rows (record, chunk number, bytes), each with the bytes and SHA-1 of the payload so
far, so neither the writer nor the reader ever holds a whole record: the writer compresses one chunk at a
time into the record's gzip member, the reader inflates and emits one chunk at a time.  The last row of a
record carries the digest of its whole payload and is checked against the one in the record's header.

Copies are found on digests alone, before any payload moves: the row of largest id is the response, the
others are revisits without payload.  A group's members are dealt over ``SALTS`` keys when they look up
their response, so a payload that a third of all rows share does not meet in one task.

Files carry a name of their own attempt; the manifest, written by Spark, lists those of the attempts that
counted, and only these are read back.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import materialize, shared_path

CHUNK_BYTES = 1 << 20
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
SALTS = 32
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = pa.schema([("uid", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("seen_bytes", pa.int64()),
                     ("seen_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_READ = pa.schema([("id", pa.string()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                   ("chunk_no", pa.int64()), ("data", pa.binary()), ("seen_bytes", pa.int64()), ("seen_digest", pa.string()),
                   ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def chunked(records: DataFrame, payload_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table: one row per chunk of a record's binary payload, with the record's other columns."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
    from pyspark.sql.types import StructType

    others = [c for c in records.columns if c != payload_col]
    kept = records.select(*others).schema
    out = StructType([*kept.fields, *from_arrow_schema(_CHUNKS).fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            payloads, rest = batch.column(batch.num_columns - 1), pa.Table.from_batches([batch]).select(others)
            rows, source, held = [], [], 0

            def emit() -> pa.RecordBatch:
                cols = [*rest.take(pa.array(source, pa.int64())).combine_chunks().columns]
                made = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), _CHUNKS)]
                flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
                rows.clear()
                source.clear()
                return pa.record_batch([*[c.cast(f.type) for c, f in zip(flat, schema)], *made], schema=schema)

            for i, value in enumerate(payloads):
                data = memoryview(value.as_buffer())  # no copy of the payload
                seen, sums = hashlib.sha1(), []
                for lo in range(0, max(len(data), 1), chunk_bytes):
                    seen.update(data[lo:lo + chunk_bytes])
                    sums.append(base32(seen))
                for k, digest in enumerate(sums):
                    part = data[k * chunk_bytes:(k + 1) * chunk_bytes]
                    rows.append((uid, k, bytes(part), k * chunk_bytes + len(part), digest, len(data), sums[-1]))
                    source.append(i)
                    held += len(part)
                    if held >= BATCH_BYTES:
                        yield emit()
                        held = 0
                uid += 1
            if rows:
                yield emit()

    return records.select(*others, payload_col).mapInArrow(run, out)


def revisits(keys: DataFrame, least_bytes: int) -> DataFrame:
    """``(id, key, refers_to)`` of the records whose payload a record of larger id has too; ``keys`` holds
    ``id, key, n``: the payload's SHA-256 and size.  A null id refers to any id; it is referred to by none."""
    groups = keys.filter(F.col("n") >= least_bytes).groupBy("key").agg(
        F.max("id").alias("refers_to"), F.min("id").alias("least"), F.count("*").alias("c"), F.count("id").alias("named"))
    copies = groups.filter("least < refers_to OR (named > 0 AND named < c)").select(
        "key", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = keys.select("id", "key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    return dealt.join(copies, ["key", "salt"]).filter("id IS NULL OR id < refers_to").groupBy("id", "key").agg(
        F.max("refers_to").alias("refers_to"))


def _store(folder: str):
    from pyarrow import fs as pafs

    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))


def _urn(key: str | None, digest: str) -> str:
    return f"<urn:record:{quote(key or '', safe='')}:{digest}>"


def _head(key, uri, refers_to, digest: str, size: int) -> bytes:
    """Record header and HTTP header; a revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else "urn:unknown"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(key, digest)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (size if refers_to is None else 0)}", "", ""]
    return "\r\n".join(lines).encode() + http


def write_warc(records: DataFrame, folder: str, id_col: str, payload_col: str, uri_col: str | None = None, least_bytes: int = 0,
               chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row to gzip-compressed WARC files in ``folder``; returns the manifest
    ``(file, records, bytes)``, a written table.

    The payload is the UTF-8 (or binary) of ``payload_col``; null is an empty one.  Of records with equal
    payloads of ``least_bytes`` or more that of largest id is the response and the others revisit it.  Rows
    that repeat id and payload repeat the record (all are responses, or all revisits); rows with a null id
    are revisits where a named one has their payload, else responses.  An empty table gives an empty
    manifest.  Only the named columns are read, so others cannot clash.
    """
    from pyspark import TaskContext

    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    lean = records.select(F.col(id_col).alias("id"), (F.col(uri_col) if uri_col else F.lit(None)).cast("string").alias("uri"),
                          F.sha2(payload, 256).alias("key"), payload.alias("payload"))
    again = revisits(lean.select("id", "key", F.octet_length("payload").alias("n")), least_bytes)
    rows = chunked(lean, "payload", chunk_bytes).alias("c").join(
        again.alias("a"), F.expr("c.id <=> a.id AND c.key = a.key"), "left").select(
        F.col("c.uid"), "chunk_no", F.col("c.id").cast("string").alias("id"), "uri", F.col("refers_to").cast("string").alias("refers_to"),
        "seen_bytes", "seen_digest", "payload_bytes", "payload_digest", "data")
    rows = rows.sortWithinPartitions("uid", "chunk_no")  # all chunks of a record are in one partition: they share id and key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name, out, written, count = "", None, 0, 0
        pack = check = None

        def close() -> pa.RecordBatch:
            nonlocal out
            out.close()
            out = None
            return pa.record_batch([pa.array([name]), pa.array([count], pa.int64()), pa.array([written], pa.int64())],
                                   names=["file", "records", "bytes"])

        def put(data: bytes) -> None:
            nonlocal written
            out.write(data)
            written += len(data)

        try:
            for batch in batches:
                cols = batch.to_pydict()
                for no, key, uri, refers, seen, digest, size, whole, data in zip(*[cols[c] for c in batch.schema.names[1:]]):
                    if no == 0:
                        if out is None:
                            name = f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc.gz"
                            out, written, count = store.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                        pack, check = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                        put(pack.compress(_head(key, uri, refers, whole, size)))
                    check.update(data)
                    if base32(check) != digest:
                        raise ValueError(f"chunk {no} of record {key} is not the one that follows")
                    if refers is None:
                        put(pack.compress(data))
                    if seen == size:
                        put(pack.compress(b"\r\n\r\n") + pack.flush())
                        count += 1
                        if written >= file_bytes:
                            yield close()
            if out is not None:
                yield close()
        finally:
            if out is not None:
                out.close()

    return materialize(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


class _Inflated:
    """The bytes of a stream of gzip members, read in pieces."""

    def __init__(self, stream, piece: int = 1 << 16):
        self.stream, self.piece, self.buffer, self.member = stream, piece, bytearray(), None

    def _more(self) -> bool:
        raw = self.member.unused_data if self.member is not None and self.member.eof else b""
        if self.member is not None and self.member.unconsumed_tail:
            raw = self.member.unconsumed_tail
        raw = raw or self.stream.read(self.piece)
        if not raw:
            if self.member is not None and not self.member.eof:
                raise ValueError("archive ends inside a record")
            return False
        if self.member is None or self.member.eof:
            self.member = zlib.decompressobj(31)
        self.buffer += self.member.decompress(raw, self.piece)
        return True

    def line(self) -> bytes | None:
        while (end := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                if self.buffer:
                    raise ValueError("archive ends inside a record")
                return None
        got = bytes(self.buffer[:end])
        del self.buffer[:end + 2]
        return got

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        got = bytes(self.buffer[:n])
        del self.buffer[:n]
        return got


def _fields(source: _Inflated) -> tuple[dict[str, str], int]:
    found, size = {}, 0
    while (line := source.line()) is not None:
        size += len(line) + 2
        if not line:
            return found, size
        name, _, value = line.decode().partition(":")
        found[name.lower()] = value.strip()
    raise ValueError("archive ends inside a record")


def _key(urn: str | None) -> str | None:
    return unquote(urn.split(":")[2]) or None if urn else None


def records_in(stream, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """Rows of the chunk table of one archive, in order; without data, the last row of each record alone."""
    source = _Inflated(stream)
    while (version := source.line()) is not None:
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head, _ = _fields(source)
        http, used = _fields(source)  # the status line is read as a field without value
        left, seen, sha1, no = int(head["content-length"]) - used, 0, hashlib.sha1(), 0
        declared, size = head["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
        lead = (_key(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], _key(head.get("warc-refers-to")))
        while True:
            data = source.read(min(chunk_bytes, left))
            left, seen = left - len(data), seen + len(data)
            sha1.update(data)
            last = left == 0
            if last and head["warc-type"] == "response" and (seen != size or base32(sha1) != declared):
                raise ValueError(f"payload of record {lead[0]} does not have the digest of its header")
            if with_data or last:
                yield *lead, no, data if with_data else None, seen, base32(sha1), last, size, declared
            no += 1
            if last:
                break
        if source.read(4) != b"\r\n\r\n":
            raise ValueError("record is longer than its header says")


def read_warc(manifest: DataFrame, folder: str, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives that ``manifest`` lists: ``id, target_uri, record_type, refers_to,
    chunk_no, data, seen_bytes, seen_digest, last, payload_bytes, payload_digest`` (both of the whole
    payload; ids as text).  A damaged archive raises.  Without data, one row per record."""
    tasks = max(1, min(manifest.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for row in records_in(stream, chunk_bytes, with_data):
                        rows.append(row)
                        held += len(row[5] or b"") + 256
                        if held >= BATCH_BYTES:
                            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
                            rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

    from pyspark.sql.pandas.types import from_arrow_schema

    return manifest.select("file").repartition(tasks).mapInArrow(run, from_arrow_schema(_READ))


def archive(records: DataFrame, id_col: str, payload_col: str, uri_col: str | None = None, with_data: bool = False, **options) -> DataFrame:
    """Write the archives of ``records`` to a fresh shared folder and read them back."""
    folder = shared_path(records.sparkSession, "warc")
    return read_warc(write_warc(records, folder, id_col, payload_col, uri_col, **options), folder, with_data)
