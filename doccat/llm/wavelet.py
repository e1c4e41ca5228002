"""Token-id shards as wavelet matrices.

``WaveletMatrix`` keeps a sequence of ids as one bit-plane per id bit, top bit first; each plane
stably sorts the sequence by that bit for the next one.  Rank counts per 512-bit block and binary
search for select give access, counting and occurrence lookup without the ids themselves.

File format, all integers little-endian: 8 bytes magic, u32 header length, header JSON (ids, planes,
documents, zeros per plane, section lengths), then zstandard frames: document ends (u64), and per
plane its packed bits.  Rank blocks are rebuilt from the bits when first asked for.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import shared_path, text_or_empty
from doccat.llm.tokens import char_batches, encoder

MAGIC = b"WMTOK001"
BLOCK = 512
#: A shard file is closed at the first document end beyond so many ids.
SHARD_IDS = 4_000_000


class Plane:
    """Packed bits with rank and select."""

    def __init__(self, packed: np.ndarray, n: int):
        self.packed, self.n = packed, n

    @cached_property
    def blocks(self) -> np.ndarray:
        """Ones before each block; writing and decoding a whole shard need none."""
        pad = np.zeros(-len(self.packed) % (BLOCK // 8), dtype=np.uint8)
        per_block = np.bitwise_count(np.concatenate([self.packed, pad])).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(per_block)])

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3] >> (7 - (i & 7)) & 1)

    def rank1(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        b = i // BLOCK
        lo = b * BLOCK // 8
        ones = int(self.blocks[b]) + int(np.bitwise_count(self.packed[lo:i >> 3]).sum())
        return ones + (int(self.packed[i >> 3] >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) such bit."""
        ends = self.blocks if bit else np.minimum(np.arange(len(self.blocks)) * BLOCK, self.n) - self.blocks
        b = int(np.searchsorted(ends, k, side="right")) - 1
        part = np.unpackbits(self.packed[b * BLOCK // 8:(b + 1) * BLOCK // 8])[:self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(part == bit)[k - int(ends[b])])


class WaveletMatrix:
    def __init__(self, planes: list[Plane], zeros: list[int], n: int, ends: np.ndarray):
        self.planes, self.zeros, self.n, self.ends = planes, zeros, n, ends

    @classmethod
    def build(cls, ids: np.ndarray, ends: np.ndarray, bits: int) -> "WaveletMatrix":
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (ids >> b & 1).astype(bool)
            planes.append(Plane(np.packbits(one), len(ids)))
            zeros.append(len(ids) - int(np.count_nonzero(one)))
            placed = np.empty_like(ids)
            np.compress(~one, ids, out=placed[:zeros[-1]])
            np.compress(one, ids, out=placed[zeros[-1]:])
            ids = placed
        return cls(planes, zeros, len(ids), np.asarray(ends, dtype="<u8"))

    def access(self, i: int) -> int:
        value = 0
        for plane, z in zip(self.planes, self.zeros):
            bit = plane.bit(i)
            value = value << 1 | bit
            i = z + plane.rank1(i) if bit else i - plane.rank1(i)
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        top = len(self.planes) - 1
        for k, (plane, z) in enumerate(zip(self.planes, self.zeros)):
            bit = value >> (top - k) & 1
            lo, hi = z * bit + plane.rank(bit, lo), z * bit + plane.rank(bit, hi)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among places ``lo`` to ``hi`` (exclusive)."""
        if value >> len(self.planes):
            return 0
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, value: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i, top = self._range(value, 0, 0)[0] + k, len(self.planes) - 1
        for level in range(top, -1, -1):
            bit = value >> (top - level) & 1
            i = self.planes[level].select(bit, i - self.zeros[level] * bit)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: the stable sorts undone from the last plane to the first."""
        ids = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            one = np.unpackbits(plane.packed, count=self.n).astype(bool)
            back = np.empty_like(ids)
            back[np.flatnonzero(~one)] = ids[:z]
            back[np.flatnonzero(one)] = ids[z:] | ids.dtype.type(1 << b)
            ids = back
        return ids

    def to_bytes(self, header: dict) -> bytes:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        parts = [z.compress(self.ends.tobytes()), *(z.compress(p.packed.tobytes()) for p in self.planes)]
        head = json.dumps(header | {"n": self.n, "docs": len(self.ends), "zeros": self.zeros,
                                    "sections": [len(p) for p in parts]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["WaveletMatrix", dict]:
        import zstandard

        if data[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        (size,) = struct.unpack_from("<I", data, 8)
        head, at, parts = json.loads(data[12:12 + size]), 12 + size, []
        z = zstandard.ZstdDecompressor()
        for n in head["sections"]:
            parts.append(np.frombuffer(z.decompress(data[at:at + n]), dtype=np.uint8))
            at += n
        return cls([Plane(p, head["n"]) for p in parts[1:]], head["zeros"], head["n"], parts[0].view("<u8")), head


def _save(folder: str, name: str, data: bytes) -> None:
    """Write under a name of this attempt, then rename: a retried task leaves one whole file."""
    import uuid

    from pyarrow import fs as pafs

    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    store, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://"))
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, kind: str = "word", end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> list[tuple]:
    """Encode every text, append ``end_id``, and write shard files in ascending id order to ``folder``.

    Returns (file name, documents, ids) of each file in order: one small row per file.  Null ids
    come first, null and empty texts give the end id alone, repeated ids keep one entry per row
    (ordered by text hash, then input place, so a repeated id is still dealt to many tasks).
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, kind)
        bits = max(1, int(enc.tokenizer.get_vocab_size() - 1).bit_length())
        end = np.array([end_id], dtype=enc.dtype)
        part, files = TaskContext.get().partitionId(), 0
        keys, ids, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal files, held
            ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
            name = f"shard-{part:07d}-{files:05d}.wm"
            data = WaveletMatrix.build(np.concatenate(ids), ends, bits).to_bytes({"keys": keys})
            _save(folder, name, data)
            row = pa.record_batch([[name], pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64())],
                                  names=["file", "docs", "n"])
            files, held = files + 1, 0
            keys.clear()
            ids.clear()
            return row

        for batch in batches:
            got, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for piece in char_batches(texts):
                for key, x in zip(got[piece], enc.encode(texts[piece])):
                    keys.append(key)
                    ids.append(np.concatenate([x, end]))
                    held += len(ids[-1])
                    if held >= shard_ids:
                        yield close()
        if ids:
            yield close()

    lean = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    placed = lean.repartitionByRange("doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "text")
    return sorted(tuple(r) for r in placed.mapInArrow(run, "file string, docs long, n long").collect())


def read_shards(spark, folder: str, files: list[tuple], key_type: str = "bigint") -> DataFrame:
    """Per document, from the files: ``doc_id, start`` (ids of all documents before), ``n_tokens, ids``
    (little-endian unsigned 32-bit integers)."""
    starts, at = {}, 0
    for name, _, n in files:
        starts[name], at = at, at + n
    known = spark.createDataFrame(list(starts.items()), "file string, base long")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder) if files else \
        spark.createDataFrame([], "path string, content binary")
    found = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(F.broadcast(known), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, base in zip(batch.column("content"), batch.column("base").to_pylist()):
                wm, head = WaveletMatrix.from_bytes(data.as_py())
                ids = wm.decode().astype("<u4")
                ends = wm.ends.astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                for lo in range(0, len(ends), 2048):
                    b, e = begins[lo:lo + 2048], ends[lo:lo + 2048]
                    yield pa.record_batch([pa.array(head["keys"][lo:lo + 2048], type=arrow_key), pa.array(b + base), pa.array(e - b),
                                           pa.array([ids[x:y].tobytes() for x, y in zip(b, e)], pa.binary())],
                                          names=["doc_id", "start", "n_tokens", "ids"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow_key = to_arrow_type(_parse_datatype_string(key_type))
    return found.mapInArrow(run, f"doc_id {key_type}, start long, n_tokens long, ids binary")


def token_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", **options) -> DataFrame:
    """Write the shards of ``docs`` to a fresh shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "wavelet")
    files = write_shards(docs, folder, tokenizer_path, id_col=id_col, **options)
    return read_shards(spark, folder, files, docs.schema[id_col].dataType.simpleString())
