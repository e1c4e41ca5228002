"""Packing by minimum bin slack.

Each document becomes its token ids plus an end id.  Whole windows are cut from its front; what is
left (shorter than a window) joins a buffer, held as counts by remaining length.  For each window a
bitset subset-sum dynamic programme over those counts picks the multiset of lengths that fills it
closest to its capacity, and is backtracked into counts per length; a choice is repeated as often
as the counts allow.  Where even the best choice leaves slack, another document is cut to fill it,
so only the last window of a partition can have any; that one is cut at the binary digits of its
length, and a sequence whose length is a power of two takes no padding.

The buffer is bounded (``block_items`` remainders), so a task holds a few tens of MB whatever the
partition, nothing is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import text_or_empty
from doccat.llm.tokens import char_batches, encoder

WINDOW = 1024
BLOCK_ITEMS = 4096


def best_fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """Counts per length whose sum is as close to ``target`` from below as ``counts`` allow.

    Bit t of the bitset is set when some multiset sums to t.  Lengths go in falling order, in
    binary parts of their counts; the search ends once ``target`` itself is reached.
    """
    if target <= 0:
        return {}
    mask, bits = (1 << (target + 1)) - 1, 1
    layers: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= target and counts[x] > 0), reverse=True):
        left, part = min(counts[length], target // length), 1
        while left > 0:
            take = min(part, left)
            layers.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left, part = left - take, part * 2
            if bits >> target & 1:
                left = 0
        if bits >> target & 1:
            break
    t, used = bits.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(layers):
        if not before >> t & 1:
            used[length] += take
            t -= length * take
    return dict(used)


class SlackPacker:
    """Streaming packer: ``add`` items, take finished (item, start, length, sequence, offset) pieces."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.items: dict[int, deque] = defaultdict(deque)
        self.counts: dict[int, int] = {}
        self.held = 0
        self.total = 0

    def _push(self, length: int, item, start: int) -> None:
        self.items[length].append((item, start))
        self.counts[length] = self.counts.get(length, 0) + 1
        self.held += 1
        self.total += length

    def _pop(self, length: int):
        self.held -= 1
        self.total -= length
        if self.counts[length] == 1:
            del self.counts[length]
        else:
            self.counts[length] -= 1
        return self.items[length].popleft()

    def add(self, item, n: int) -> Iterator[tuple]:
        whole = n // self.window
        for k in range(whole):
            yield item, k * self.window, self.window, self.sequence, 0
            self.sequence += 1
        if n % self.window:
            self._push(n % self.window, item, whole * self.window)

    def _window(self, parts: dict[int, int]) -> Iterator[tuple]:
        offset = 0
        for length in sorted(parts, reverse=True):
            for _ in range(parts[length]):
                item, start = self._pop(length)
                yield item, start, length, self.sequence, offset
                offset += length
        if offset < self.window and self.held:  # slack is left: every remaining item is longer
            length = max(self.counts)
            item, start = self._pop(length)
            head = min(self.window - offset, length)
            yield item, start, head, self.sequence, offset
            if length > head:
                self._push(length - head, item, start + head)
        self.sequence += 1

    def pack(self, low_water: int = 0) -> Iterator[tuple]:
        """Fill windows until ``low_water`` items, or less than a window, are left."""
        while self.held > low_water and self.total >= self.window:
            seed = max(self.counts)
            self.counts[seed] -= 1
            parts = best_fill(self.counts, self.window - seed)
            self.counts[seed] += 1
            parts[seed] = parts.get(seed, 0) + 1
            full = sum(k * v for k, v in parts.items()) == self.window
            again = min(self.counts[k] // v for k, v in parts.items()) if full else 1
            for _ in range(again):
                yield from self._window(parts)

    def finish(self) -> Iterator[tuple]:
        """The last, partly filled window, cut at the binary digits of its length."""
        yield from self.pack()
        room = offset = 0
        left = self.total
        while self.held:
            length = max(self.counts)
            item, start = self._pop(length)
            while length:
                if room == 0:
                    self.sequence += offset > 0
                    room, offset = 1 << (left.bit_length() - 1), 0
                    left -= room
                head = min(room, length)
                yield item, start, head, self.sequence, offset
                room, offset, length, start = room - head, offset + head, length - head, start + head


def pack_documents(docs: DataFrame, tokenizer_path: str, kind: str = "byte", window: int = WINDOW, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers.  Sequences are
    numbered within (partition id << 33).  Null and empty texts give one piece with the end id;
    repeated rows and repeated ids are packed each for itself; null ids stay null; an empty table
    gives no rows.  Only the id and text columns are read, so other columns cannot clash.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, kind)
        end = np.array([end_id], dtype="<u4")
        packer = SlackPacker(window, TaskContext.get().partitionId() << 33)
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            cols = list(zip(*[(it[0], s, n, it[1][s - it[2]:s - it[2] + n].tobytes(), it[3], q, o)
                              for it, s, n, q, o in out]))
            out.clear()
            return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

        schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                            ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in char_batches(texts):
                for key, ids in zip(keys[part], enc.encode(texts[part])):
                    ids = np.concatenate([ids.astype("<u4"), end])
                    n = len(ids)
                    whole = n - n % window
                    for k in range(0, whole, window):
                        out.append(((key, ids, 0, n), k, window, packer.sequence, 0))
                        packer.sequence += 1
                        if len(out) >= 4096:
                            yield emit()
                    if n > whole:  # only the remainder stays in memory
                        packer._push(n - whole, (key, ids[whole:].copy(), whole, n), whole)
                    if packer.held >= block_items:
                        for piece in packer.pack(block_items // 4):
                            out.append(piece)
                            if len(out) >= 4096:
                                yield emit()
        for piece in packer.finish():
            out.append(piece)
            if len(out) >= 4096:
                yield emit()
        if out:
            yield emit()

    from pyspark.sql.pandas.types import to_arrow_type

    lean = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = to_arrow_type(lean.schema["doc_id"].dataType)
    kind_name = lean.schema["doc_id"].dataType.simpleString()
    return lean.mapInArrow(run, f"doc_id {kind_name}, start long, length long, ids binary, doc_tokens long, "
                                "sequence_id long, offset long")
