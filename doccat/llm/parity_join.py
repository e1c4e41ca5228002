"""Near-duplicate join on word shingles by parity sketches.

A document's set is its distinct 5-word shingles.  For two sets linked at Jaccard 3/4 or more the
symmetric difference is at most (|A| + |B|) / 7.

* Documents with equal sets are one class; everything below works on classes.
* Sizes fall into bands; the sizes that a set can link with lie in its own and the next band, so
  each class takes part in two groups (its own, and that of the band below).
* In a group, shingles are hashed to the blocks of a very wide bit sketch and XOR-ed there.  Each
  differing shingle changes one block at most, so with more blocks than differing shingles two linked
  sets agree on a block (pigeonhole).  A block's bits are kept as the 64-bit XOR of its shingles'
  hashes; empty blocks are never joined.  A group has 2/3 as many blocks as its smallest set has
  shingles, and 40 of them (over several hash functions where a set has fewer) are joined: a linked
  pair agrees on a joined, non-empty block with probability 0.43 or more each, and misses all 40 with
  probability below 2e-10, as rare as a clash of hashes.
* Candidates first meet in a compact parity sketch (2 bits a shingle or more, folded to the size of
  the smaller): its Hamming distance never exceeds the symmetric difference, so a distance
  beyond (|A| + |B|) / 7 proves that a pair does not link.  What is left is verified on whole sets.

Large groups of copies: a joined block links its members to its smallest set (a star, linear in the
members).  Components of the verified links then say which members are still apart, and in every
block all members of different components are compared, whatever the block's size.  The centre has
met all others and stays out, blocks that share most members are compared as their union, and a block
whose pairs have all been verified is not dealt again; where pairs are left, their members are.  Members are dealt into chunks bounded in members and
bytes, each pair of chunks is one tile, and a tile's sketches are compared as arrays.  A tile returns a spanning forest of the pairs that the sketches cannot rule
out, never more rows than it has components; these are verified, components are contracted, and the
few members of pairs still untried after ``FOREST_PASSES`` are settled: the whole sets of the
members concerned are brought into their tiles, all their pairs are verified there, and again only a
spanning forest, now of links, leaves each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doccat.llm.common import arrow_batches, materialize, text_or_empty
from doccat.llm.components import connected_components

SHINGLE = 5
#: Blocks joined per class and group.
BLOCKS = 40
#: Members and bytes of whole sets of a chunk; the pairs of two chunks of a block are compared in one task.
TILE, TILE_BYTES = 1536, 8 << 20
#: Passes that verify forests of candidates before the tiles still open are settled on whole sets.
FOREST_PASSES = 3
#: Classes to verify up to which their ids are broadcast to the texts (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of the Arrow batches that tasks hand to Python: a pair or a member may carry whole sets of any length.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands: any size that 3/4 allows beside a size of band k lies in k or k + 1."""
    ends = [1, 2]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, 4 * (ends[-1] - 1) // 3 + 1))
    return np.array(ends, dtype=np.int64)


BANDS = bands()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (empty without words)."""
    import pandas as pd

    words = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    if not len(flat):
        return [np.empty(0, np.uint64) for _ in texts]
    h = pd.util.hash_array(flat, categorize=False)
    acc = h.copy()
    for j in range(1, SHINGLE):
        acc = acc[:-1] * _M + h[j:] if len(acc) > 1 else acc[:0]
    acc = _mix(acc)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= SHINGLE:
            out.append(np.unique(acc[at:at + n - SHINGLE + 1]))
        elif n:
            one = np.array([n], np.uint64)
            for j in range(at, at + n):
                one = one * _M + h[j:j + 1]
            out.append(_mix(one))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def sketch_bits(n: int) -> int:
    return max(64, 1 << int(2 * n - 1).bit_length())


def parity_sketch(hashes: np.ndarray) -> bytes:
    """One bit per hash value modulo the sketch's size, flipped by each shingle."""
    bits = sketch_bits(len(hashes))
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the larger folded to the size of the smaller."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def block_keys(hashes: np.ndarray) -> np.ndarray:
    """Join keys of the set's non-empty blocks in its two groups."""
    n = len(hashes)
    if n < 3:  # no other set reaches 3/4
        return np.empty(0, np.int64)
    band = int(np.searchsorted(BANDS, n, side="right")) - 1
    out = []
    for group in (band, band - 1):
        low = int(BANDS[group])
        blocks = max(2, -(-2 * low // 3))
        rounds = -(-BLOCKS // blocks)
        used = np.uint64(min(blocks, -(-BLOCKS // rounds)))
        for r in range(rounds):
            h = _mix(hashes ^ _mix(np.array([group * 1000 + r + 1], np.uint64)))
            block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            take = block < used
            block, h = block[take], h[take]
            if not len(block):
                continue
            order = np.argsort(block, kind="stable")
            block, h = block[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            value = np.bitwise_xor.reduceat(_mix(h), first)
            out.append(_mix(value ^ _mix(block[first] + np.uint64((group * 64 + r) << 32))))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _lean(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n`` (set size), ``cls`` (128-bit hash of the set; null if empty), ``sketch, keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                sets = shingle_sets(b.column(1).slice(lo, 512).to_pylist())
                yield pa.record_batch([
                    b.column(0).slice(lo, 512), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([block_keys(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "cls", "sketch", "keys"])

    lean = _lean(docs, id_col, text_col)
    kind = lean.schema["doc_id"].dataType.simpleString()
    return lean.mapInArrow(run, f"doc_id {kind}, n long, cls binary, sketch binary, keys array<long>")


def _close_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that size and sketch distance do not rule out."""
    left = classes.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").filter("4 * least(na, nb) >= 3 * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")])
            yield b.select(["a", "b"]).filter(
                pa.array([7 * sketch_distance(x, y) <= m + n for m, n, x, y in rows], pa.bool_()))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of words, all folded to the size of the smallest."""
    width = min(len(x) for x in sketches)
    same = [np.frombuffer(x, np.uint8) for x in sketches]
    same = [x if len(x) == width else np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in same]
    return np.stack(same).view(np.uint64)


class Forest:
    """Components of a tile's members, joined pair by pair."""

    def __init__(self, roots: np.ndarray):
        self.parent = {r: r for r in roots.tolist()}

    def find(self, r: int) -> int:
        while self.parent[r] != r:
            self.parent[r] = self.parent[self.parent[r]]
            r = self.parent[r]
        return r

    def join(self, p: int, q: int) -> bool:
        p, q = self.find(p), self.find(q)
        self.parent[p] = q
        return p != q


def near_in_tile(n: np.ndarray, root: np.ndarray, second: np.ndarray, sketches: list[bytes], cross: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(member, others, sketch distances) of the pairs in different components that size and sketch distance do
    not rule out, each pair once; with ``cross`` only pairs of the two chunks."""
    words = _folded(sketches)
    others = np.flatnonzero(second)
    for i in (np.flatnonzero(~second) if cross else np.arange(len(n))).tolist():
        to = others if cross else np.arange(i + 1, len(n))
        to = to[(root[to] != root[i]) & (4 * np.minimum(n[to], n[i]) >= 3 * np.maximum(n[to], n[i]))]
        if len(to):
            gap = np.bitwise_count(words[to] ^ words[i]).sum(1, dtype=np.int64)
            near = 7 * gap <= n[to] + n[i]
            if near.any():
                yield i, to[near], gap[near]


def candidate_forest(uid: np.ndarray, root: np.ndarray, near: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, bool]:
    """A spanning forest of a tile's near pairs, closest sketches first, and whether these are all of them."""
    if not near:
        return uid[:0], uid[:0], True
    x = np.concatenate([np.full(len(to), i) for i, to, _ in near])
    y, gaps = np.concatenate([to for _, to, _ in near]), np.concatenate([g for _, _, g in near])
    forest = Forest(root)
    keep = [k for k in np.argsort(gaps, kind="stable").tolist() if forest.join(int(root[x[k]]), int(root[y[k]]))]
    return np.minimum(uid[x[keep]], uid[y[keep]]), np.maximum(uid[x[keep]], uid[y[keep]]), len(keep) == len(x)


def link_forest(uid: np.ndarray, n: np.ndarray, root: np.ndarray, second: np.ndarray, sets: list[bytes], cross: bool) -> tuple[list[int], list[int]]:
    """A spanning forest of a tile's links: every near pair of different components is verified on whole sets,
    unless links found before join its components."""
    whole = [np.frombuffer(x, np.uint64) for x in sets]
    forest, a, b = Forest(root), [], []
    for i, to, _ in near_in_tile(n, root, second, [parity_sketch(x) for x in whole], cross):
        for j in to.tolist():
            p, q = int(root[i]), int(root[j])
            if forest.find(p) == forest.find(q):
                continue
            both = len(np.intersect1d(whole[i], whole[j], assume_unique=True))
            if 100 * both >= 75 * (len(whole[i]) + len(whole[j]) - both):
                forest.join(p, q)
                a.append(int(min(uid[i], uid[j])))
                b.append(int(max(uid[i], uid[j])))
    return a, b


def _by_tile(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``work(table)`` of each run of rows with equal (key, t1, t2)."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        if not b.num_rows:
            continue
        marks = np.stack([b.column(c).to_numpy() for c in ("key", "t1", "t2")], axis=1)
        ends = [*(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), b.num_rows]
        lo = 0
        for hi in ends:
            mark = tuple(marks[lo].tolist())
            if held and mark != at:
                yield work(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(lo, hi - lo))
            at, lo = mark, hi
    if held:
        yield work(pa.Table.from_batches(held))


def _untried(rows: DataFrame) -> DataFrame:
    """``key, uid, n``: the members that each block's star has not compared with each other.

    A family of near copies shares most of its members between many blocks.  Blocks with the same leader
    (their member of smallest hash) are compared as one, their union, where that has no more pairs than
    the blocks have one by one: no pair of a block is left out, and no pair is compared in each of them.
    """
    led = rows.filter("members > 2 AND uid <> c.uid").select("key", "uid", "n", "lead", (F.col("members") - 1).alias("m"))
    apart = led.groupBy("lead").agg(F.sum("m").alias("pairs"))  # each block's count, once per member: its square
    union = led.groupBy("lead", "uid").agg(F.min("n").alias("n"))
    fewer = union.groupBy("lead").agg(F.count(F.lit(1)).alias("u")).join(apart, "lead").filter("u * u <= pairs").select("lead")
    one = union.join(fewer, "lead", "left_semi").select(F.col("lead").alias("key"), "uid", "n")
    return materialize(one.union(led.join(fewer, "lead", "left_anti").select("key", "uid", "n")), "untried")


def _tiles(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, t1, t2, second, uid, n, root``: the members of every block with several components, dealt to tiles."""
    placed = rows.select("key", "uid", "n").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    spread = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("members"),
                                       F.sum("n").alias("size")).filter("lo <> hi")
    parts = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("size") * 8 / TILE_BYTES))
    few = placed.join(spread, "key").select("key", "uid", "n", "root", parts.alias("parts"), F.expr("pmod(xxhash64(uid), parts)").alias("part"))
    dealt = few.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select("key", F.least("part", "with").alias("t1"), F.greatest("part", "with").alias("t2"), (F.col("part") > F.col("with")).alias("second"), "uid", "n", "root")


def _apart(rows: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, a, b``: of each tile a forest of its near pairs and, where there are others, every member of a
    near pair as ``a`` with a null ``b``."""
    tiles = _tiles(rows, roots).join(classes.select("uid", "sketch"), "uid").repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")

    def tile(t: pa.Table) -> pa.RecordBatch:
        uid, n, root, second = (t[c].to_numpy() for c in ("uid", "n", "root", "second"))
        near = list(near_in_tile(n, root, second, t["sketch"].to_pylist(), t["t1"][0] != t["t2"][0]))
        a, b, whole = candidate_forest(uid, root, near)
        again = uid[:0] if whole else uid[np.unique(np.concatenate([np.append(to, i) for i, to, _ in near]))]
        return pa.record_batch([pa.array(np.full(len(a) + len(again), t["key"][0].as_py()), pa.int64()), pa.array(np.concatenate([a, again]), pa.int64()),
                                pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(again), pa.int64())])], names=["key", "a", "b"])

    return tiles.mapInArrow(lambda batches: _by_tile(batches, tile), "key long, a long, b long")


def _settled(rows: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that join all linked components in the tiles of ``rows``."""
    tiles = _tiles(rows, roots).join(classes.select("uid", "sketch"), "uid")
    tiles = tiles.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")

    def concerned(t: pa.Table) -> pa.RecordBatch:
        n, root, second = (t[c].to_numpy() for c in ("n", "root", "second"))
        hit = np.zeros(len(n), dtype=bool)
        for i, to, _ in near_in_tile(n, root, second, t["sketch"].to_pylist(), t["t1"][0] != t["t2"][0]):
            hit[i] = hit[to] = True
        kept = t.drop_columns("sketch").filter(pa.array(hit)).combine_chunks()
        return pa.record_batch([kept[c].combine_chunks() for c in kept.column_names], schema=kept.schema)

    few = tiles.select("key", "t1", "t2", "second", "uid", "n", "root", "sketch").mapInArrow(
        lambda batches: _by_tile(batches, concerned), "key long, t1 long, t2 long, second boolean, uid long, n long, root long")
    few = materialize(few, "concerned")
    sets = _sets(few.select("uid").distinct(), classes, docs, id_col, text_col)
    whole = few.join(sets, "uid").repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2")

    def links(t: pa.Table) -> pa.RecordBatch:
        uid, n, root, second = (t[c].to_numpy() for c in ("uid", "n", "root", "second"))
        a, b = link_forest(uid, n, root, second, t["shingles"].to_pylist(), t["t1"][0] != t["t2"][0])
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return whole.mapInArrow(lambda batches: _by_tile(batches, links), "a long, b long")


def _sets(uids: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid, shingles``: the whole sets of the classes ``uids``, a written table."""
    needed = uids.join(classes.select("uid", "cls", "rep"), "uid")
    needed = materialize(needed, "needed").select("uid", "cls", F.col("rep").alias("doc_id"))
    small = needed.count() <= BROADCAST_ROWS
    lean = _lean(docs, id_col, text_col)
    picked = lean.join(F.broadcast(needed) if small else needed, lean["doc_id"].eqNullSafe(needed["doc_id"])).select("uid", "cls", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sets = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist())]
                same = [xxhash.xxh3_128_digest(s) == c for s, c in zip(sets, part.column("cls").to_pylist())]
                yield pa.record_batch([part.column("uid"), pa.array(sets, pa.binary())], names=["uid", "shingles"]).filter(pa.array(same, pa.bool_()))

    sets = materialize(picked.mapInArrow(sets_of, "uid long, shingles binary").dropDuplicates(["uid"]), "sets")
    return sets


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose whole sets link."""
    sets = _sets(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct(), classes, docs, id_col, text_col)
    left = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= 75 * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    close = materialize(_close_pairs(pairs.distinct(), classes), "close")
    return materialize(_verify(close, classes, docs, id_col, text_col), "links")


def _contracted(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (node, root) after the links ``found`` have joined components."""
    root_of = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    for side in ("a", "b"):
        found = found.join(root_of, F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_r", side)).drop("_n", "_r")
    joined = connected_components(found)
    known = roots.join(joined.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("root") == F.col("_n"), "left").select(
        "node", F.coalesce("_r", "root").alias("root"))
    return materialize(known.union(joined.join(roots, "node", "left_anti")), "roots")


def _shared(keyed: DataFrame) -> DataFrame:
    """``key, c, members, lead`` of the blocks that several classes share: a smallest set (``c.n, c.uid``), the
    member count, the smallest hash of a member.  The buffers are longs alone, so that hashing does it without a sort."""
    found = keyed.groupBy("key").agg(F.min("n").alias("low"), F.min_by("uid", "n").alias("centre"), F.count(F.lit(1)).alias("members"),
                                     F.min(F.xxhash64("uid")).alias("lead")).filter("members > 1")
    return found.select("key", F.struct(F.col("low").alias("n"), F.col("centre").alias("uid")).alias("c"), "members", "lead")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles`` and ``component_id``, the smallest id reachable by links.

    Null and blank texts have no shingles and link with nothing; texts of fewer than five words have
    one shingle.  Rows with equal sets are one class, whatever their number.  Null ids sort last: a
    component with any other id is named by that.  An empty table gives no rows.
    """
    with arrow_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        return _components(docs, id_col, text_col)


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``near_duplicates``; every table that Python makes is written before it returns."""
    sig = materialize(signatures(docs, id_col, text_col), "signatures")
    named = sig.filter("cls IS NOT NULL")
    reps = named.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    one = Window.partitionBy("cls").orderBy("cls")
    single = named.select("cls", "n", "sketch", "keys", F.row_number().over(one).alias("k")).filter("k = 1").drop("k")
    classes = materialize(single.join(reps, "cls").withColumn("uid", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("uid", "n", F.explode("keys").alias("key"))
    # Blocks that several classes share; most blocks have one class and go no further.
    rows = materialize(keyed.join(_shared(keyed), "key"), "blocks")
    first = rows.filter("c.uid <> uid AND 4 * c.n >= 3 * n").select(F.least("uid", "c.uid").alias("a"), F.greatest("uid", "c.uid").alias("b"))
    links = _links(first, classes, docs, id_col, text_col)
    tried = first.distinct()
    roots = connected_components(links)
    # Members that the stars left in other components than others of their block.
    others = _untried(rows)
    dealt = others
    for _ in range(FOREST_PASSES):
        apart = materialize(_apart(dealt, roots, classes), "apart")
        more = apart.filter("b IS NOT NULL").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        # Only members of near pairs that the forests left out go on.
        dealt = others.join(apart.filter("b IS NULL").select("key", F.col("a").alias("uid")).distinct(), ["key", "uid"], "left_semi")
        found = _links(more, classes, docs, id_col, text_col)
        if found.isEmpty():
            break
        roots = _contracted(roots, found)
        tried = materialize(tried.union(more), "tried")
    if not dealt.isEmpty():
        roots = _contracted(roots, materialize(_settled(dealt, roots, classes, docs, id_col, text_col), "settled"))
    roots = roots.withColumnRenamed("node", "uid")
    owned = classes.select("uid", "cls", "rep").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    name = owned.groupBy("root").agg(F.min("rep").alias("component_id"))
    member = owned.join(name, "root").select("cls", "component_id")
    out = sig.select("doc_id", "n", "cls").join(member, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
