"""Nearest neighbours by randomly rotated one-bit codes.

Index: vectors minus a centre (mean of a bounded sample) are normalised and turned by a random
rotation; the signs are packed bits, and one correction scalar per vector (the inner product of the
vector and its own code) makes the estimate of inner products unbiased.  Search: a query's rotated
coordinates are quantised to 8 bit-planes, its inner product with every code is a sum of popcounts,
and the estimate has an error bound.  Vectors whose lower bound on the distance does not exceed the
k-th smallest distance known so far are reranked by exact distances on the original vectors.

Queries and vectors meet block by block: the index is rows of up to ``CHUNK`` vectors, the queries
rows of up to ``QUERY_BLOCK``; each pair of rows leaves its own k nearest per query, and a window
picks the k nearest of all.  Vectors are compared with those of their own dimension, one index for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doccat.llm.common import materialize

CHUNK = 4096
QUERY_BLOCK = 512
#: Rows that the centre is taken from.
SAMPLE_ROWS = 4096
#: Dimensions that one table may hold; a table with more is refused.
MAX_DIMENSIONS = 64
#: Width of the error bound in standard deviations.
EPSILON = 3.0
#: Query blocks below this size are broadcast; larger sets meet the index as a product of blocks.
BROADCAST_BYTES = 32 << 20
SEED = 20_240_501


def _usable(vec: Column) -> Column:
    """True for vectors without null or non-finite parts that are not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words), residual norms and correction scalars."""
    rest = vectors.astype(np.float64) - centre
    norm = np.linalg.norm(rest, axis=1)
    unit = rest @ turn / np.where(norm > 0, norm, 1)[:, None]
    bits = unit > 0
    own = np.abs(unit).sum(1) / np.sqrt(unit.shape[1])
    packed = np.packbits(bits, axis=1)
    pad = -packed.shape[1] % 8
    packed = np.pad(packed, ((0, 0), (0, pad)))
    return np.ascontiguousarray(packed).view("<u8"), norm, np.where(norm > 0, own, 1.0)


def estimate(codes: np.ndarray, norm: np.ndarray, own: np.ndarray, query: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds on the squared distances of the coded vectors to a query."""
    dim = len(query)
    rest = query.astype(np.float64) - centre
    size = float(np.linalg.norm(rest))
    unit = rest @ turn / (size or 1.0)
    low = float(unit.min())
    step = (float(unit.max()) - low) / 255 or 1.0
    level = np.rint((unit - low) / step).astype(np.uint8)
    planes = np.packbits((level[None, :] >> np.arange(8)[:, None]) & 1, axis=1)
    planes = np.ascontiguousarray(np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8)))).view("<u8")
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    both = np.zeros(len(codes), dtype=np.int64)
    for j in range(8):
        both += np.bitwise_count(codes & planes[j]).sum(1, dtype=np.int64) << j
    # <signs, quantised unit> / sqrt(dim): twice the sum over set bits less the sum over all.
    dot = (2 * (low * ones + step * both) - (low * dim + step * int(level.sum(dtype=np.int64)))) / np.sqrt(dim)
    inner = dot / own
    slack = (EPSILON * np.sqrt(np.maximum(1 - own ** 2, 0) / max(dim - 1, 1)) + step * np.sqrt(dim) / 2) / own
    base, cross = norm ** 2 + size ** 2, 2 * norm * size
    return base - cross * np.minimum(inner + slack, 1), base - cross * np.maximum(inner - slack, -1)


def nearest(ids: np.ndarray, vectors: np.ndarray, code: tuple, qid: int, query: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, known: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids of a chunk (ids, distances), each once with its nearest row, ties to smaller
    ids; vectors that cannot beat ``known``, a distance that k other ids reach, may be left out."""
    low, high = estimate(*code, query, centre, turn)
    mine = ids == qid
    high[mine] = np.inf
    limit = known ** 2
    if len(ids) - int(mine.sum()) > k:
        reach = high
        if len(np.unique(ids)) < len(ids):  # the bound of an id is that of its best row
            by_id = np.argsort(ids, kind="stable")
            reach = np.minimum.reduceat(high[by_id], np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0]))
        if len(reach) > k:
            limit = min(limit, float(np.partition(reach, k - 1)[k - 1]))
    at = np.flatnonzero((low <= limit * (1 + 1e-9) + 1e-12) & ~mine)
    gap = (vectors[at].astype(np.float64) - query.astype(np.float64)) ** 2
    far = np.sqrt(np.add.accumulate(gap, axis=1)[:, -1])  # summed in order of the parts
    order = np.lexsort((ids[at], far))
    order = order[np.sort(np.unique(ids[at][order], return_index=True)[1])][:k]
    return ids[at][order], far[order]


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part; vectors of doubles stay doubles, others are floats."""
    part = "double" if isinstance(vectors.schema[vec_col].dataType.elementType, T.DoubleType) else "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{part}>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))


def _stored(rows: DataFrame) -> str:
    """How the parts of the vectors are written: little-endian, 4 or 8 bytes."""
    return "<f8" if isinstance(rows.schema["embedding"].dataType.elementType, T.DoubleType) else "<f4"


def _blocks(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Rows of up to ``size`` (vec_id, embedding) rows of dimension ``dim``: ids and vectors as bytes."""
    kind = _stored(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, held = [], [], 0
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            vecs.append(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            held += b.num_rows
            if held >= size:
                i, v = np.concatenate(ids), np.concatenate(vecs)
                for lo in range(0, held - held % size, size):
                    yield _row(i[lo:lo + size], v[lo:lo + size])
                ids, vecs, held = [i[held - held % size:]], [v[held - held % size:]], held % size
        if held:
            yield _row(np.concatenate(ids), np.concatenate(vecs))

    def _row(i: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([i.astype("<i8").tobytes()], pa.binary()), pa.array([v.astype(kind).tobytes()], pa.binary())], names=["ids", "vecs"])

    return rows.mapInArrow(run, "ids binary, vecs binary")


def build_index(rows: DataFrame, dim: int) -> tuple[DataFrame, np.ndarray]:
    """Index rows (ids, vecs, codes, norms, own) of ``usable_vectors`` of dimension ``dim``, written to the
    shared folder, and the centre.  The centre only shapes the codes; every row is indexed."""
    kind = _stored(rows)
    sample = [np.array(r[0], dtype=np.float64) for r in rows.select("embedding").limit(SAMPLE_ROWS).collect()]
    centre = np.mean(sample or [np.zeros(dim)], axis=0)
    turn = rotation(dim)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bits, norm, own = encode(np.frombuffer(v, kind).reshape(-1, dim), centre, turn)
                yield pa.record_batch([pa.array([x], pa.binary()) for x in (i, v, bits.tobytes(), norm.tobytes(), own.tobytes())],
                                      names=["ids", "vecs", "codes", "norms", "own"])

    index = _blocks(rows, dim, CHUNK).mapInArrow(
        code, "ids binary, vecs binary, codes binary, norms binary, own binary")
    return materialize(index, "codes"), centre


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k nearest by Euclidean distance in double
    precision, ties to smaller ids.

    ``queries`` selects the query rows; rows with a query's own id are no candidates for it, and a
    candidate id counts once (its nearest row).  Repeated query ids give one list, of the nearest
    over all their rows.  Null ids and vectors that are null, zero or not finite take no part; a query meets the
    candidates of its own dimension; an empty table gives no rows.
    """
    rows = usable_vectors(vectors, id_col, vec_col)
    asked = usable_vectors(vectors.filter(queries), id_col, vec_col)
    sizes = [r[0] for r in rows.select(F.size("embedding").alias("d")).distinct().limit(MAX_DIMENSIONS + 1).collect()]
    if len(sizes) > MAX_DIMENSIONS:
        raise ValueError(f"more than {MAX_DIMENSIONS} dimensions in one table")
    lists = [_search(rows.filter(F.size("embedding") == d), asked.filter(F.size("embedding") == d), d, k) for d in sorted(sizes)]
    if not lists:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = lists[0]
    for more in lists[1:]:
        found = found.unionByName(more)
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """``query_id, vec_id, score``: of every index block the k nearest of each query, all of one dimension."""
    index, centre = build_index(rows, dim)
    kind, turn = _stored(rows), rotation(dim)
    asked = asked.distinct()
    n = asked.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    blocks = _blocks(asked.repartition(parts, "vec_id"), dim, QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    small = n * (dim * int(kind[2]) + 8) <= BROADCAST_BYTES
    pairs = index.join(F.broadcast(blocks)) if small else index.crossJoin(materialize(blocks, "queries"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for b in batches:
            for ids, vecs, codes, norms, own, q_ids, q_vecs in zip(*[c.to_pylist() for c in b.columns]):
                i, v = np.frombuffer(ids, "<i8"), np.frombuffer(vecs, kind).reshape(-1, dim)
                code = (np.frombuffer(codes, "<u8").reshape(len(i), -1), np.frombuffer(norms), np.frombuffer(own))
                asked_ids, asked_vecs = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_vecs, kind).reshape(-1, dim)
                if q_ids not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[q_ids] = np.full(len(asked_ids), np.inf)
                limit, out = known[q_ids], []
                for j, (qid, q) in enumerate(zip(asked_ids, asked_vecs)):
                    near, far = nearest(i, v, code, qid, q, centre, turn, k, limit[j])
                    if len(near) == k:
                        limit[j] = min(limit[j], far[-1])
                    out.append((np.full(len(near), qid), near, far))
                yield pa.record_batch([np.concatenate([o[c] for o in out]) for c in range(3)], names=["query_id", "vec_id", "score"])

    return pairs.select("ids", "vecs", "codes", "norms", "own", "q_ids", "q_vecs").mapInArrow(run, "query_id long, vec_id long, score double")
