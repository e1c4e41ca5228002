"""Sharding by global byte-size prefix sums: contiguous runs of the id order, cut at equal byte targets.

Rows are range-partitioned and sorted by their order columns (ties: the remaining columns' hash,
then the row's place in the input, so a repeated key cannot fill one task).  Each task sums its own
sizes; the per-partition totals, one row per partition, give every partition its global offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doccat.llm.common import materialize


def shard_by_bytes(rows: DataFrame, size_col: str, order_by: list[str], n_shards: int) -> DataFrame:
    """The rows with ``shard`` (0 to ``n_shards`` - 1), ``slot`` (gapless from 0 in each shard, in id
    order) and ``byte_offset`` (sizes of all rows before).

    A row belongs to the shard that holds the middle of its byte range, so shard sizes differ from
    the target by at most one row.  Null sizes count 0; null order keys come first; input columns
    named shard, slot or byte_offset are replaced; an empty table gives no rows.
    """
    spark = rows.sparkSession
    keep = [c for c in rows.columns if c not in ("shard", "slot", "byte_offset")]
    lean = rows.select(F.struct(*[F.col(c) for c in keep]).alias("r"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("z"))
    order = [F.col(f"r.{c}") for c in order_by] + [F.xxhash64("r"), F.monotonically_increasing_id()]
    names = [f"k{i}" for i in range(len(order))]
    keyed = lean.select("r", "z", *[c.alias(n) for c, n in zip(order, names)])
    placed = keyed.repartitionByRange(*names).sortWithinPartitions(*names).select("r", "z")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, size, count = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            z, n = b.column("z"), b.num_rows
            if not n:
                continue
            upto = pc.add(pc.cumulative_sum(z), size)
            yield pa.record_batch([b.column("r"), z, pa.repeat(part, n).cast(pa.int32()), pc.subtract(upto, z),
                                   pa.array(range(count, count + n), pa.int64())], names=["r", "z", "p", "b", "i"])
            size, count = upto[n - 1].as_py(), count + n

    schema = T.StructType([*placed.schema.fields, T.StructField("p", T.IntegerType()), T.StructField("b", T.LongType()),
                           T.StructField("i", T.LongType())])
    summed = materialize(placed.mapInArrow(sums, schema), "shards")
    # One row per partition: bounded by the number of partitions, not by the data.
    totals = sorted(tuple(x) for x in summed.groupBy("p").agg(F.sum("z"), F.count(F.lit(1))).collect())
    bases, size, count = [], 0, 0
    for p, z, n in totals:
        bases.append((p, size, count))
        size, count = size + z, count + n
    base = F.broadcast(spark.createDataFrame(bases, "p int, pb long, pi long"))
    start = F.col("b") + F.col("pb")
    total = max(size, 1)
    at = summed.join(base, "p").select(
        "r", start.alias("byte_offset"), (F.col("i") + F.col("pi")).alias("n"),
        F.least(F.lit(n_shards - 1), F.expr(f"cast((2 * (b + pb) + z) * {n_shards} div (2 * cast({total} as bigint)) as int)")).alias("shard"))
    # One row per shard.
    first = [(int(s), int(n)) for s, n in at.groupBy("shard").agg(F.min("n")).collect()]
    firsts = F.broadcast(spark.createDataFrame(first, "shard int, first long"))
    return at.join(firsts, "shard").select("r.*", "shard", (F.col("n") - F.col("first")).alias("slot"), "byte_offset")
