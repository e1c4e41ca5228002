"""Continuous catalog upsert with Structured Streaming.

Landed run batches (parquet, one ``run_ts`` per run) are read as a file
stream; ``foreachBatch`` folds each micro-batch's runs, in ``run_ts`` order,
into the catalog and commits the next version for every run.

* Idempotent: each commit records the stream's id (kept in its checkpoint), the
  micro-batch and the run; a replay skips the runs that are recorded, so it can
  never turn ``updated`` into ``unchanged``, and a fresh checkpoint on an old
  catalog goes on from its last version.
* Lineage is cut at every version: the next batch reads the committed parquet.
* The catalog lies in hash buckets of ``id``.  A run reads, merges and writes only the buckets its ids fall
  into, and appends its rows to the change log (T2), from which the catalog can be folded again.
* A run must reach the stream whole: land it with one write (its files appear
  together at commit) and do not cap files per trigger below a run, because
  last-write-wins inside a run needs all of the run's rows at once.
* Executor loss inside a batch only re-runs tasks; driver loss resumes from the
  stream checkpoint (a folder under the shared checkpoint location).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from doccat.operators.catalog_schema import CATALOG_SCHEMA
from doccat.operators.store import _BUCKET, BUCKETS, bucket_of, latest, newest_first, read_buckets, write_buckets
from doccat.operators.upsert import last_two_per_id, prepare_batch, upsert_in_buckets

#: Rows of an id in a run above which the run is first cut to the last two rows of every id.
HOT_ID = 1_000


def stream_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The id that Structured Streaming keeps in a checkpoint; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint_location}/metadata").first()[0])["id"]


def applied_runs(spark: SparkSession, catalog_root: str, stream: str, batch_id: int) -> set[str]:
    """Runs of this micro-batch that are committed already; its records are the newest, so few are opened."""
    done = set()
    for _, record in newest_first(spark, catalog_root):
        note = record["note"]
        if note.get("stream") != stream or note.get("batch") != batch_id:
            break
        done.add(note.get("run"))
    return done


def apply_runs(spark: SparkSession, batch: DataFrame, catalog_root: str, stream: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Fold every run of ``batch`` (column ``run_ts``) into the catalog in run order, a version per run."""
    runs = [str(r[0]) for r in batch.select("run_ts").distinct().orderBy("run_ts").collect()]  # one row per run
    done = applied_runs(spark, catalog_root, stream, batch_id)
    for ts in runs:
        if ts in done:
            continue  # replay of a committed run
        version, record = latest(spark, catalog_root)
        buckets = record.get("buckets", buckets)
        stamp = F.lit(ts).cast("timestamp_ntz")
        rows = prepare_batch(batch.filter(F.col("run_ts") == stamp).drop("run_ts"))
        bucket = bucket_of(F.col("id"), buckets)
        times = rows.groupBy("id").count().groupBy(bucket.alias("b")).agg(F.max("count")).collect()  # at most ``buckets`` rows
        touched = sorted(r[0] for r in times)
        if max((r[1] for r in times), default=0) > HOT_ID:
            rows = last_two_per_id(rows)
        current = read_buckets(spark, catalog_root, record, CATALOG_SCHEMA, touched)
        merged = upsert_in_buckets(current, rows, stamp, bucket, max(1, len(touched)), _BUCKET)
        write_buckets(merged, catalog_root, version + 1, record, touched, buckets,
                      F.col("last_seen_at") == stamp, note={"stream": stream, "batch": batch_id, "run": ts})


def stream_upsert(spark: SparkSession, landing_dir: str, schema: StructType, catalog_root: str,
                  checkpoint_location: str, max_files_per_trigger: int | None = None,
                  available_now: bool = True) -> None:
    """Run the upsert stream over ``landing_dir`` until the available input is consumed."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(landing_dir)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        cols = [c for c in batch.columns if c != "batch"]
        apply_runs(batch.sparkSession, batch.select(*cols), catalog_root, stream_id(spark, checkpoint_location), batch_id)

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
