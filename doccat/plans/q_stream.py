"""Streaming upsert final state (T1) equals the batch fold of runs v1 and v2."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from doccat.operators.catalog_schema import CATALOG_SCHEMA
from doccat.operators import store
from doccat.operators.export import bootstrap_from_snapshot
from doccat.operators.store import read_current
from doccat.plans.q_catalog import catalog
from doccat.plans.q_upsert import change_feed_sql, _sql_two_runs, batch_v1, batch_v2, catalog_after_v2
from doccat.plans.registry import register
from doccat.session import scratch_path
from doccat.sources.adapter import RUN_TS_V1, RUN_TS_V2
from doccat.streaming.upsert_stream import stream_upsert


def land_runs(spark, sf_dir, landing, which=(1, 2)):
    """Write runs v1 and/or v2 as landed parquet batches (each row carries its run_ts), one write per run."""
    runs = {1: (batch_v1, RUN_TS_V1), 2: (batch_v2, RUN_TS_V2)}
    for n in which:
        build, ts = runs[n]
        (build(spark, sf_dir).withColumn("run_ts", F.lit(ts).cast("timestamp_ntz"))
         .write.mode("errorifexists").option("compression", store.CODEC).parquet(f"{landing}/batch={n}"))


@register("stream_upsert_final_state", lambda: _sql_two_runs("SELECT * FROM v2"))
def stream_upsert_final_state(spark, sf_dir):
    """Runs landed as files, upserted by a file stream with foreachBatch; the last committed version."""
    return read_current(spark, streamed_catalog(spark, sf_dir)).select(*[c for c in batch_columns()])


def streamed_catalog(spark, sf_dir):
    """Root of a catalog that the stream made of runs v1 and v2."""
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    landing = f"{base}/landing"
    land_runs(spark, sf_dir, landing)
    schema = spark.read.parquet(landing).schema
    stream_upsert(spark, landing, schema, f"{base}/catalog", f"{base}/_checkpoint")
    return f"{base}/catalog"


@register("stream_change_log", change_feed_sql)
def stream_change_log(spark, sf_dir):
    """T2 as the stream's output: the change log appended with each committed version."""
    log = store.change_log(spark, streamed_catalog(spark, sf_dir), CATALOG_SCHEMA)
    return log.select("id", F.col("version").alias("run"), "change_type")


@register("change_log_fold", lambda: _sql_two_runs("SELECT * FROM v2"))
def change_log_fold(spark, sf_dir):
    """The catalog folded from the change log alone."""
    return store.fold_log(store.change_log(spark, streamed_catalog(spark, sf_dir), CATALOG_SCHEMA)).select(*batch_columns())


@register("backup_roundtrip", lambda: _sql_two_runs("SELECT * FROM v2"))
def backup_roundtrip(spark, sf_dir):
    """K7: the current version is copied before an update; the copy is what was current, not what the update made."""
    base = scratch_path(spark, f"backup-{uuid.uuid4().hex}")
    store.write_version(catalog_after_v2(spark, sf_dir), f"{base}/catalog", 1)
    copy = store.backup_current(spark, f"{base}/catalog", f"{base}/backups", RUN_TS_V2)
    current = read_current(spark, f"{base}/catalog")
    store.write_version(current.filter("agency = 'FDA'"), f"{base}/catalog", 2)
    return spark.read.parquet(copy).select(*batch_columns())


@register("snapshot_bootstrap", lambda: _sql_two_runs("SELECT * FROM v2"))
def snapshot_bootstrap(spark, sf_dir):
    """An absent table is restored from its snapshot, and only an absent one."""
    base = scratch_path(spark, f"snapshot-{uuid.uuid4().hex}")
    catalog(spark, sf_dir).write.option("compression", store.CODEC).parquet(f"{base}/rows")  # both runs read it
    catalog_after_v2(spark, sf_dir, spark.read.parquet(f"{base}/rows")).write.option("compression", store.CODEC).parquet(f"{base}/snapshot")
    if not bootstrap_from_snapshot(spark, f"{base}/db", f"{base}/snapshot") or bootstrap_from_snapshot(spark, f"{base}/db", f"{base}/snapshot"):
        raise ValueError("the table is copied exactly once")
    return spark.read.parquet(f"{base}/db").select(*batch_columns())


def batch_columns():
    from doccat.functions.rules import CATALOG_EXPORT_COLUMNS
    return CATALOG_EXPORT_COLUMNS
