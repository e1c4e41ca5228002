"""Versioned catalog storage (K7 backups, atomic versions for the upsert, the change log of T2).

A version counts once one small file, ``root/commits/<version>.json``, names the folders that hold it; readers
take the highest such version.  Data folders belong to one attempt (``data/<version>-<attempt>``), so nothing is
ever read and overwritten, and a writer that dies leaves folders that nothing names (the retry writes others).

* ``write_version`` writes a whole table.
* ``write_buckets`` keeps the table in hash buckets of ``id``: a version names one folder per bucket, and a run
  writes only the buckets it touches; the others stay where earlier versions put them.  It also appends the
  run's rows to a change log: the table is the last logged row of every id.  A row is written once: the log
  names the version's data files, in which the run's rows are marked (rows that a bucket only carries over are not).

Commit records are read by the driver alone (a small file each), never by Spark jobs; readers of the current
version open one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Default number of hash buckets; choose it so that a task can sort a bucket's old and new rows in memory.
BUCKETS = 128
_BUCKET = "_bucket"
_LOGGED = "_logged"
#: Codec of the files kept here; texts take much less room than with the default.
CODEC = "zstd"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def newest_first(spark: SparkSession, root: str) -> Iterator[tuple[int, dict]]:
    """Committed (version, record) pairs, highest version first; records are opened as they are asked for."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/commits")
    if not fs.exists(p):
        return
    found = [(re.fullmatch(r"(\d+)\.json", st.getPath().getName()), st) for st in fs.listStatus(p)]
    for m, st in sorted(((int(m[1]), st) for m, st in found if m and st.getLen() > 0), key=lambda x: -x[0]):
        stream = fs.open(st.getPath())
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("}"):  # else the writer died while it wrote the record
            yield m, json.loads(text)


def commits(spark: SparkSession, root: str) -> dict[int, dict]:
    """The commit record of every version under ``root``, ascending: its folders and what the writer noted."""
    return dict(sorted(newest_first(spark, root)))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions under ``root`` (ascending)."""
    return list(commits(spark, root))


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The highest committed version and its record; (0, {}) when there is none."""
    return next(newest_first(spark, root), (0, {}))


def _commit(spark: SparkSession, root: str, version: int, record: dict) -> None:
    fs, p = _fs(spark, f"{root.rstrip('/')}/commits/{version}.json")
    if fs.exists(p) and version not in commits(spark, root):
        fs.delete(p, False)  # a record that was never finished
    out = fs.create(p, False)  # fails if another writer took the version
    out.write(bytearray(json.dumps(record).encode()))
    out.close()


def write_version(df: DataFrame, root: str, version: int, partition_by: str | None = "agency", note: dict | None = None) -> str:
    """Write ``df`` and commit it as ``version``, with the writer's ``note`` in the commit record."""
    base = root.rstrip("/")
    folder = f"data/{version}-{uuid.uuid4().hex[:12]}"
    w = df.write.mode("errorifexists").option("compression", CODEC)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(f"{base}/{folder}")
    _commit(df.sparkSession, root, version, {"folder": folder, "note": note or {}})
    return f"{base}/{folder}"


# ---------------------------------------------------------------- hash buckets and change log


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, root: str, record: dict, schema: StructType, which: list[int] | None = None) -> DataFrame:
    """The rows of the buckets ``which`` (all by default) of a committed version."""
    base = root.rstrip("/")
    paths = [f"{base}/{folder}/{_BUCKET}={b}" for b, folder in record.get("folders", {}).items() if which is None or int(b) in which]
    if not paths:
        return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).filter(F.lit(False))
    return spark.read.schema(schema).parquet(*paths)


def write_buckets(rows: DataFrame, root: str, version: int, before: dict, touched: list[int], buckets: int,
                  is_change: Column, note: dict | None = None) -> str:
    """Commit ``version``: ``rows`` are the whole new content of the ``touched`` buckets, the others keep the folders
    of ``before`` (a record, {} for none).  The rows for which ``is_change`` holds are appended to the change log.
    Rows that come with a column ``_bucket`` are already laid out by it."""
    spark, base, attempt = rows.sparkSession, root.rstrip("/"), f"{version}-{uuid.uuid4().hex[:12]}"
    if before and before["buckets"] != buckets:
        raise ValueError(f"the table has {before['buckets']} buckets, not {buckets}")
    data = f"data/{attempt}"
    if _BUCKET not in rows.columns:
        rows = rows.withColumn(_BUCKET, bucket_of(F.col("id"), buckets)).repartition(max(1, len(touched)), _BUCKET)
    (rows.withColumn(_LOGGED, F.coalesce(is_change, F.lit(False)))
     .write.mode("errorifexists").option("compression", CODEC).partitionBy(_BUCKET).parquet(f"{base}/{data}"))
    folders = {**before.get("folders", {}), **{str(b): data for b in touched}}
    logs = [*before.get("logs", []), data]
    _commit(spark, root, version, {"buckets": buckets, "folders": folders, "logs": logs, "note": note or {}})
    return f"{base}/{data}"


def change_log(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The appended rows of every committed version, with ``version``; one scan of all log folders."""
    base, (_, record) = root.rstrip("/"), latest(spark, root)
    paths = [f"{base}/{folder}/{_BUCKET}=*" if folder.startswith("data/") else f"{base}/{folder}" for folder in record.get("logs", [])]
    if not paths:
        return spark.createDataFrame([], StructType([*schema.fields])).withColumn("version", F.lit(0))
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:data|log)/(\d+)-[0-9a-f]+/", 1).cast("int")
    marked = StructType([*schema.fields, StructField(_LOGGED, BooleanType())])
    rows = spark.read.schema(marked).parquet(*paths).withColumn("version", number)
    # files of a log folder of its own, as earlier versions of this module wrote them, hold logged rows alone
    return rows.filter(F.coalesce(F.col(_LOGGED), F.lit(True))).select(*schema.names, "version")


def fold_log(log: DataFrame) -> DataFrame:
    """The table that a change log makes: the last row of every id."""
    cols = [c for c in log.columns if c != "version"]
    last = log.groupBy("id").agg(F.max_by(F.struct(*cols), "version").alias("_row"))
    return last.select("_row.*")


def read_current(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """The highest committed version, or None when the catalog has none."""
    version, record = latest(spark, root)
    if not version:
        return None
    base = root.rstrip("/")
    if "folders" in record:
        if schema is None:
            schema = spark.read.parquet(f"{base}/{next(iter(record['folders'].values()))}").drop(_BUCKET, _LOGGED).schema
        return read_buckets(spark, root, record, schema)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(f"{base}/{record['folder']}")


def backup_current(spark: SparkSession, root: str, backups_root: str, run_ts: str) -> str | None:
    """K7: copy the current version under ``backups_root/run_ts=...`` before an update."""
    cur = read_current(spark, root)
    if cur is None:
        return None
    dest = f"{backups_root.rstrip('/')}/run_ts={re.sub(r'[^0-9A-Za-z]', '', run_ts)}"
    cur.write.mode("errorifexists").parquet(dest)
    return dest
