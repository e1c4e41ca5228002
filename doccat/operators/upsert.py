"""Catalog upsert with change tracking (J5, W4, U3, P11, A12, T2; SURVEY 2.12).

``upsert(catalog, batch, run_ts)`` returns the next catalog version:

* ``id`` = given id, else the stable id (F15); ``content_hash`` = F16.
* Duplicates in one batch: the last row (by ``ord``) wins and its change type is
  taken against the previous occurrence (rows are applied one after another).
* Not in the catalog: ``new``, both stamps = ``run_ts``.
* In the catalog: every column but ``id``/``first_seen_at`` comes from the batch;
  ``updated`` when any change field differs null-safely, else ``unchanged``;
  ``last_seen_at`` = ``run_ts``.
* Catalog rows absent from the batch are kept untouched.

Scale: the batch is reduced to its top-2 rows per id with ``row_number() <= 2``,
which Spark's WindowGroupLimit pre-applies map-side, so a hot id never sends
its whole group through one task.  The merge itself is one full outer join on
``id``: both sides shuffle by id once (or not at all when the stored catalog
is bucketed by id), and the batch side keeps the partitioning of the window.
``upsert_in_buckets`` merges into a stored, bucketed catalog: both sides are
shuffled once, by bucket, and the result lies as it is to be written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from doccat.functions.ids import content_hash, stable_id
from doccat.functions.rules import CATALOG_EXPORT_COLUMNS, CHANGE_FIELDS
from doccat.operators.catalog_schema import CATALOG_SCHEMA

CATALOG_COLUMNS = CATALOG_EXPORT_COLUMNS
STAMP_TYPE = "timestamp_ntz"  # UTC wall clock


def _ts(run_ts: str | Column) -> Column:
    return run_ts if isinstance(run_ts, Column) else F.lit(run_ts).cast(STAMP_TYPE)


def prepare_batch(batch: DataFrame) -> DataFrame:
    """Fill ``id`` (given or stable) and ``content_hash``; keep ``ord`` for ordering."""
    given = F.col("id") if "id" in batch.columns else F.lit(None).cast("string")
    sid = stable_id(F.col("agency"), F.col("title"), F.col("source_page_url"), F.col("document_url"))
    out = batch.withColumn("id", F.coalesce(F.when(given != "", given), sid))
    return out.withColumn("content_hash", content_hash())


def _changed(a: str, b: str) -> Column:
    """Null-safe 'any change field differs' between two struct columns."""
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in CHANGE_FIELDS])


def last_two_per_id(batch: DataFrame) -> DataFrame:
    """The last two rows of every id by ``ord`` (``_rn`` 1 and 2); a hot id is cut down before the shuffle."""
    w = Window.partitionBy("id").orderBy(F.col("ord").desc())
    return batch.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)


def last_write_per_id(batch: DataFrame, with_counts: bool = False) -> DataFrame:
    """One row per id (last by ``ord``) plus ``_prev``, the change fields of the previous occurrence.

    ``_prev`` is null when the id occurs once.  One scan of the batch: the top-2
    window (pre-limited map-side by WindowGroupLimit) feeds a per-id aggregate
    that reuses the window's hash partitioning, so no second exchange.  With
    ``with_counts`` a partially aggregated ``_n`` (occurrences) is joined on.
    """
    top2 = last_two_per_id(batch)
    cols = [c for c in batch.columns if c != "id"]
    agg = top2.groupBy("id").agg(
        F.max_by(F.struct(*cols), F.col("ord")).alias("_last"),
        F.min_by(F.struct(*CHANGE_FIELDS), F.col("ord")).alias("_first2"),
        F.count(F.lit(1)).alias("_k"),
    )
    out = agg.select("id", "_last.*", F.when(F.col("_k") == 2, F.col("_first2")).alias("_prev"))
    if with_counts:
        counts = batch.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(counts, "id", "left")
    return out


def upsert(catalog: DataFrame | None, batch: DataFrame, run_ts: str | Column,
           broadcast_ids_limit: int | None = None) -> DataFrame:
    """Merge one batch into the catalog (``None``: there is none yet); returns the full next version (catalog columns).

    When the batch holds at most ``broadcast_ids_limit`` distinct ids (counted
    first), the id set is broadcast: catalog rows the batch does not touch pass
    through an anti join and the touched ones are picked by a semi join, both
    without shuffling the catalog; only the touched part enters the merge.
    Beyond the limit (or with ``None``, the default) one full outer join merges
    everything.  Use the limit when ``catalog`` is a stored version (the stream
    and store path): the split scans it twice, which only pays when the scan is
    cheap compared with shuffling it.
    """
    ts = _ts(run_ts)
    b = last_write_per_id(prepare_batch(batch))
    if broadcast_ids_limit is not None and catalog is not None:
        ids = b.select("id")
        if ids.count() <= broadcast_ids_limit:
            small = F.broadcast(ids)
            untouched = catalog.join(small, "id", "left_anti").select(*CATALOG_COLUMNS)
            touched = catalog.join(small, "id", "left_semi")
            return untouched.unionByName(_merge(touched, b, ts))
    return _merge(catalog, b, ts)


def _merge(catalog: DataFrame | None, b: DataFrame, ts: Column) -> DataFrame:
    """Full outer merge of last-write batch rows ``b`` into ``catalog``.  Without a catalog nothing
    is joined, and the rows keep their partitioning by ``id`` for the next merge."""
    b = b.select("id", F.struct(*[c for c in CATALOG_COLUMNS if c in b.columns and c != "id"]).alias("_b"),
                 F.struct(*CHANGE_FIELDS).alias("_bc"), "_prev")
    if catalog is None:
        none = {n: StructType([f for f in CATALOG_SCHEMA.fields if f.name in names])
                for n, names in (("_c", [x for x in CATALOG_COLUMNS if x != "id"]), ("_cc", CHANGE_FIELDS))}
        j = b.select("*", *[F.lit(None).cast(t).alias(n) for n, t in none.items()])
    else:
        c = catalog.select("id", F.struct(*[x for x in CATALOG_COLUMNS if x != "id"]).alias("_c"),
                           F.struct(*CHANGE_FIELDS).alias("_cc"))
        j = b.join(c, "id", "full_outer")
    in_b = F.col("_b").isNotNull()
    in_c = F.col("_c").isNotNull()
    vs_prev = _changed("_bc", "_prev")
    vs_cat = _changed("_bc", "_cc")
    change = (F.when(~in_b, F.col("_c.change_type"))
              .when(F.col("_prev").isNotNull(), F.when(vs_prev, "updated").otherwise("unchanged"))
              .when(~in_c, F.lit("new"))
              .when(vs_cat, F.lit("updated")).otherwise(F.lit("unchanged")))
    first_seen = F.when(in_c, F.col("_c.first_seen_at")).otherwise(ts)
    last_seen = F.when(in_b, ts).otherwise(F.col("_c.last_seen_at"))
    cols = []
    for name in CATALOG_COLUMNS:
        if name == "id":
            cols.append(F.col("id"))
        elif name == "change_type":
            cols.append(change.alias(name))
        elif name == "first_seen_at":
            cols.append(first_seen.alias(name))
        elif name == "last_seen_at":
            cols.append(last_seen.alias(name))
        else:
            cols.append(F.when(in_b, F.col(f"_b.{name}")).otherwise(F.col(f"_c.{name}")).alias(name))
    return j.select(*cols)


def upsert_in_buckets(catalog: DataFrame, batch: DataFrame, run_ts: str | Column, bucket: Column, parts: int,
                      name: str) -> DataFrame:
    """J5 for a catalog whose ids are unique: ``upsert``, laid out in ``parts`` partitions by ``bucket`` (a column ``name``).

    The old and the new rows of an id, in the order in which they were written, are compared in one window: the
    last is what stays, and its change type is taken against the one before.  ``batch`` is prepared; an id that
    comes very often in it should be cut to its last two rows first.
    """
    ts = _ts(run_ts)
    old = catalog.select(*CATALOG_COLUMNS, F.lit(None).cast(batch.schema["ord"].dataType).alias("ord"), F.lit(False).alias("_new"))
    rows = old.unionByName(batch.select(*CATALOG_COLUMNS, "ord", F.lit(True).alias("_new")))
    rows = rows.withColumn(name, bucket).repartition(parts, name)
    w = Window.partitionBy(name, "id").orderBy("_new", "ord")
    rows = rows.select("*", F.lag(F.struct(*CHANGE_FIELDS)).over(w).alias("_before"), F.lead(F.lit(1)).over(w).alias("_later"),
                       F.first(F.struct("_new", "first_seen_at")).over(w).alias("_first"), F.struct(*CHANGE_FIELDS).alias("_now"))
    set_by_run = {
        "change_type": F.when(F.col("_before").isNull(), F.lit("new")).when(_changed("_now", "_before"), F.lit("updated"))
        .otherwise(F.lit("unchanged")),
        "first_seen_at": F.when(F.col("_first._new"), ts).otherwise(F.col("_first.first_seen_at")),
        "last_seen_at": ts,
    }
    cols = [F.when(F.col("_new"), set_by_run[c]).otherwise(F.col(c)).alias(c) if c in set_by_run else F.col(c) for c in CATALOG_COLUMNS]
    return rows.filter(F.col("_later").isNull()).select(*cols, name)


def empty_catalog(spark) -> DataFrame:
    """An empty catalog with the canonical schema."""
    return spark.createDataFrame([], CATALOG_SCHEMA)


def to_catalog_batch(rows: DataFrame) -> DataFrame:
    """Give adapter rows the catalog columns the batch must carry (stamps are set by upsert)."""
    extra = {
        "content_hash": F.lit(None).cast("string"),
        "first_seen_at": F.lit(None).cast(STAMP_TYPE),
        "last_seen_at": F.lit(None).cast(STAMP_TYPE),
        "change_type": F.lit("unknown"),
    }
    out = rows
    for k, v in extra.items():
        if k not in out.columns:
            out = out.withColumn(k, v)
    if "id" not in out.columns:
        out = out.withColumn("id", F.lit(None).cast("string"))
    if "needs_manual_review" not in out.columns:
        out = out.withColumn("needs_manual_review", F.lit(False))
    return out.select(*CATALOG_COLUMNS, "ord")


def stale_rows(catalog: DataFrame, batch: DataFrame, agencies_crawled: DataFrame | None = None) -> DataFrame:
    """Catalog rows of the crawled agencies that the current batch no longer lists."""
    keys = prepare_batch(batch).select("id").distinct()
    stale = catalog.join(keys, "id", "left_anti")
    if agencies_crawled is not None:
        # agencies come from data: no broadcast hint, AQE picks the join from the runtime size
        stale = stale.join(agencies_crawled.select(F.upper("agency").alias("agency")).distinct(), "agency", "left_semi")
    return stale


def delete_by_agency(catalog: DataFrame, agency: str) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, one-row count of deleted rows) for ``agency`` (upper-cased)."""
    key = agency.upper()
    remaining = catalog.filter(~(F.col("agency") == F.lit(key)) | F.col("agency").isNull())
    deleted = catalog.filter(F.col("agency") == F.lit(key)).agg(F.count(F.lit(1)).alias("deleted"))
    return remaining, deleted


def change_counts(catalog: DataFrame) -> DataFrame:
    """Saved rows per agency and change type."""
    return catalog.groupBy("agency", "change_type").agg(F.count(F.lit(1)).alias("n"))
