"""M3: catalog upsert across two runs.

Batches (SURVEY 7.2): v1 = doc_id % 9 <> 8 at 2024-06-01; v2 = doc_id % 9 <> 2 at
2024-06-08 with summary changed when doc_id % 7 = 0, status changed when % 11 = 0
and one later duplicate (summary ' (dup)') when % 31 = 0.  ``id`` is derived from
doc_id so title/URL collisions do not merge rows here.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from doccat.functions.rules import CATALOG_EXPORT_COLUMNS, CHANGE_FIELDS
from doccat.operators.upsert import (
    change_counts,
    delete_by_agency,
    last_write_per_id,
    prepare_batch,
    stale_rows,
    to_catalog_batch,
    upsert,
)
from doccat.plans import sql as S
from doccat.plans.q_catalog import catalog
from doccat.plans.registry import register
from doccat.sources.adapter import RUN_TS_V1, RUN_TS_V2

BATCH_FIELDS = [c for c in CATALOG_EXPORT_COLUMNS
                if c not in ("id", "content_hash", "first_seen_at", "last_seen_at", "change_type")]


def _with_id(df):
    return df.withColumn("id", F.lpad(F.hex(F.col("doc_id")), 24, "0")).withColumn("ord", F.col("ord") * 2)


def batch_v1(spark, sf_dir, rows=None):
    c = (catalog(spark, sf_dir) if rows is None else rows).filter(F.col("doc_id") % 9 != 8)
    return to_catalog_batch(_with_id(c))


def batch_v2(spark, sf_dir, rows=None):
    c = (catalog(spark, sf_dir) if rows is None else rows).filter(F.col("doc_id") % 9 != 2)
    c = c.withColumn("summary", F.when(F.col("doc_id") % 7 == 0, F.concat("summary", F.lit(" (revised)")))
                     .otherwise(F.col("summary")))
    c = c.withColumn("status_normalized", F.when(F.col("doc_id") % 11 == 0, F.lit("withdrawn"))
                     .otherwise(F.col("status_normalized")))
    c = _with_id(c)
    twice = F.when(F.col("doc_id") % 31 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    c = c.withColumn("_dup", F.explode(twice))  # the table is scanned once for the rows and their later duplicates
    c = c.withColumn("summary", F.when(F.col("_dup") == 1, F.concat("summary", F.lit(" (dup)"))).otherwise(F.col("summary")))
    return to_catalog_batch(c.withColumn("ord", F.col("ord") + F.col("_dup")).drop("_dup"))


def catalog_after_v1(spark, sf_dir, rows=None):
    return upsert(None, batch_v1(spark, sf_dir, rows), RUN_TS_V1)


def catalog_after_v2(spark, sf_dir, rows=None):
    """The catalog after both runs; ``rows`` (the adapted rows) when they are written already, so that they are not made twice."""
    return upsert(catalog_after_v1(spark, sf_dir, rows), batch_v2(spark, sf_dir, rows), RUN_TS_V2)


# ---------------------------------------------------------------- DuckDB mirror


def _sql_batches() -> str:
    f = ", ".join(BATCH_FIELDS)
    f2 = ", ".join(
        "CASE WHEN doc_id % 7 = 0 THEN summary || ' (revised)' ELSE summary END AS summary" if x == "summary" else
        "CASE WHEN doc_id % 11 = 0 THEN 'withdrawn' ELSE status_normalized END AS status_normalized"
        if x == "status_normalized" else x for x in BATCH_FIELDS)
    fdup = ", ".join("summary || ' (dup)' AS summary" if x == "summary" else x for x in BATCH_FIELDS)
    return f"""catalog AS ({S.catalog_cte()}),
b1 AS (SELECT lpad(hex(doc_id), 24, '0') AS id, ord * 2 AS ord, {f} FROM catalog WHERE doc_id % 9 <> 8),
b2x AS (SELECT doc_id, lpad(hex(doc_id), 24, '0') AS id, ord * 2 AS ord, {f2} FROM catalog WHERE doc_id % 9 <> 2),
b2 AS (SELECT id, ord, {f} FROM b2x UNION ALL SELECT id, ord + 1 AS ord, {fdup} FROM b2x WHERE doc_id % 31 = 0)"""


def _sql_upsert(name: str, cat: str | None, batch: str, ts: str) -> str:
    """CTEs computing ``name`` = upsert(cat, batch, ts)."""
    tsl = f"CAST({S.q(ts)} AS TIMESTAMP)"
    ch = S.content_hash()
    prev_cols = ", ".join(f"{c} AS p_{c}" for c in CHANGE_FIELDS)
    out = [f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM {batch}),
{name}_l AS (SELECT *, {ch} AS content_hash FROM {name}_r WHERE rn = 1),
{name}_p AS (SELECT id, {prev_cols} FROM {name}_r WHERE rn = 2),
{name}_b AS (SELECT l.*, p.p_title IS NOT NULL OR p.id IS NOT NULL AS has_prev,
  {' OR '.join(f'l.{c} IS DISTINCT FROM p.p_{c}' for c in CHANGE_FIELDS)} AS diff_prev
  FROM {name}_l l LEFT JOIN {name}_p p ON l.id = p.id)"""]
    if cat is None:
        sel = []
        for c in CATALOG_EXPORT_COLUMNS:
            if c == "change_type":
                sel.append("CASE WHEN has_prev THEN CASE WHEN diff_prev THEN 'updated' ELSE 'unchanged' END ELSE 'new' END AS change_type")
            elif c in ("first_seen_at", "last_seen_at"):
                sel.append(f"{tsl} AS {c}")
            else:
                sel.append(c)
        out.append(f"{name} AS (SELECT {', '.join(sel)} FROM {name}_b)")
    else:
        sel = []
        for c in CATALOG_EXPORT_COLUMNS:
            if c == "id":
                sel.append("coalesce(b.id, c.id) AS id")
            elif c == "change_type":
                diff_cat = " OR ".join(f"b.{x} IS DISTINCT FROM c.{x}" for x in CHANGE_FIELDS)
                sel.append(f"""CASE WHEN b.id IS NULL THEN c.change_type
  WHEN b.has_prev THEN CASE WHEN b.diff_prev THEN 'updated' ELSE 'unchanged' END
  WHEN c.id IS NULL THEN 'new' WHEN {diff_cat} THEN 'updated' ELSE 'unchanged' END AS change_type""")
            elif c == "first_seen_at":
                sel.append(f"CASE WHEN c.id IS NOT NULL THEN c.first_seen_at ELSE {tsl} END AS first_seen_at")
            elif c == "last_seen_at":
                sel.append(f"CASE WHEN b.id IS NOT NULL THEN {tsl} ELSE c.last_seen_at END AS last_seen_at")
            else:
                sel.append(f"CASE WHEN b.id IS NOT NULL THEN b.{c} ELSE c.{c} END AS {c}")
        out.append(f"{name} AS (SELECT {', '.join(sel)} FROM {name}_b b FULL OUTER JOIN {cat} c ON b.id = c.id)")
    return ",\n".join(out)


def _sql_two_runs(select: str) -> str:
    return (f"WITH {_sql_batches()},\n{_sql_upsert('v1', None, 'b1', RUN_TS_V1)},\n"
            f"{_sql_upsert('v2', 'v1', 'b2', RUN_TS_V2)}\n{select}")


# ---------------------------------------------------------------- queries


@register("upsert_new_catalog", lambda: _sql_two_runs("SELECT * FROM v2"))
def upsert_new_catalog(spark, sf_dir):
    """The catalog after run v1 then run v2 (every catalog column)."""
    return catalog_after_v2(spark, sf_dir)


@register("upsert_change_counts", lambda: _sql_two_runs(
    "SELECT agency, change_type, count(*) AS n FROM v2 GROUP BY ALL"))
def upsert_change_counts(spark, sf_dir):
    """Rows per agency and change type after two runs."""
    return change_counts(catalog_after_v2(spark, sf_dir))


@register("batch_last_write", lambda: f"""WITH {_sql_batches()},
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn, count(*) OVER (PARTITION BY id) AS n FROM b2),
p AS (SELECT id, {', '.join(f'{c} AS p_{c}' for c in CHANGE_FIELDS)} FROM r WHERE rn = 2)
SELECT r.id, r.ord, r.summary, r.n AS n_occurrences,
  CASE WHEN p.id IS NULL THEN NULL ELSE ({' OR '.join(f'r.{c} IS DISTINCT FROM p.p_{c}' for c in CHANGE_FIELDS)}) END AS changed_vs_prev
FROM r LEFT JOIN p ON r.id = p.id WHERE r.rn = 1""")
def batch_last_write(spark, sf_dir):
    """Last write per id inside batch v2 and whether it differs from the previous occurrence."""
    b = last_write_per_id(prepare_batch(batch_v2(spark, sf_dir)), with_counts=True)
    diff = None
    for c in CHANGE_FIELDS:
        term = ~F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
        diff = term if diff is None else diff | term
    return b.select("id", "ord", "summary", F.col("_n").alias("n_occurrences"),
                    F.when(F.col("_prev").isNotNull(), diff).alias("changed_vs_prev"))


@register("stale_rows", lambda: _sql_two_runs(
    "SELECT id, agency, title FROM v1 WHERE id NOT IN (SELECT id FROM b2) "
    "AND agency IN (SELECT DISTINCT upper(agency) FROM b2)"))
def stale_rows_query(spark, sf_dir):
    """Rows of catalog v1 that run v2 (same agencies) no longer lists."""
    b2 = batch_v2(spark, sf_dir)
    return stale_rows(catalog_after_v1(spark, sf_dir), b2, b2.select("agency")).select("id", "agency", "title")


@register("delete_agency", lambda: _sql_two_runs(
    "SELECT agency, count(*) AS n, (SELECT count(*) FROM v2 WHERE agency = 'EMA') AS deleted "
    "FROM v2 WHERE agency IS NULL OR agency <> 'EMA' GROUP BY ALL"))
def delete_agency(spark, sf_dir):
    """The whole catalog (runs v1 and v2) without agency 'ema' (upper-cased): remaining rows per agency + deleted count."""
    remaining, deleted = delete_by_agency(catalog_after_v2(spark, sf_dir), "ema")
    return remaining.groupBy("agency").agg(F.count(F.lit(1)).alias("n")).crossJoin(deleted)


def change_feed(runs):
    """Per (id, run) the change type each run assigns, from the batches alone.

    ``runs`` is a list of (run number, batch).  Within a run the last write wins
    (W4, compared with the previous occurrence); across runs the run's row is
    compared with the id's row of the previous run it appeared in (``lag``).
    The lag window holds one row per (id, run), so groups are bounded by runs.
    """
    frames = []
    for run, b in runs:
        lw = last_write_per_id(prepare_batch(b))
        frames.append(lw.select("id", F.lit(run).alias("run"), *CHANGE_FIELDS, "_prev"))
    allr = frames[0]
    for f in frames[1:]:
        allr = allr.unionByName(f)
    w = Window.partitionBy("id").orderBy("run")
    allr = allr.withColumn("_before", F.lag(F.struct(*CHANGE_FIELDS)).over(w))
    diff_prev = None
    diff_before = None
    for c in CHANGE_FIELDS:
        t1 = ~F.col(c).eqNullSafe(F.col(f"_prev.{c}"))
        t2 = ~F.col(c).eqNullSafe(F.col(f"_before.{c}"))
        diff_prev = t1 if diff_prev is None else diff_prev | t1
        diff_before = t2 if diff_before is None else diff_before | t2
    change = (F.when(F.col("_prev").isNotNull(), F.when(diff_prev, "updated").otherwise("unchanged"))
              .when(F.col("_before").isNull(), F.lit("new"))
              .when(diff_before, F.lit("updated")).otherwise(F.lit("unchanged")))
    return allr.select("id", "run", change.alias("change_type"))


def change_feed_sql() -> str:
    return f"""WITH {_sql_batches()},
r AS (SELECT 1 AS run, *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM b1
      UNION ALL SELECT 2 AS run, *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM b2),
l AS (SELECT r.*, p.id IS NOT NULL AS has_prev,
        {' OR '.join(f'r.{c} IS DISTINCT FROM p.{c}' for c in CHANGE_FIELDS)} AS diff_prev
      FROM r LEFT JOIN r p ON p.id = r.id AND p.run = r.run AND p.rn = 2 WHERE r.rn = 1),
g AS (SELECT *, lag(struct_pack({', '.join(f'{c} := {c}' for c in CHANGE_FIELDS)})) OVER (PARTITION BY id ORDER BY run) AS bf FROM l)
SELECT id, run, CASE WHEN has_prev THEN CASE WHEN diff_prev THEN 'updated' ELSE 'unchanged' END
  WHEN bf IS NULL THEN 'new'
  WHEN {' OR '.join(f'{c} IS DISTINCT FROM bf.{c}' for c in CHANGE_FIELDS)} THEN 'updated' ELSE 'unchanged' END AS change_type
FROM g"""


@register("change_feed", change_feed_sql)
def change_feed_query(spark, sf_dir):
    """Run-to-run change feed over runs v1 and v2."""
    return change_feed([(1, batch_v1(spark, sf_dir)), (2, batch_v2(spark, sf_dir))])
