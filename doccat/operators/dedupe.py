"""Keep-first dedupe (W2, W3) and unions of overlapping lists.

Keep-first is ``row_number() over (partition by key order by ord) = 1``; Spark
plans it with a partial WindowGroupLimit before the shuffle, so a hot key (the
'no key' group can hold a third of a feed) is cut to one row per map task
before anything moves.  ``dropDuplicates`` is avoided: it keeps an arbitrary row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccat.functions.text import clean_text


def keep_first(df: DataFrame, key: Column, ord_col: str = "ord") -> DataFrame:
    """Rows of ``df`` that are first (by ``ord``) among rows with the same ``key``."""
    w = Window.partitionBy("_key").orderBy(F.col(ord_col).asc())
    return (df.withColumn("_key", key).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn", "_key"))


def url_or_page_title_key(document_url: Column, source_page_url: Column, title: Column) -> Column:
    """W2 key: lower(document URL), else lower('page|title')."""
    return F.lower(F.coalesce(F.when(document_url != "", document_url),
                              F.concat_ws("|", F.coalesce(source_page_url, F.lit("None")),
                                          F.coalesce(title, F.lit("None")))))


def first_id_or_title_key(ids: list[Column], titles: list[Column]) -> Column:
    """W3 key: first non-empty id, else first non-empty title, else '' (no-key rows collapse)."""
    parts = [F.when(clean_text(c) != "", clean_text(c)) for c in ids + titles]
    return F.coalesce(*parts, F.lit(""))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name of per-source frames (missing columns become null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def seed_fallback(crawled: DataFrame, seeds: DataFrame, requested: DataFrame) -> DataFrame:
    """Add seed rows for requested agencies that yielded no crawled rows.

    ``requested`` (agency) is a small list; agencies present in ``crawled`` are
    found with one partial aggregation, so the anti join runs on tiny frames
    (no broadcast hint: AQE chooses from the runtime sizes).
    """
    got = crawled.select(F.upper("agency").alias("agency")).distinct()
    missing = requested.select(F.upper("agency").alias("agency")).distinct().join(got, "agency", "left_anti")
    extra = seeds.join(missing, F.upper(seeds["agency"]) == missing["agency"], "left_semi")
    return crawled.unionByName(extra, allowMissingColumns=True)
