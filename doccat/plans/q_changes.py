"""Audits over feeds, dates and the change log (A2 A7 A9 A11 A12, S2, S5, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccat.functions import dates as DT
from doccat.operators import audit as AU
from doccat.operators.catalog_schema import CATALOG_SCHEMA
from doccat.operators.store import change_log
from doccat.plans import sql as S
from doccat.plans.q_catalog import catalog
from doccat.plans.q_ingest import PAGE_SIZE, landed_fda_pages, landed_ich_trees
from doccat.plans.q_stream import streamed_catalog
from doccat.plans.q_text_dates import _orders_raw_dates, _sql_raw_dates
from doccat.plans.q_upsert import _sql_two_runs
from doccat.plans.registry import register
from doccat.sources import feeds as FD


@register("status_cube", lambda: S.with_catalog(
    """SELECT agency, status_normalized, topic_normalized, GROUPING(agency, status_normalized, topic_normalized)::BIGINT AS level, count(*) AS n
FROM catalog GROUP BY CUBE (agency, status_normalized, topic_normalized)"""))
def status_cube(spark, sf_dir):
    """A11 and A4 in one aggregation: every combination of agency, status and topic, with its grouping level."""
    return AU.facet_cube(catalog(spark, sf_dir), ["agency", "status_normalized", "topic_normalized"])


def _sql_formats(chain: list[str]) -> str:
    """The first format of the chain under which a cleaned text is a date."""
    x = S.clean("raw")
    return "CASE " + " ".join(f"WHEN {S.date_chain(x, [name])} IS NOT NULL THEN {S.q(name)}" for name in chain) + f" WHEN {x} = '' THEN 'empty' ELSE 'rejected' END"


@register("date_format_counts", lambda: f"""WITH {_sql_raw_dates()}
SELECT format, count(*) AS n, min(d) AS first_date, max(d) AS last_date FROM (
  SELECT {_sql_formats(S.CATALOG_CHAIN)} AS format, {S.date_chain(S.clean('raw'), S.CATALOG_CHAIN)} AS d FROM raw_dates) x GROUP BY format""")
def date_format_counts(spark, sf_dir):
    """2.9 ``normalize_dates``: texts per format that parsed them, empty ones and rejects apart."""
    dated = DT.normalize_dates(_orders_raw_dates(spark, sf_dir), {"raw": "month_first"})
    return DT.format_counts(dated, "raw")


@register("date_quarantine", lambda: f"""WITH {_sql_raw_dates()}
SELECT o_orderkey, raw FROM raw_dates WHERE {S.clean('raw')} <> '' AND {S.date_chain(S.clean('raw'), S.CATALOG_CHAIN)} IS NULL""")
def date_quarantine(spark, sf_dir):
    """2.9: the rows whose date text no format parses, from the same pass."""
    dated = DT.normalize_dates(_orders_raw_dates(spark, sf_dir), {"raw": "month_first"})
    return DT.quarantined(dated, ["raw"]).select("o_orderkey", "raw")


@register("paged_totals", lambda: f"""WITH p AS (
  SELECT o_orderkey // {PAGE_SIZE} AS page, count(*) AS n FROM orders WHERE (o_orderkey // {PAGE_SIZE}) % 5 <> 3 GROUP BY 1),
t AS (SELECT count(*) AS total FROM orders)
SELECT 'complete' AS source, (SELECT total FROM t) AS declared_total, (SELECT count(DISTINCT o_orderkey // {PAGE_SIZE}) FROM orders) AS pages,
  (SELECT total FROM t) AS parsed, 0::BIGINT AS missing, 'ok' AS verdict
UNION ALL SELECT 'gaps', (SELECT total FROM t), count(*), sum(n)::BIGINT, ((SELECT total FROM t) - sum(n))::BIGINT,
  CASE WHEN sum(n) = (SELECT total FROM t) THEN 'ok' ELSE 'mismatch' END FROM p""")
def paged_totals(spark, sf_dir):
    """S2 + A7: declared totals of paged feeds against the rows of their landed pages; one feed lacks every fifth page."""
    landed = landed_fda_pages(spark, sf_dir)
    feeds = landed.withColumn("source", F.lit("complete")).unionByName(
        landed.filter(F.col("page") % 5 != 3).withColumn("source", F.lit("gaps")))
    return FD.paged_totals(feeds, "source")


def _damaged_trees(spark, sf_dir):
    """Landed trees of which some are cut short, some have no first item and some hold a text in its place."""
    kind = F.col("tree_id") % 5
    payload = (F.when(kind == 1, F.substring("payload", 1, F.length("payload") - 2))
               .when(kind == 2, F.lit('{"items":[]}')).when(kind == 3, F.lit('{"items":["text"]}')).otherwise(F.col("payload")))
    return landed_ich_trees(spark, sf_dir).select("tree_id", payload.alias("payload"))


@register("tree_rejects", lambda: """SELECT DISTINCT doc_id // 25 AS file,
  CASE (doc_id // 25) % 5 WHEN 1 THEN 'unreadable JSON' ELSE 'no page at $.items[0]' END AS reason
FROM documents WHERE (doc_id // 25) % 5 IN (1, 2, 3)""")
def tree_rejects(spark, sf_dir):
    """Landed tree payloads without a page, with the reason."""
    return FD.tree_rejects(_damaged_trees(spark, sf_dir), "payload", "tree_id").select("file", "reason")


_SCAN = """SELECT {v} AS version, agency, count(*) AS rows, count(nullif(document_url, '')) AS with_document_url,
  count(*) FILTER (change_type = 'new') AS new_rows, count(*) FILTER (change_type = 'updated') AS updated_rows,
  count(*) FILTER (change_type = 'unchanged') AS unchanged_rows, max(last_seen_at) AS last_seen_at FROM v{v} GROUP BY agency"""


@register("metrics_by_version", lambda: _sql_two_runs(_SCAN.format(v=1) + " UNION ALL " + _SCAN.format(v=2)))
def metrics_by_version(spark, sf_dir):
    """A2 + A9 + A12 kept up from the change log: per version and agency, what a scan of that version would count."""
    return AU.metrics_from_log(change_log(spark, streamed_catalog(spark, sf_dir), CATALOG_SCHEMA))
