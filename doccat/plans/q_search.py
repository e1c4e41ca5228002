"""M7: search, facets, metrics, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccat.functions.rules import (
    DASHBOARD_COLUMNS,
    HIGH_PRIORITY_TOPICS,
    LEGACY_RECORD_FIELDS,
    REPORT_COLUMNS,
    WHY_IT_MATTERS,
    WHY_IT_MATTERS_DEFAULT,
)
from doccat.functions.rules import CATALOG_DATE_CHAIN
from doccat.functions.text import clean_text
from doccat.operators import search as OP
from doccat.plans import sql as S
from doccat.plans.q_catalog import catalog
from doccat.plans.q_upsert import _sql_two_runs, catalog_after_v2
from doccat.plans.registry import register
from doccat.sources.adapter import AS_OF_DATE, pick
from doccat.sources.legacy import legacy_records_from_orders
from doccat.sources.tables import table


def legacy_records(spark, sf_dir):
    return legacy_records_from_orders(table(spark, sf_dir, "orders"))


def with_legacy(select: str) -> str:
    return f"WITH legacy AS ({S.legacy_cte()})\n{select}"


def _export_rows(rec):
    """Legacy records under their export headers (K2 names)."""
    return rec.select("ord", *[F.col(f).alias(h) for f, h in LEGACY_RECORD_FIELDS])


def _sql_export_rows() -> str:
    return ", ".join(f'{f} AS "{h}"' for f, h in LEGACY_RECORD_FIELDS)


def _sql_report_rows(src: str) -> str:
    """P12 over a relation that has every export header plus the alias headers."""
    def v(c):
        return f'coalesce(CAST("{c}" AS VARCHAR), \'\')'
    from doccat.functions.rules import REPORT_FALLBACKS
    cols = []
    for name in REPORT_COLUMNS:
        chain = [name] + REPORT_FALLBACKS.get(name, [])
        expr = v(chain[-1])
        for c in reversed(chain[:-1]):
            expr = f"CASE WHEN {v(c)} <> '' THEN {v(c)} ELSE {expr} END"
        cols.append(f'{expr} AS "{name}"')
    return f"SELECT ord, {', '.join(cols)} FROM {src}"


# Relation with every header the report may look at (missing ones are NULL).
_ALL_HEADERS = [h for _f, h in LEGACY_RECORD_FIELDS] + ["Authority", "Authority Organization",
                                                        "Organization / Committee", "Document Link"]


def _sql_export_all_headers() -> str:
    have = {h: f for f, h in LEGACY_RECORD_FIELDS}
    cols = [f'{have[h]} AS "{h}"' if h in have else f'CAST(NULL AS VARCHAR) AS "{h}"' for h in _ALL_HEADERS]
    return f"SELECT ord, {', '.join(cols)} FROM legacy"


@register("search_catalog", lambda: S.with_catalog(
    "SELECT doc_id, title, agency FROM catalog WHERE agency IN ('FDA', 'EMA', 'ICH') AND contains(lower("
    "' ' || coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(topic_normalized, '') || ' ' "
    "|| coalesce(agency, '')), 'trial')"))
def search_catalog(spark, sf_dir):
    """P4 + P5: agency facet and keyword search over title, summary, topic and agency."""
    c = OP.facet_filter(catalog(spark, sf_dir), {"agency": ["FDA", "EMA", "ICH"], "status_normalized": []})
    c = OP.text_filter(c, ["title", "summary", "topic_normalized", "agency"], "Trial")
    return c.select("doc_id", "title", "agency")


@register("title_search", lambda: S.with_catalog(
    "SELECT doc_id, title FROM catalog WHERE contains(lower(' ' || coalesce(title, '')), 'vaccine')"))
def title_search(spark, sf_dir):
    """P5 on the title alone."""
    return OP.text_filter(catalog(spark, sf_dir), ["title"], "Vaccine").select("doc_id", "title")


@register("date_range_keep_null", lambda: S.with_catalog(
    "SELECT doc_id, published_date FROM catalog WHERE published_date IS NULL OR "
    "published_date BETWEEN DATE '2021-01-01' AND DATE '2023-12-31'"))
def date_range_keep_null(spark, sf_dir):
    """Date-range filter that keeps rows without a date."""
    return OP.date_range_keep_null(catalog(spark, sf_dir), "published_date", "2021-01-01", "2023-12-31").select(
        "doc_id", "published_date")


@register("facet_options", lambda: S.with_catalog(
    "SELECT facet, value, count(*) AS n FROM (SELECT 'agency' AS facet, agency AS value FROM catalog UNION ALL "
    "SELECT 'status_normalized', status_normalized FROM catalog UNION ALL SELECT 'topic_normalized', topic_normalized "
    "FROM catalog) WHERE value IS NOT NULL AND value <> '' GROUP BY ALL"))
def facet_options(spark, sf_dir):
    """A4: sorted distinct non-empty facet values with counts, one scan."""
    return OP.facet_options(catalog(spark, sf_dir), ["agency", "status_normalized", "topic_normalized"])


def _events_stamps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    raw = (F.when(F.col("event_id") % 50 == 0, F.lit("n/a")).when(F.col("event_id") % 77 == 0, F.lit(None))
           .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")))
    return e.select(F.col("event_type").alias("agency"), raw.alias("last_seen_at"))


_SQL_EVENTS_STATUS = """WITH st AS (
  SELECT event_type AS agency, CASE WHEN event_id % 50 = 0 THEN 'n/a' WHEN event_id % 77 = 0 THEN NULL
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS last_seen_at FROM events),
g AS (SELECT agency, count(*) AS records, max(try_cast(last_seen_at AS TIMESTAMP)) AS mx FROM st
      WHERE agency IS NOT NULL GROUP BY agency),
r AS (SELECT agency, records, coalesce(strftime(mx, '%Y-%m-%d %H:%M') || ' UTC', 'Not available.') AS last_crawled_utc FROM g)
"""


@register("refresh_status", lambda: _SQL_EVENTS_STATUS + "SELECT * FROM r")
def refresh_status(spark, sf_dir):
    """A2 + L3: rows and latest parseable stamp per key (events per event type)."""
    return OP.refresh_status(_events_stamps(spark, sf_dir))


@register("refresh_status_text", lambda: _SQL_EVENTS_STATUS +
          "SELECT 'Last crawled by agency: ' || string_agg(agency || ' ' || last_crawled_utc, ' | ' ORDER BY agency) AS caption FROM r")
def refresh_status_text(spark, sf_dir):
    """A2 caption line, agencies in order."""
    return OP.refresh_status_text(OP.refresh_status(_events_stamps(spark, sf_dir)))


@register("date_bounds", lambda: S.with_catalog(
    "SELECT min(published_date) AS min_date, max(published_date) AS max_date FROM catalog"))
def date_bounds(spark, sf_dir):
    """A5: published-date bounds."""
    return OP.date_bounds(catalog(spark, sf_dir), "published_date")


@register("dashboard_metrics", lambda: S.with_catalog(
    "SELECT count(*) AS total, count(*) FILTER (WHERE status_normalized = 'final') AS final, "
    "count(*) FILTER (WHERE status_normalized = 'draft') AS draft, "
    "count(*) FILTER (WHERE status_normalized = 'open_for_comment') AS open_for_comment FROM catalog"))
def dashboard_metrics(spark, sf_dir):
    """A1: status counters."""
    return OP.metrics(catalog(spark, sf_dir))


@register("report_metrics", lambda: with_legacy(
    f"""SELECT count(*) AS records, count(DISTINCT nullif("Health Authority", '')) AS authorities,
  count(*) FILTER (WHERE "Open for Comment" = 'Yes') AS open, count(DISTINCT nullif("Topic", '')) AS topics
FROM ({_sql_report_rows(f'({_sql_export_all_headers()})')}) r"""))
def report_metrics(spark, sf_dir):
    """A3: distinct-value metrics of the report rows."""
    return OP.distinct_metrics(OP.report_rows(_export_rows(legacy_records(spark, sf_dir))))


@register("report_counters", lambda: _sql_two_runs(
    "SELECT count(*) AS total, count(*) FILTER (WHERE change_type = 'new') AS new, "
    "count(*) FILTER (WHERE change_type = 'updated') AS updated, "
    "count(*) FILTER (WHERE status_normalized = 'open_for_comment') AS open, "
    f"count(*) FILTER (WHERE topic_normalized IN ({', '.join(S.q(t) for t in HIGH_PRIORITY_TOPICS)})) AS high_priority FROM v2"))
def report_counters(spark, sf_dir):
    """The report's five counters on the catalog after two runs."""
    return OP.report_counters(catalog_after_v2(spark, sf_dir))


@register("newest_first_topk", lambda: with_legacy(
    "SELECT ord, issue_date, guidance_name FROM legacy ORDER BY coalesce(issue_date, '') DESC, ord ASC LIMIT 50"))
def newest_first_topk(spark, sf_dir):
    """L1: newest 50 by the date text, blanks last, ties in feed order (a top-k report)."""
    return OP.newest_first(legacy_records(spark, sf_dir), 50).select("ord", "issue_date", "guidance_name")


@register("feed_first_n", lambda: with_legacy("SELECT ord, guidance_name FROM legacy ORDER BY ord LIMIT 100"))
def feed_first_n(spark, sf_dir):
    """L2: the first 100 records in feed order (the cap is the feature)."""
    return OP.first_n(legacy_records(spark, sf_dir), 100).select("ord", "guidance_name")


@register("high_priority", lambda: S.with_catalog(
    f"""SELECT doc_id, topic_normalized, coalesce(w.why, {S.q(WHY_IT_MATTERS_DEFAULT)}) AS why FROM catalog c
LEFT JOIN (VALUES {', '.join(f'({S.q(k)}, {S.q(v)})' for k, v in WHY_IT_MATTERS.items())}) w(t, why) ON c.topic_normalized = w.t
WHERE c.topic_normalized IN ({', '.join(S.q(t) for t in HIGH_PRIORITY_TOPICS)})"""))
def high_priority(spark, sf_dir):
    """J6 + J7: high-priority rows with their rationale."""
    return OP.high_priority(spark, catalog(spark, sf_dir)).select("doc_id", "topic_normalized", "why")


def _sql_legacy_to_catalog() -> str:
    pd = S.date_chain(S.clean("issue_date"), CATALOG_DATE_CHAIN)
    ed = S.date_chain(S.clean("comment_closing_date_on_draft"), CATALOG_DATE_CHAIN)
    idx = S.status_index("title", "status_raw", "agency", "comment_end_date")
    return with_legacy(f"""SELECT *, {S.status_of('_i')} AS status_normalized, {S.sub_status_of('_i')} AS sub_status,
  {S.topic('title', 'topic_raw', 'summary')} AS topic_normalized FROM (
SELECT *, {idx} AS _i FROM (
SELECT ord, guidance_name AS title, 'FDA' AS agency, 'US' AS jurisdiction, nullif(guidance_page_link, '') AS source_page_url,
  nullif(guidance_pdf_link, '') AS document_url, CASE WHEN coalesce(guidance_pdf_link, '') <> '' THEN 'PDF' END AS document_format,
  {pd} AS published_date, {ed} AS comment_end_date, guidance_status AS status_raw, topic AS topic_raw, summary,
  'EN' AS language, nullif(docket_number, '') AS reference_number, false AS needs_manual_review FROM legacy) a) b""")


def _drop_i(sql: str) -> str:
    return f"SELECT * EXCLUDE (_i) FROM ({sql})"


@register("legacy_to_catalog", lambda: _drop_i(_sql_legacy_to_catalog()))
def legacy_to_catalog(spark, sf_dir):
    """Legacy records mapped to catalog rows (status with as_of, topic, PDF format)."""
    return OP.legacy_to_catalog(legacy_records(spark, sf_dir), AS_OF_DATE)


@register("dashboard_search", lambda: with_legacy(
    f"""SELECT * FROM ({_sql_report_rows(f'({_sql_export_all_headers()})')}) r
WHERE contains(lower(concat_ws(' ', "Health Authority", "Guidance Name", "Summary", "Organization / Committee", "Topic",
  "Guidance Status")), 'bayesian guidance') AND "Health Authority" = 'FDA' AND "Organization / Committee" = 'CDER'
  AND NOT ("Open for Comment" = 'Yes')"""))
def dashboard_search(spark, sf_dir):
    """Trimmed query over six fields, equality filters, comments 'Closed'."""
    rows = OP.report_rows(_export_rows(legacy_records(spark, sf_dir)), keep=["ord"])
    return OP.dashboard_filter(rows, query="  Bayesian guidance ", authority="FDA", organization="CDER",
                               comments="Closed")


@register("header_alias_projection", lambda: with_legacy(
    _sql_report_rows(f"""(SELECT ord,
  CASE WHEN ord % 2 = 0 THEN "Health Authority" END AS "Health Authority",
  CASE WHEN ord % 2 = 1 THEN "Health Authority" END AS "Authority",
  "Guidance Name", "Summary", "Issue Date",
  CASE WHEN ord % 2 = 0 THEN "FDA Organization" END AS "FDA Organization",
  CASE WHEN ord % 2 = 1 THEN "FDA Organization" END AS "Authority Organization",
  "Topic", "Guidance Status", "Open for Comment", "Comment Closing Date on Draft",
  CASE WHEN ord % 3 = 0 THEN '' ELSE "Guidance PDF Link" END AS "Guidance PDF Link", "Guidance Page Link",
  CAST(NULL AS VARCHAR) AS "Organization / Committee", CAST(NULL AS VARCHAR) AS "Document Link"
FROM ({_sql_export_all_headers()}) e)""")))
def header_alias_projection(spark, sf_dir):
    """P12 + U4: two export dialects (half with 'Authority' headers) unioned by name, then aliased."""
    rows = _export_rows(legacy_records(spark, sf_dir))
    rows = rows.withColumn("Guidance PDF Link", F.when(F.col("ord") % 3 == 0, F.lit("")).otherwise(F.col("`Guidance PDF Link`")))
    even = rows.filter(F.col("ord") % 2 == 0)
    odd = (rows.filter(F.col("ord") % 2 == 1)
           .withColumnRenamed("Health Authority", "Authority")
           .withColumnRenamed("FDA Organization", "Authority Organization"))
    both = even.unionByName(odd, allowMissingColumns=True)
    return OP.report_rows(both, keep=["ord"])


@register("required_fields", """SELECT doc_id,
  CASE WHEN trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')) = '' OR doc_id % 10 = 3 THEN
    CASE WHEN trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')) = '' THEN 'missing title' ELSE 'missing url' END
  END AS reject_reason FROM documents""")
def required_fields(spark, sf_dir):
    """Rows without title or URL are routed aside with a reason instead of dropped silently."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("title"),
        F.when(F.col("doc_id") % 10 == 3, F.lit(" ")).otherwise(F.lit("https://example.org/x")).alias("url"))
    return OP.required_fields(d, ["title", "url"]).select("doc_id", "reject_reason")


@register("scientific_filter", lambda: S.with_catalog(
    f"""SELECT doc_id, t, u FROM (SELECT doc_id, title || {S.lst([' - Scientific guideline', '', ' scientific GUIDELINE'])}[doc_id % 3 + 1] AS t,
  source_page_url || {S.lst(['', '-scientific-guideline', '-guideline'])}[doc_id % 5 % 3 + 1] AS u FROM catalog) x
WHERE contains(lower({S.clean('t')}), 'scientific guideline') OR ends_with(lower({S.clean('u')}), '-scientific-guideline')"""))
def scientific_filter(spark, sf_dir):
    """Legacy scientific-guideline filter (title text or URL suffix)."""
    c = catalog(spark, sf_dir)
    x = c.select("doc_id",
                 F.concat("title", pick([" - Scientific guideline", "", " scientific GUIDELINE"], F.col("doc_id") % 3)).alias("t"),
                 F.concat("source_page_url", pick(["", "-scientific-guideline", "-guideline"], F.col("doc_id") % 5 % 3)).alias("u"))
    return x.filter(OP.scientific_guideline(F.col("t"), F.col("u")))


_AREAS = ["化学药", "生物制品", "中药", "", "化学药品注册", None]


@register("product_area_filter", f"""SELECT doc_id, area FROM (SELECT doc_id, {S.lst(_AREAS)}[doc_id % 6 + 1] AS area FROM documents) x
WHERE {S.clean('area')} = '' OR contains({S.clean('area')}, '化学药') OR contains({S.clean('area')}, '生物制品')""")
def product_area_filter(spark, sf_dir):
    """Drop an item only when its area is non-empty and matches no allowed area."""
    d = table(spark, sf_dir, "documents").select("doc_id", pick(_AREAS, F.col("doc_id") % 6).alias("area"))
    return d.filter(OP.product_area_allowed(F.col("area")))


@register("catalog_projection", lambda: _sql_two_runs(
    f"SELECT {', '.join(DASHBOARD_COLUMNS)} FROM v2"))
def catalog_projection(spark, sf_dir):
    """Catalog scan projected to the 14 dashboard columns (Catalyst prunes the rest)."""
    return catalog_after_v2(spark, sf_dir).select(*DASHBOARD_COLUMNS)
