"""M9: exports (K1-K6) and the CSV round trip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from doccat.functions.rules import (
    CATALOG_EXPORT_COLUMNS,
    HIGH_PRIORITY_TOPICS,
    LEGACY_RECORD_FIELDS,
    REPORT_COLUMNS,
    REPORT_SECTIONS,
    REPORT_TITLE,
    SELECTED_EXPORT_COLUMNS,
    WHY_IT_MATTERS,
    WHY_IT_MATTERS_DEFAULT,
)
from doccat.operators import export as EX
from doccat.operators import search as OP
from doccat.plans import sql as S
from doccat.plans.q_search import _export_rows, _sql_export_all_headers, _sql_report_rows, legacy_records, with_legacy
from doccat.plans.q_upsert import _sql_two_runs, catalog_after_v2
from doccat.plans.registry import register
from doccat.session import scratch_path

GENERATED_AT = "2024-06-08 00:00"
_BOOL = {"needs_manual_review"}
_STAMP = {"first_seen_at", "last_seen_at"}
_DATE = {"published_date", "updated_date", "comment_start_date", "comment_end_date"}


def _sql_text(c: str) -> str:
    if c in _BOOL:
        return f"CASE WHEN {c} THEN 'True' ELSE '' END AS {c}"
    if c in _STAMP:
        return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '') AS {c}"
    return f"coalesce(CAST({c} AS VARCHAR), '') AS {c}"


@register("csv_export_projection", lambda: _sql_two_runs(
    f"SELECT {', '.join(_sql_text(c) for c in CATALOG_EXPORT_COLUMNS)} FROM v2"))
def csv_export_projection(spark, sf_dir):
    """K1: the 25-column export of the catalog, every value as text, falsy -> ''."""
    return EX.catalog_csv_rows(catalog_after_v2(spark, sf_dir))


@register("legacy_csv_rows", lambda: with_legacy(
    "SELECT " + ", ".join(f'{f} AS "{h}"' for f, h in LEGACY_RECORD_FIELDS) + " FROM legacy"))
def legacy_csv_rows(spark, sf_dir):
    """K2: legacy records under the 12 export headers."""
    return EX.legacy_csv_rows(legacy_records(spark, sf_dir))


@register("json_export", lambda: with_legacy(
    "SELECT ord, CAST(to_json(struct_pack(" + ", ".join(f"{f} := {f}" for f, _h in LEGACY_RECORD_FIELDS) + ")) AS VARCHAR) AS json FROM legacy"))
def json_export(spark, sf_dir):
    """K3: legacy records as JSON objects (snake_case keys, non-ASCII kept)."""
    return EX.json_lines(legacy_records(spark, sf_dir), keep=["ord"])


def _sql_markdown() -> str:
    esc = "replace(title, '|', '\\|')"
    link = ("CASE WHEN coalesce(nullif(document_url, ''), nullif(source_page_url, ''), '') <> '' THEN '[Link](' || "
            "coalesce(nullif(document_url, ''), nullif(source_page_url, '')) || ')' ELSE '' END")
    why = ("coalesce(CASE topic_normalized " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in WHY_IT_MATTERS.items())
           + f" END, {S.q(WHY_IT_MATTERS_DEFAULT)})")
    hp = ", ".join(S.q(t) for t in HIGH_PRIORITY_TOPICS)
    fixed = [(0, 0, REPORT_TITLE), (0, 1, f"Generated at: {GENERATED_AT}"), (0, 2, ""), (0, 3, "## Executive Summary")]
    for i, (_k, heading, cols, sep) in enumerate(REPORT_SECTIONS, start=1):
        fixed += [(i, -4, ""), (i, -3, heading), (i, -2, cols), (i, -1, sep)]
    fixed.append((len(REPORT_SECTIONS) + 1, 0, ""))
    vals = ", ".join(f"({a}, {b}, {S.q(c)})" for a, b, c in fixed)
    return f"""SELECT * FROM (VALUES {vals}) f(section, ord, line)
UNION ALL SELECT 0, 4, '- Total documents: ' || CAST(count(*) AS VARCHAR) FROM v2
UNION ALL SELECT 0, 5, '- New documents: ' || CAST(count(*) FILTER (WHERE change_type = 'new') AS VARCHAR) FROM v2
UNION ALL SELECT 0, 6, '- Updated documents: ' || CAST(count(*) FILTER (WHERE change_type = 'updated') AS VARCHAR) FROM v2
UNION ALL SELECT 0, 7, '- Open for comment: ' || CAST(count(*) FILTER (WHERE status_normalized = 'open_for_comment') AS VARCHAR) FROM v2
UNION ALL SELECT 0, 8, '- High-priority documents: ' || CAST(count(*) FILTER (WHERE topic_normalized IN ({hp})) AS VARCHAR) FROM v2
UNION ALL SELECT 1, ord, '| ' || agency || ' | ' || {esc} || ' | ' || status_normalized || ' | ' || coalesce(CAST(published_date AS VARCHAR), '')
  || ' | ' || coalesce(topic_normalized, '') || ' | ' || {link} || ' |' FROM v2 WHERE change_type = 'new'
UNION ALL SELECT 2, ord, '| ' || agency || ' | ' || {esc} || ' | ' || coalesce(CAST(comment_end_date AS VARCHAR), '')
  || ' | ' || coalesce(topic_normalized, '') || ' | ' || {link} || ' |' FROM v2 WHERE status_normalized = 'open_for_comment'
UNION ALL SELECT 3, ord, '| ' || agency || ' | ' || {esc} || ' | ' || status_normalized || ' | ' || coalesce(topic_normalized, '')
  || ' | ' || replace({why}, '|', '\\|') || ' |' FROM v2 WHERE topic_normalized IN ({hp})"""


def _catalog_v2_with_ord(spark, sf_dir):
    return catalog_after_v2(spark, sf_dir).withColumn("ord", F.conv(F.col("id"), 16, 10).cast("long"))


@register("markdown_lines", lambda: _sql_two_runs(
    "SELECT section, ord, line FROM (SELECT * FROM (" + _sql_markdown().replace("FROM v2", "FROM v2o") + ")) x")
    .replace("\nSELECT section, ord", ", v2o AS (SELECT *, CAST(('0x' || id) AS BIGINT) AS ord FROM v2)\nSELECT section, ord"))
def markdown_lines(spark, sf_dir):
    """K4: Markdown report lines (section, ord, line) over the catalog after two runs."""
    return EX.markdown_lines(spark, _catalog_v2_with_ord(spark, sf_dir), GENERATED_AT)


@register("html_payload", lambda: with_legacy(
    f"""SELECT ord, replace(to_json(struct_pack({', '.join(f'"{c}" := "{c}"' for c in REPORT_COLUMNS)})), '</', '<\\/') AS row_json
FROM ({_sql_report_rows(f'({_sql_export_all_headers()})')}) r"""))
def html_payload(spark, sf_dir):
    """K5: dashboard rows as script-safe JSON objects."""
    rows = OP.report_rows(_export_rows(legacy_records(spark, sf_dir)), keep=["ord"])
    return EX.html_payload_rows(rows, keep=["ord"])


_SELECTION = [(0, 1), (1, 99), (2, None), (3, 5), (4, 5), (5, 10 ** 9), (6, -1), (7, 0)]


@register("selected_export", lambda: _sql_two_runs(
    f"""SELECT s.pick, {', '.join('r.' + c for c in SELECTED_EXPORT_COLUMNS)} FROM
  (SELECT *, row_number() OVER (ORDER BY id) - 1 AS row_idx FROM v2 WHERE agency IN ('FDA', 'EMA')) r
  JOIN (VALUES {', '.join(f'({p}, {"NULL" if v is None else v})' for p, v in _SELECTION)}) s(pick, value) ON r.row_idx = s.value"""))
def selected_export(spark, sf_dir):
    """K6: rows picked by position in the filtered, id-ordered listing; bad picks drop out."""
    listing = OP.facet_filter(catalog_after_v2(spark, sf_dir), {"agency": ["FDA", "EMA"]})
    indexed = EX.with_row_index(listing, "id")
    sel = spark.createDataFrame(_SELECTION, "pick int, value long")
    return EX.selected_rows(indexed, sel)


@register("csv_roundtrip", lambda: with_legacy(
    "SELECT " + ", ".join(f'{f} AS "{h}"' for f, h in LEGACY_RECORD_FIELDS) + " FROM legacy"))
def csv_roundtrip(spark, sf_dir):
    """K2 -> S10 -> U4: two CSV exports written, read back (one path missing) and unioned by name."""
    rec = legacy_records(spark, sf_dir)
    base = scratch_path(spark, f"csv-roundtrip-{uuid.uuid4().hex}")
    EX.write_csv(EX.legacy_csv_rows(rec.filter(F.col("ord") % 2 == 0)), f"{base}/fda_even.csv")
    EX.write_csv(EX.legacy_csv_rows(rec.filter(F.col("ord") % 2 == 1)), f"{base}/fda_odd.csv")
    df, missing = EX.read_csv_exports(spark, [f"{base}/fda_even.csv", f"{base}/missing.csv", f"{base}/fda_odd.csv"])
    assert missing == [f"{base}/missing.csv"]
    return df


@register("csv_split_scan", lambda: with_legacy(
    "SELECT " + ", ".join(f'{f} AS "{h}"' for f, h in LEGACY_RECORD_FIELDS) + " FROM legacy"))
def csv_split_scan(spark, sf_dir):
    """K2 -> S10: one CSV export written, then read by the split scan that files of any size take."""
    base = scratch_path(spark, f"csv-split-{uuid.uuid4().hex}")
    EX.write_csv(EX.legacy_csv_rows(legacy_records(spark, sf_dir)), f"{base}/fda.csv")
    return EX.read_csv_exports(spark, [f"{base}/fda.csv"], split_bytes=0)[0]
