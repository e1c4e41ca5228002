"""DuckDB SQL fragments that mirror the Spark column library, for the oracle.

Built from the same fixed rule tables; used only to write ``oracle_sql()``
strings, never to run the engine.
"""

from __future__ import annotations

from doccat.functions.rules import (
    AGENCIES,
    CHANGE_FIELDS,
    DATE_FORMATS,
    JURISDICTION,
    NOT_AVAILABLE,
    PMDA_EARLY_CONSIDERATION,
    PMDA_EARLY_CONSIDERATION_SUB_STATUS,
    STATUS_DEFAULT,
    STATUS_RULES,
    TOPIC_DEFAULT,
    TOPIC_RULES,
    TWO_DIGIT_YEAR_PIVOT,
)
from doccat.sources.adapter import AS_OF_DATE, PHRASES, RAW_STATUSES

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def lst(values: list) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '{WS}+', ' ', 'g'))"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def unescape_common(x: str) -> str:
    out = x
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, {q(entity)}, {q(char)})"
    return out


def normalize_ws(x: str) -> str:
    return clean(unescape_common(f"coalesce(CAST({x} AS VARCHAR), '')"))


def any_contains(text: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(k.lower())})" for k in keywords) + ")"


def status_index(title: str, raw: str, agency: str, end: str, as_of: str = AS_OF_DATE) -> str:
    text = f"lower(coalesce({title}, '') || ' ' || coalesce({raw}, ''))"
    ag = f"upper(coalesce({agency}, ''))"
    parts = []
    for i, (rule_agency, kws, extra, _s, _sub) in enumerate(STATUS_RULES, start=1):
        cond = any_contains(text, kws)
        if rule_agency:
            cond = f"({ag} = {q(rule_agency)} AND {cond})"
        if extra == "end_on_or_after_as_of":
            cond = f"({cond} AND {end} IS NOT NULL AND {end} >= DATE {q(as_of)})"
        elif extra == "end_missing_or_on_or_after_as_of":
            cond = f"({cond} AND ({end} IS NULL OR {end} >= DATE {q(as_of)}))"
        parts.append(f"WHEN {cond} THEN {i}")
    return "(CASE " + " ".join(parts) + " ELSE 0 END)"


def status_of(idx: str) -> str:
    return f"{lst([STATUS_DEFAULT] + [r[3] for r in STATUS_RULES])}[{idx} + 1]"


def sub_status_of(idx: str) -> str:
    return f"{lst([None] + [r[4] for r in STATUS_RULES])}[{idx} + 1]"


def pmda_status(status: str, agency: str) -> str:
    return f"(CASE WHEN upper({agency}) = 'PMDA' AND {status} = {q(STATUS_DEFAULT)} THEN 'final' ELSE {status} END)"


def pmda_sub(sub: str, title: str, agency: str) -> str:
    return (f"(CASE WHEN upper({agency}) = 'PMDA' AND contains(lower({title}), {q(PMDA_EARLY_CONSIDERATION)}) "
            f"THEN {q(PMDA_EARLY_CONSIDERATION_SUB_STATUS)} ELSE {sub} END)")


def topic(title: str, topic_raw: str, summary: str) -> str:
    text = f"lower(concat_ws(' ', coalesce({title}, ''), coalesce({topic_raw}, ''), coalesce({summary}, '')))"
    parts = [f"WHEN {any_contains(text, kws)} THEN {q(t)}" for t, kws in TOPIC_RULES]
    return "(CASE " + " ".join(parts) + f" ELSE {q(TOPIC_DEFAULT)} END)"


def stable_id(agency: str, title: str, src: str, doc: str) -> str:
    loc = f"coalesce(nullif({src}, ''), nullif({doc}, ''), '')"
    return f"substr(sha256(concat_ws('|', {agency}, lower({strip_ws(title)}), lower({strip_ws(loc)}))), 1, 24)"


def content_hash(prefix: str = "") -> str:
    parts = [f"coalesce(CAST({prefix}{f} AS VARCHAR), '')" for f in CHANGE_FIELDS]
    return f"sha256(concat_ws('|', {', '.join(parts)}))"


URL_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def url_path(u: str) -> str:
    return f"regexp_extract(coalesce({u}, ''), '{URL_PATH}', 1)"


def document_format(u: str) -> str:
    low = f"lower(trim(coalesce({u}, '')))"
    return (f"(CASE WHEN ends_with({low}, '.pdf') THEN 'PDF' "
            f"WHEN ends_with({low}, '.doc') OR ends_with({low}, '.docx') THEN 'DOCX' END)")


def reference_number(u: str) -> str:
    last = f"string_split({url_path(u)}, '/')[-1]"
    return f"regexp_replace({last}, '\\.[^.]*$', '')"


def jurisdiction(agency: str) -> str:
    return "(CASE " + " ".join(f"WHEN {agency} = {q(a)} THEN {q(j)}" for a, j in JURISDICTION.items()) + " END)"


_FMT = {name: (shape, short) for name, _p, shape, short in DATE_FORMATS}
_STRPTIME = {
    "iso": "%Y-%m-%d", "compact": "%Y%m%d", "us_long": "%m/%d/%Y", "us_short": "%m/%d/%y",
    "eu_long": "%d/%m/%Y", "eu_short": "%d/%m/%y", "month_day_year": "%B %d, %Y",
    "mon_day_year": "%b %d, %Y", "day_month_year": "%d %B %Y", "day_mon_year": "%d %b %Y",
}


def date_chain(x: str, chain: list[str]) -> str:
    """Shape-guarded strptime chain (DuckDB's %y already pivots at 69)."""
    parts = []
    for name in chain:
        shape, _short = _FMT[name]
        flags = ""
        if shape.startswith("(?i)"):
            shape, flags = shape[4:], ", 'i'"
        parts.append(f"CASE WHEN regexp_matches({x}, {q(shape)}{flags}) "
                     f"THEN CAST(try_strptime({x}, {q(_STRPTIME[name])}) AS DATE) END")
    return "coalesce(" + ", ".join(parts) + ")"


def catalog_cte(as_of: str = AS_OF_DATE, source: str = "documents") -> str:
    """``catalog`` CTE body equal to ``catalog_from_documents``."""
    d = "doc_id"
    base = f"""SELECT {d} AS ord, {d},
  {lst(AGENCIES)}[{d} % 5 + 1] AS agency,
  {clean(f"{lst(PHRASES)}[{d} % 23 + 1] || ' ' || coalesce(text, '')")} AS title,
  {lst(RAW_STATUSES)}[{d} % 17 + 1] AS status_raw,
  source AS topic_raw,
  upper(lang) AS language,
  CASE WHEN {d} % 13 <> 0 THEN DATE '2020-01-01' + CAST({d} % 2400 AS INTEGER) END AS published_date,
  CASE WHEN {d} % 3 = 0 THEN DATE '2024-01-01' + CAST({d} % 400 AS INTEGER) END AS comment_end_date,
  'https://example.org/' || coalesce(source, '') || '/' || CAST({d} % 700 AS VARCHAR) AS source_page_url,
  CASE WHEN {d} % 4 = 1 THEN 'https://example.org/files/' || CAST({d} AS VARCHAR) || '.pdf'
       WHEN {d} % 4 = 2 THEN 'https://example.org/files/' || CAST({d} AS VARCHAR) || '.docx'
       WHEN {d} % 4 = 3 THEN 'https://example.org/media/' || CAST({d} AS VARCHAR) || '/download' END AS document_url,
  coalesce(nullif({clean("text")}, ''), {q(NOT_AVAILABLE)}) AS summary
FROM {source}"""
    idx = status_index("title", "status_raw", "agency", "comment_end_date", as_of)
    mid = f"""SELECT *, {idx} AS _sidx FROM ({base}) b"""
    st = pmda_status(status_of("_sidx"), "agency")
    sub = pmda_sub(sub_status_of("_sidx"), "title", "agency")
    return f"""SELECT ord, doc_id, title, agency, {jurisdiction('agency')} AS jurisdiction,
  source_page_url, document_url, {document_format('document_url')} AS document_format,
  published_date, CAST(NULL AS DATE) AS updated_date, CAST(NULL AS DATE) AS comment_start_date,
  comment_end_date, status_raw, {st} AS status_normalized, {sub} AS sub_status, topic_raw,
  {topic('title', 'topic_raw', 'summary')} AS topic_normalized, CAST(NULL AS VARCHAR) AS product_area,
  summary, language,
  CASE WHEN document_url IS NOT NULL THEN {reference_number('document_url')} END AS reference_number,
  (agency = 'PMDA' AND published_date IS NULL) AS needs_manual_review
FROM ({mid}) m"""


def with_catalog(select_sql: str, as_of: str = AS_OF_DATE) -> str:
    return f"WITH catalog AS ({catalog_cte(as_of)})\n{select_sql}"


def raw_date_text(key: str, ts: str) -> str:
    from doccat.functions.rules import MONTH_NAMES
    y = f"CAST(year({ts}) AS VARCHAR)"
    ms = f"CAST(month({ts}) AS VARCHAR)"
    ds = f"CAST(day({ts}) AS VARCHAR)"
    name = f"{lst(MONTH_NAMES)}[month({ts})]"
    yy = f"lpad(CAST(year({ts}) % 100 AS VARCHAR), 2, '0')"
    return f"""(CASE ({key}) % 12
      WHEN 0 THEN {y} || '-' || lpad({ms}, 2, '0') || '-' || lpad({ds}, 2, '0')
      WHEN 1 THEN {y} || lpad({ms}, 2, '0') || lpad({ds}, 2, '0')
      WHEN 2 THEN {ms} || '/' || {ds} || '/' || {y}
      WHEN 3 THEN {ms} || '/' || {ds} || '/' || {yy}
      WHEN 4 THEN {ds} || '/' || {ms} || '/' || {y}
      WHEN 5 THEN {name} || ' ' || {ds} || ', ' || {y}
      WHEN 6 THEN substr({name}, 1, 3) || ' ' || {ds} || ', ' || {y}
      WHEN 7 THEN {ds} || ' ' || {name} || ' ' || {y}
      WHEN 8 THEN {ds} || ' ' || substr({name}, 1, 3) || ' ' || {y}
      WHEN 9 THEN 'n/a'
      WHEN 10 THEN ''
      ELSE '  ' || {y} || '-' || {ms} || '-' || {ds} || ' ' END)"""


def legacy_iso(x: str, day_first: bool = False) -> str:
    from doccat.functions.rules import LEGACY_DAY_FIRST_CHAIN, LEGACY_MONTH_FIRST_CHAIN
    n = normalize_ws(x)
    chain = LEGACY_DAY_FIRST_CHAIN if day_first else LEGACY_MONTH_FIRST_CHAIN
    return f"coalesce(strftime({date_chain(n, chain)}, '%Y-%m-%d'), {n})"


def yes_no(x: str) -> str:
    from doccat.functions.rules import NO_VALUES, YES_VALUES
    n = normalize_ws(x)
    return (f"(CASE WHEN lower({n}) IN ({', '.join(q(v) for v in YES_VALUES)}) THEN 'Yes' "
            f"WHEN lower({n}) IN ({', '.join(q(v) for v in NO_VALUES)}) THEN 'No' ELSE {n} END)")


def legacy_cte() -> str:
    from doccat.sources.legacy import ANSWERS, ORGS
    closing = (f"CASE WHEN o_orderstatus = 'O' THEN {raw_date_text('o_orderkey + 5', 'CAST(o_orderdate AS DATE) + 60')} "
               f"ELSE '' END")
    return f"""SELECT o_orderkey AS ord, 'FDA' AS health_authority,
  {lst(PHRASES)}[o_custkey % 23 + 1] || ' guidance ' || CAST(o_orderkey AS VARCHAR) AS guidance_name,
  {lst(PHRASES)}[o_custkey % 23 + 1] || ' guidance ' || CAST(o_orderkey AS VARCHAR) AS summary,
  {legacy_iso(raw_date_text('o_orderkey', 'o_orderdate'))} AS issue_date,
  {lst(ORGS)}[o_custkey % 4 + 1] AS fda_organization,
  coalesce(o_orderpriority, '') AS topic,
  CASE WHEN o_orderstatus = 'F' THEN 'Final' WHEN o_orderstatus = 'O' THEN 'Draft' ELSE '' END AS guidance_status,
  {yes_no(f"{lst(ANSWERS)}[o_orderkey % 5 + 1]")} AS open_for_comment,
  {legacy_iso(closing)} AS comment_closing_date_on_draft,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'https://www.fda.gov/media/' || CAST(o_orderkey AS VARCHAR) || '/download' ELSE '' END AS guidance_pdf_link,
  'https://www.fda.gov/regulatory-information/guidance/' || CAST(o_orderkey AS VARCHAR) AS guidance_page_link,
  'FDA-' || CAST(year(o_orderdate) AS VARCHAR) || '-D-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS docket_number
FROM orders"""
CATALOG_CHAIN = [f[0] for f in DATE_FORMATS]
DAY_FIRST = ["eu_long", "eu_short"] + CATALOG_CHAIN
