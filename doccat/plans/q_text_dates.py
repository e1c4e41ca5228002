"""M2: text, date, key and URL functions run as table jobs over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccat.functions import dates as D
from doccat.functions.classify import open_for_comment_flag, split_title_status
from doccat.functions.labels import humanize_label, yes_no
from doccat.functions.rules import LABEL_ACRONYMS, LABEL_SMALL_WORDS, MONTH_NAMES, NOT_AVAILABLE, NO_VALUES, YES_VALUES
from doccat.functions.text import clean_text, clean_title, normalize_whitespace
from doccat.functions.urls import absolute_url_col, document_format, link_label, path_format, reference_number
from doccat.plans import sql as S
from doccat.plans.registry import register
from doccat.plans.q_catalog import catalog
from doccat.sources.adapter import pick
from doccat.sources.tables import table

# ---------------------------------------------------------------- raw date texts from orders


def _orders_raw_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    y = F.year("o_orderdate").cast("string")
    m = F.month("o_orderdate")
    d = F.dayofmonth("o_orderdate")
    ms, ds = m.cast("string"), d.cast("string")
    mm, dd = F.lpad(ms, 2, "0"), F.lpad(ds, 2, "0")
    name = pick(MONTH_NAMES, m - 1)
    abbr = F.substring(name, 1, 3)
    yy = F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0")
    k = F.col("o_orderkey") % 12
    raw = (F.when(k == 0, F.concat(y, F.lit("-"), mm, F.lit("-"), dd))
           .when(k == 1, F.concat(y, mm, dd))
           .when(k == 2, F.concat(ms, F.lit("/"), ds, F.lit("/"), y))
           .when(k == 3, F.concat(ms, F.lit("/"), ds, F.lit("/"), yy))
           .when(k == 4, F.concat(ds, F.lit("/"), ms, F.lit("/"), y))
           .when(k == 5, F.concat(name, F.lit(" "), ds, F.lit(", "), y))
           .when(k == 6, F.concat(abbr, F.lit(" "), ds, F.lit(", "), y))
           .when(k == 7, F.concat(ds, F.lit(" "), name, F.lit(" "), y))
           .when(k == 8, F.concat(ds, F.lit(" "), abbr, F.lit(" "), y))
           .when(k == 9, F.lit("n/a"))
           .when(k == 10, F.lit(""))
           .otherwise(F.concat(F.lit("  "), y, F.lit("-"), ms, F.lit("-"), ds, F.lit(" "))))
    return o.select("o_orderkey", "o_orderdate", raw.alias("raw"))


def _sql_raw_dates() -> str:
    return f"""raw_dates AS (
  SELECT o_orderkey, o_orderdate,
    CASE o_orderkey % 12
      WHEN 0 THEN y || '-' || lpad(ms, 2, '0') || '-' || lpad(ds, 2, '0')
      WHEN 1 THEN y || lpad(ms, 2, '0') || lpad(ds, 2, '0')
      WHEN 2 THEN ms || '/' || ds || '/' || y
      WHEN 3 THEN ms || '/' || ds || '/' || yy
      WHEN 4 THEN ds || '/' || ms || '/' || y
      WHEN 5 THEN mname || ' ' || ds || ', ' || y
      WHEN 6 THEN substr(mname, 1, 3) || ' ' || ds || ', ' || y
      WHEN 7 THEN ds || ' ' || mname || ' ' || y
      WHEN 8 THEN ds || ' ' || substr(mname, 1, 3) || ' ' || y
      WHEN 9 THEN 'n/a'
      WHEN 10 THEN ''
      ELSE '  ' || y || '-' || ms || '-' || ds || ' ' END AS raw
  FROM (SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS VARCHAR) AS y,
          CAST(month(o_orderdate) AS VARCHAR) AS ms, CAST(day(o_orderdate) AS VARCHAR) AS ds,
          lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') AS yy,
          {S.lst(MONTH_NAMES)}[month(o_orderdate)] AS mname FROM orders) x)"""


@register("parse_dates_month_first", lambda: f"""WITH {_sql_raw_dates()}
SELECT o_orderkey, raw, {S.date_chain(S.clean('raw'), D.CATALOG_DATE_CHAIN)} AS parsed_date FROM raw_dates""")
def parse_dates_month_first(spark, sf_dir):
    """ten formats in order, ambiguous d/m read month first, 69 pivot, junk -> null."""
    r = _orders_raw_dates(spark, sf_dir)
    return r.select("o_orderkey", "raw", D.parse_date(F.col("raw")).alias("parsed_date"))


@register("parse_dates_day_first", lambda: f"""WITH {_sql_raw_dates()}
SELECT o_orderkey, raw, {S.date_chain(S.clean('raw'), D.DAY_FIRST_CHAIN)} AS parsed_date FROM raw_dates""")
def parse_dates_day_first(spark, sf_dir):
    """day-first feed dates, then the catalog chain."""
    r = _orders_raw_dates(spark, sf_dir)
    return r.select("o_orderkey", "raw", D.parse_date_day_first(F.col("raw")).alias("parsed_date"))


def _sql_legacy(x: str, chain: list[str]) -> str:
    n = S.normalize_ws(x)
    return f"coalesce(strftime({S.date_chain(n, chain)}, '%Y-%m-%d'), {n})"


@register("legacy_iso_dates", lambda: f"""WITH {_sql_raw_dates()}
SELECT o_orderkey, raw, {_sql_legacy('raw', D.LEGACY_MONTH_FIRST_CHAIN)} AS iso_month_first,
  {_sql_legacy('raw', D.LEGACY_DAY_FIRST_CHAIN)} AS iso_day_first FROM raw_dates""")
def legacy_iso_dates(spark, sf_dir):
    """legacy ISO text; unparseable text is kept as is."""
    r = _orders_raw_dates(spark, sf_dir)
    return r.select("o_orderkey", "raw",
                    D.legacy_iso_date(F.col("raw")).alias("iso_month_first"),
                    D.legacy_iso_date(F.col("raw"), day_first=True).alias("iso_day_first"))


def _dmy(c):
    return F.concat(F.dayofmonth(c).cast("string"), F.lit("/"), F.month(c).cast("string"), F.lit("/"),
                    F.year(c).cast("string"))


def _sql_dmy(c: str) -> str:
    return f"CAST(day({c}) AS VARCHAR) || '/' || CAST(month({c}) AS VARCHAR) || '/' || CAST(year({c}) AS VARCHAR)"


@register("range_end_dates", lambda: f"""WITH r AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN {_sql_dmy('o_orderdate')}
    ELSE {_sql_dmy('o_orderdate')} || ' to ' || {_sql_dmy("(o_orderdate + INTERVAL 30 DAY)")} END AS period FROM orders)
SELECT o_orderkey, period, string_split({S.clean('period')}, ' to ')[-1] AS closing_text,
  {S.date_chain(S.clean("string_split(" + S.clean('period') + ", ' to ')[-1]"), D.DAY_FIRST_CHAIN)} AS closing_date FROM r""")
def range_end_dates(spark, sf_dir):
    """F7 + F4: consultation 'a to b' -> closing text b -> day-first date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    period = F.when(F.col("o_orderkey") % 5 == 0, _dmy(F.col("o_orderdate"))).otherwise(
        F.concat(_dmy(F.col("o_orderdate")), F.lit(" to "), _dmy(F.date_add(F.col("o_orderdate"), 30))))
    r = o.select("o_orderkey", period.alias("period"))
    closing = D.range_end(F.col("period"))
    return r.select("o_orderkey", "period", closing.alias("closing_text"),
                    D.parse_date_day_first(closing).alias("closing_date"))


# ---------------------------------------------------------------- yes / no, labels, titles

_YN_RAW = ["yes", "Y", "TRUE", "1", "no", "N", "false", "0", "maybe", "  Yes  ", ""]


@register("yes_no", lambda: f"""SELECT doc_id, raw,
  CASE WHEN lower(n) IN ({', '.join(S.q(v) for v in YES_VALUES)}) THEN 'Yes'
       WHEN lower(n) IN ({', '.join(S.q(v) for v in NO_VALUES)}) THEN 'No' ELSE n END AS canonical
FROM (SELECT doc_id, raw, {S.normalize_ws('raw')} AS n FROM
  (SELECT doc_id, {S.lst(_YN_RAW)}[(doc_id * 7 + quality * 3 + toxic) % 11 + 1] AS raw FROM labels) a) b""")
def yes_no_query(spark, sf_dir):
    """F8 over the labels table (raw answer derived from the flags)."""
    lab = table(spark, sf_dir, "labels")
    raw = pick(_YN_RAW, (F.col("doc_id") * 7 + F.col("quality") * 3 + F.col("toxic")) % 11)
    return lab.select("doc_id", raw.alias("raw")).select("doc_id", "raw", yes_no(F.col("raw")).alias("canonical"))


def _sql_humanize(x: str) -> str:
    disp = f"(CASE WHEN {x} IS NULL OR {S.clean(x)} = '' THEN {S.q(NOT_AVAILABLE)} ELSE CAST({x} AS VARCHAR) END)"
    words = f"string_split({S.clean(f'replace({disp}, {S.q(chr(95))}, {S.q(chr(32))})')}, ' ')"
    acr = S.lst(LABEL_ACRONYMS)
    small = S.lst(LABEL_SMALL_WORDS)
    fmt = (f"list_transform({words}, lambda w, i: CASE WHEN list_contains({acr}, upper(w)) THEN upper(w) "
           f"WHEN i > 1 AND list_contains({small}, lower(w)) THEN lower(w) "
           f"ELSE upper(substr(lower(w), 1, 1)) || substr(lower(w), 2) END)")
    return (f"(CASE WHEN {disp} = {S.q(NOT_AVAILABLE)} THEN {disp} WHEN {disp} = 'open_for_comment' "
            f"THEN 'Open for comment' ELSE array_to_string({fmt}, ' ') END)")


@register("humanize_labels", lambda: S.with_catalog(f"""SELECT doc_id,
  {_sql_humanize('topic_normalized')} AS topic_label, {_sql_humanize('status_normalized')} AS status_label,
  {_sql_humanize('sub_status')} AS sub_status_label, {_sql_humanize('agency')} AS agency_label FROM catalog"""))
def humanize_labels(spark, sf_dir):
    """F27 over every catalog row (topic, status, sub status, agency)."""
    c = catalog(spark, sf_dir)
    return c.select("doc_id",
                    humanize_label(F.col("topic_normalized")).alias("topic_label"),
                    humanize_label(F.col("status_normalized")).alias("status_label"),
                    humanize_label(F.col("sub_status")).alias("sub_status_label"),
                    humanize_label(F.col("agency")).alias("agency_label"))


_SUFFIXES = [" - Scientific guideline", " - Regulatory and procedural guideline", ""]


@register("title_suffix_split", lambda: S.with_catalog(f"""SELECT doc_id, t,
  CASE WHEN ends_with(t, ' - Scientific guideline') THEN {S.strip_ws("left(t, length(t) - 23)")}
       WHEN ends_with(t, ' - Regulatory and procedural guideline') THEN {S.strip_ws("left(t, length(t) - 38)")}
       ELSE t END AS name,
  CASE WHEN ends_with(t, ' - Scientific guideline') THEN 'Scientific guideline'
       WHEN ends_with(t, ' - Regulatory and procedural guideline') THEN 'Regulatory and procedural guideline'
       ELSE 'Guidance' END AS status_text,
  CASE WHEN ends_with(t, ' - Scientific guideline') THEN {S.strip_ws("left(t, length(t) - 23)")} ELSE t END AS legacy_name,
  CASE WHEN ends_with(t, ' - Scientific guideline') THEN 'Scientific guideline' ELSE 'Guidance' END AS legacy_status,
  CASE WHEN contains(lower(coalesce(status_raw, '')), 'draft') OR contains(lower(coalesce(status_raw, '')), 'consultation')
       THEN 'Yes' ELSE '' END AS open_for_comment
FROM (SELECT doc_id, status_raw, title || {S.lst(_SUFFIXES)}[doc_id % 3 + 1] AS t FROM catalog) x"""))
def title_suffix_split(spark, sf_dir):
    """F11 (app: two suffixes; legacy: one) and F14 over catalog titles."""
    c = catalog(spark, sf_dir)
    t = F.concat(F.col("title"), pick(_SUFFIXES, F.col("doc_id") % 3))
    x = c.select("doc_id", "status_raw", t.alias("t"))
    name, status = split_title_status(F.col("t"))
    lname, lstatus = split_title_status(F.col("t"), legacy=True)
    return x.select("doc_id", "t", name.alias("name"), status.alias("status_text"),
                    lname.alias("legacy_name"), lstatus.alias("legacy_status"),
                    open_for_comment_flag(F.col("status_raw")).alias("open_for_comment"))


_TITLE_PREFIX = ["", "(Attachment) ", "(attachment)"]
_TITLE_SUFFIX = [" [123KB]", " ［1.5 MB］", " - ", "", " [12kb]"]


@register("clean_titles", lambda: S.with_catalog(f"""SELECT doc_id, decorated,
  CASE WHEN starts_with(lower(t1), '(attachment)') THEN {S.strip_ws('substr(t1, 13)')} ELSE t1 END AS cleaned
FROM (SELECT doc_id, decorated, regexp_replace(regexp_replace({S.clean('decorated')}, {S.q(_file_size_sql())}, '', 'g'),
        '^[ \\-–—]+|[ \\-–—]+$', '', 'g') AS t1
      FROM (SELECT doc_id, {S.lst(_TITLE_PREFIX)}[doc_id % 3 + 1] || title || {S.lst(_TITLE_SUFFIX)}[doc_id % 5 + 1] AS decorated
            FROM catalog) a) b"""))
def clean_titles(spark, sf_dir):
    """file-size tags, dashes and '(Attachment)' removed from link titles."""
    c = catalog(spark, sf_dir)
    dec = F.concat(pick(_TITLE_PREFIX, F.col("doc_id") % 3), F.col("title"), pick(_TITLE_SUFFIX, F.col("doc_id") % 5))
    x = c.select("doc_id", dec.alias("decorated"))
    return x.select("doc_id", "decorated", clean_title(F.col("decorated")).alias("cleaned"))


def _file_size_sql() -> str:
    from doccat.functions.text import FILE_SIZE_SUFFIX
    return FILE_SIZE_SUFFIX


@register("text_cleanup", lambda: f"""SELECT doc_id, length({S.clean('text')}) AS n_clean_chars,
  sha256({S.clean('text')}) AS clean_sha, length({S.normalize_ws('text')}) AS n_unescaped_chars FROM documents""")
def text_cleanup(spark, sf_dir):
    """F1 / F2 over whole document texts (length and digest of the cleaned text)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    ct = clean_text(F.col("text"))
    return d.select("doc_id", F.length(ct).cast("bigint").alias("n_clean_chars"), F.sha2(ct, 256).alias("clean_sha"),
                    F.length(normalize_whitespace(F.col("text"))).cast("bigint").alias("n_unescaped_chars"))


# ---------------------------------------------------------------- URLs

_URL_SUFFIX = ["", ".pdf", "/file.docx", "/media/12", "/documents/x.PDF", ".doc"]


def _sql_url_path(u):
    return S.url_path(u)


@register("url_format", lambda: f"""SELECT page_id, u,
  {S.document_format('u')} AS document_format,
  CASE WHEN ends_with(lower({S.url_path('u')}), '.pdf') THEN 'PDF' END AS path_format,
  CASE WHEN coalesce(u, '') = '' THEN '' WHEN regexp_matches(coalesce(u, ''), '\\.pdf$|/media/|/documents/', 'i') THEN 'PDF' ELSE 'Page' END AS link_label,
  {S.reference_number('u')} AS reference_number
FROM (SELECT page_id, url || {S.lst(_URL_SUFFIX)}[page_id % 6 + 1] AS u FROM pages) x""")
def url_format(spark, sf_dir):
    """F17, F29, F20 over page URLs (with document-like suffixes mixed in)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    x = p.select("page_id", F.concat(F.col("url"), pick(_URL_SUFFIX, F.col("page_id") % 6)).alias("u"))
    u = F.col("u")
    return x.select("page_id", "u", document_format(u).alias("document_format"), path_format(u).alias("path_format"),
                    link_label(u).alias("link_label"), reference_number(u).alias("reference_number"))


def _href_variant(h, k):
    rest = F.substring(h, 2, 1 << 30)
    return (F.when(k == 0, h).when(k == 1, rest).when(k == 2, F.concat(F.lit("?"), rest))
            .when(k == 3, F.concat(F.lit("#"), rest)).when(k == 4, F.concat(F.lit("//cdn.example.org"), h))
            .when(k == 5, F.concat(F.lit("https://other.example.com"), h)).otherwise(F.lit("")))


def _sql_absolute(h: str, base: str) -> str:
    scheme = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)"
    origin = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
    no_frag = f"regexp_replace({base}, '#.*$', '')"
    no_query = f"regexp_replace({no_frag}, '\\?.*$', '')"
    bdir = f"(CASE WHEN {S.url_path(base)} = '' THEN {origin} || '/' ELSE regexp_replace({no_query}, '[^/]*$', '') END)"
    hh = f"trim(coalesce({h}, ''))"
    return (f"(CASE WHEN {hh} = '' THEN {base} WHEN regexp_matches({hh}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {hh} "
            f"WHEN starts_with({hh}, '//') THEN {scheme} || ':' || {hh} "
            f"WHEN starts_with({hh}, '/') THEN {origin} || {hh} "
            f"WHEN starts_with({hh}, '?') THEN {no_query} || {hh} "
            f"WHEN starts_with({hh}, '#') THEN {no_frag} || {hh} ELSE {bdir} || {hh} END)")


@register("absolute_urls", lambda: f"""SELECT page_id, pos, href, {_sql_absolute('href', 'url')} AS absolute_url FROM (
  SELECT page_id, url, pos - 1 AS pos,
    CASE (page_id + pos - 1) % 7 WHEN 0 THEN h WHEN 1 THEN substr(h, 2) WHEN 2 THEN '?' || substr(h, 2)
      WHEN 3 THEN '#' || substr(h, 2) WHEN 4 THEN '//cdn.example.org' || h
      WHEN 5 THEN 'https://other.example.com' || h ELSE '' END AS href
  FROM pages, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) WITH ORDINALITY AS u(h, pos)) x""")
def absolute_urls(spark, sf_dir):
    """every link of every page resolved against the page URL (several href shapes)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    links = p.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("pos", "h"))
    links = links.withColumn("pos", F.col("pos").cast("bigint"))
    k = (F.col("page_id") + F.col("pos")) % 7
    x = links.select("page_id", "url", "pos", _href_variant(F.col("h"), k).alias("href"))
    return x.select("page_id", "pos", "href", absolute_url_col(F.col("href"), F.col("url")).alias("absolute_url"))


# ---------------------------------------------------------------- nested fields, API datetimes

_OFFSETS = ["+09:00", "-05:00", "Z", "+0530", ""]


@register("json_field_access", lambda: f"""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  json_extract_string(props, '$.a.b') AS missing_path, raw_ts,
  coalesce(CASE WHEN regexp_matches({S.clean('raw_ts')}, {S.q(D.ISO_DATETIME_OFFSET)})
                THEN CAST(try_strptime(substr({S.clean('raw_ts')}, 1, 10), '%Y-%m-%d') AS DATE) END,
           {S.date_chain(S.clean('raw_ts'), D.CATALOG_DATE_CHAIN)}) AS api_date
FROM (SELECT event_id, props, strftime(ts, '%Y-%m-%dT%H:%M:%S') || {S.lst(_OFFSETS)}[event_id % 5 + 1] AS raw_ts FROM events) e""")
def json_field_access(spark, sf_dir):
    """F30 (nested access, null on a missing level) and F6 (offset datetime -> own date)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "props")
    raw_ts = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), pick(_OFFSETS, F.col("event_id") % 5))
    v = F.try_parse_json(F.col("props"))
    return e.select(
        "event_id",
        F.try_variant_get(v, "$.k", "bigint").alias("k"),
        F.try_variant_get(v, "$.a.b", "string").alias("missing_path"),
        raw_ts.alias("raw_ts"),
    ).select("event_id", "k", "missing_path", "raw_ts", D.parse_api_datetime(F.col("raw_ts")).alias("api_date"))


# ---------------------------------------------------------------- dates inside free text


def _info_text(k, name, d, y):
    md = F.concat(name, F.lit(" "), d, F.lit(", "), y)
    return (F.when(k == 0, F.concat(F.lit("Notice "), md, F.lit(" - Revised")))
            .when(k == 1, F.concat(F.lit("Deadline for comments by "), md, F.lit("; extended")))
            .when(k == 2, F.lit("no date here"))
            .otherwise(md))


@register("text_dates", lambda: f"""WITH x AS (
  SELECT o_orderkey, CASE o_orderkey % 4
      WHEN 0 THEN 'Notice ' || md || ' - Revised' WHEN 1 THEN 'Deadline for comments by ' || md || '; extended'
      WHEN 2 THEN 'no date here' ELSE md END AS info
  FROM (SELECT o_orderkey, {S.lst(MONTH_NAMES)}[month(o_orderdate)] || ' ' || CAST(day(o_orderdate) AS VARCHAR) || ', '
          || CAST(year(o_orderdate) AS VARCHAR) AS md FROM orders) a),
y AS (SELECT o_orderkey, info, regexp_extract(info, {S.q(D.MONTH_DAY_YEAR_IN_TEXT)}, 1) AS date_text FROM x)
SELECT o_orderkey, info, date_text, {S.date_chain(S.clean('date_text'), D.CATALOG_DATE_CHAIN)} AS published_date,
  CASE WHEN date_text <> '' THEN regexp_replace(substr(info, strpos(info, date_text) + length(date_text)), '^[ -]+|[ -]+$', '', 'g')
       ELSE nullif(info, '') END AS status_raw,
  {S.date_chain(S.clean(f"regexp_extract(info, {S.q(D.DEADLINE)}, 1)"), D.CATALOG_DATE_CHAIN)} AS deadline
FROM y""")
def text_dates(spark, sf_dir):
    """F22 (date + remainder as status text) and F23 (comment deadline)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    name = pick(MONTH_NAMES, F.month("o_orderdate") - 1)
    info = _info_text(F.col("o_orderkey") % 4, name, F.dayofmonth("o_orderdate").cast("string"),
                      F.year("o_orderdate").cast("string"))
    x = o.select("o_orderkey", info.alias("info")).withColumn("date_text", D.date_in_text(F.col("info")))
    rest = F.substring(F.col("info"), F.position(F.col("date_text"), F.col("info")) + F.length("date_text"), 1 << 30)
    status_raw = F.when(F.col("date_text") != "", F.regexp_replace(rest, r"^[ -]+|[ -]+$", "")).otherwise(
        F.when(F.col("info") != "", F.col("info")))
    return x.select("o_orderkey", "info", "date_text", D.parse_date(F.col("date_text")).alias("published_date"),
                    status_raw.alias("status_raw"), D.deadline_in_text(F.col("info")).alias("deadline"))
