"""M6: semi-structured ingest.

Each query first lands feed payloads built from a driver table (bounded
chunks: at most 500 rows per page / file, 25 guidelines per tree), then parses
them back with the feed readers.  The oracle computes the expected rows
straight from the source table, so the JSON round trip, the variant handling
and the tree walk are all checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from doccat.functions.rules import MONTH_NAMES
from doccat.functions.text import clean_text
from doccat.operators import dedupe as DD
from doccat.operators.search import newest_first
from doccat.plans import sql as S
from doccat.plans import sql_html as SH
from doccat.plans.registry import register
from doccat.sources import feeds as FD
from doccat.sources.adapter import AS_OF_DATE, PHRASES, pick
from doccat.sources.legacy import ANSWERS, ORGS, raw_date_text
from doccat.sources.tables import table

PAGE_SIZE = 500

# ---------------------------------------------------------------- FDA list rows from orders


def _fda_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    ks = k.cast("string")
    name = F.concat(pick(PHRASES, F.col("o_custkey") % 23), F.lit(" guidance "), ks)
    status = (F.when(F.col("o_orderstatus") == "F", F.lit("Final"))
              .when(F.col("o_orderstatus") == "O", F.lit("Draft")).otherwise(F.lit("")))
    closing = F.when(F.col("o_orderstatus") == "O",
                     raw_date_text(k + 5, F.date_add(F.to_date("o_orderdate"), 60))).otherwise(F.lit(""))
    return o.select(
        k.alias("k"), (k / PAGE_SIZE).cast("long").alias("page"),
        F.concat(F.lit('<a href="/regulatory-information/guidance/'), ks, F.lit('">'), name, F.lit("</a>")).alias("c0"),
        F.when(k % 4 != 0, F.concat(F.lit('<a href="/media/'), ks, F.lit('/download">Download &amp; read</a>')))
        .otherwise(F.lit("Not available")).alias("c1"),
        raw_date_text(k, F.col("o_orderdate")).alias("c2"),
        pick(ORGS, F.col("o_custkey") % 4).alias("c3"),
        F.coalesce(F.col("o_orderpriority"), F.lit("")).alias("c4"),
        status.alias("c5"), pick(ANSWERS, k % 5).alias("c6"), closing.alias("c7"),
        F.concat(F.lit("<span>FDA-"), F.year("o_orderdate").cast("string"), F.lit("-D-"),
                 F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("</span>")).alias("c8"))


_DICT_KEYS = ["field_summary", "field_associated_media_2", "field_issue_datetime", "field_issuing_office_taxonomy",
              "topics-product", "field_final_guidance_1", "open-comment", "field_comment_close_date", "field_docket_number"]
_STATIC_KEYS = ["title"] + _DICT_KEYS[1:]


def _row_json(keys, as_list):
    cells = [F.col(f"c{i}") for i in range(9)]
    short = F.col("k") % 7 == 0
    lst = F.when(short, F.to_json(F.array(*cells[:8]))).otherwise(F.to_json(F.array(*cells)))
    obj_cells = [F.when(~short, c) if i == 7 else c for i, c in enumerate(cells)]
    obj = F.to_json(F.struct(*[c.alias(kname) for c, kname in zip(obj_cells, keys)]))
    return F.when(as_list, lst).otherwise(obj)


def _spread(df):
    """Landed files are read one split per file; spread the generated payloads the same way."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _bounded_pages(rows, payload):
    """Group rows into their page (at most PAGE_SIZE rows each) in key order."""
    g = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("k", "j"))).alias("rows"))
    return g.select("page", payload(F.array_join(F.transform("rows", lambda r: r["j"]), ",")).alias("payload"))


def landed_fda_pages(spark, sf_dir):
    """S2 landing: DataTables pages; even pages carry list rows, odd pages object rows."""
    c = _fda_cells(spark, sf_dir)
    rows = c.select("k", "page", _row_json(_DICT_KEYS, F.col("page") % 2 == 0).alias("j"))
    total = c.agg(F.count(F.lit(1)).alias("total"))
    pages = _bounded_pages(rows, lambda data: data.alias("data")).crossJoin(total)
    payload = F.concat(F.lit('{"draw":'), (F.col("page") + 1).cast("string"), F.lit(',"start":'),
                       (F.col("page") * PAGE_SIZE).cast("string"), F.lit(f',"length":{PAGE_SIZE},"recordsTotal":'),
                       F.col("total").cast("string"), F.lit(',"recordsFiltered":'), F.col("total").cast("string"),
                       F.lit(',"data":['), F.col("payload"), F.lit("]}"))
    return _spread(pages.select("page", payload.alias("payload")))


def _sql_fda_expected(extra_select: str = "", static: bool = False) -> str:
    is_list = "FALSE" if static else f"(o_orderkey // {PAGE_SIZE}) % 2 = 0"
    closing = (f"CASE WHEN o_orderkey % 7 = 0 AND NOT ({is_list}) THEN '' WHEN o_orderstatus = 'O' THEN "
               f"{S.raw_date_text('o_orderkey + 5', 'CAST(o_orderdate AS DATE) + 60')} ELSE '' END")
    name = f"{S.lst(PHRASES)}[o_custkey % 23 + 1] || ' guidance ' || CAST(o_orderkey AS VARCHAR)"
    return f"""SELECT o_orderkey AS k, 'FDA' AS health_authority, {name} AS guidance_name, {name} AS summary,
  {S.legacy_iso(S.raw_date_text('o_orderkey', 'o_orderdate'))} AS issue_date,
  {S.lst(ORGS)}[o_custkey % 4 + 1] AS fda_organization, coalesce(o_orderpriority, '') AS topic,
  CASE WHEN o_orderstatus = 'F' THEN 'Final' WHEN o_orderstatus = 'O' THEN 'Draft' ELSE '' END AS guidance_status,
  {S.yes_no(f"{S.lst(ANSWERS)}[o_orderkey % 5 + 1]")} AS open_for_comment,
  {S.legacy_iso(closing)} AS comment_closing_date_on_draft,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'https://www.fda.gov/media/' || CAST(o_orderkey AS VARCHAR) || '/download' ELSE 'Not available' END AS guidance_pdf_link,
  'https://www.fda.gov/regulatory-information/guidance/' || CAST(o_orderkey AS VARCHAR) AS guidance_page_link,
  CASE WHEN o_orderkey % 7 = 0 AND ({is_list}) THEN '' ELSE
  'FDA-' || CAST(year(o_orderdate) AS VARCHAR) || '-D-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END AS docket_number
  {extra_select} FROM orders"""


_RECORD = ["health_authority", "guidance_name", "summary", "issue_date", "fda_organization", "topic", "guidance_status",
           "open_for_comment", "comment_closing_date_on_draft", "guidance_pdf_link", "guidance_page_link", "docket_number"]


@register("paged_list_merge", lambda: f"SELECT {', '.join(_RECORD)} FROM ({_sql_fda_expected()}) x")
def paged_list_merge(spark, sf_dir):
    """S2 + F10 + H3 + F26: paged list (list and object rows) -> legacy records in feed order."""
    rows = FD.fda_paged_rows(landed_fda_pages(spark, sf_dir))
    return FD.parse_fda_rows(rows, ["start", "pos"]).select(*_RECORD)


def landed_fda_static(spark, sf_dir):
    """S1 landing: JSON-array files of object rows (keys of the static list)."""
    c = _fda_cells(spark, sf_dir)
    rows = c.select("k", "page", _row_json(_STATIC_KEYS, F.lit(False)).alias("j"))
    return _spread(_bounded_pages(rows, lambda data: F.concat(F.lit("["), data, F.lit("]"))).withColumnRenamed("page", "file"))


@register("static_list_newest", lambda: f"""SELECT {', '.join(_RECORD)} FROM ({_sql_fda_expected(static=True)}) x
ORDER BY issue_date DESC, k ASC LIMIT 50""")
def static_list_newest(spark, sf_dir):
    """S1 + L1: static list, newest 50 by the issue-date text (ties in file order)."""
    rows = FD.fda_static_rows(landed_fda_static(spark, sf_dir))
    rec = FD.parse_fda_rows(rows, ["file", "pos"])
    return newest_first(rec.withColumn("ord", F.struct("file", "pos")), 50).select(*_RECORD)


@register("row_dict_or_list", lambda: f"""SELECT k AS ord, CASE WHEN (k // {PAGE_SIZE}) % 2 = 0 THEN 'list' ELSE 'object' END AS shape,
  CASE WHEN o_orderkey % 7 = 0 AND (k // {PAGE_SIZE}) % 2 = 1 THEN '' WHEN o_orderstatus = 'O' THEN {S.raw_date_text('o_orderkey + 5', 'CAST(o_orderdate AS DATE) + 60')} ELSE '' END AS closing_cell,
  {S.raw_date_text('o_orderkey', 'o_orderdate')} AS issue_cell FROM (SELECT *, o_orderkey AS k FROM orders) o""")
def row_dict_or_list(spark, sf_dir):
    """raw cells of list rows (padded) and object rows (first present key) agree."""
    rows = FD.fda_paged_rows(landed_fda_pages(spark, sf_dir))
    shape = F.when(F.try_variant_get("row", "$", "array<variant>").isNotNull(), F.lit("list")).otherwise(F.lit("object"))
    cells = FD.fda_row_cells(F.col("row"))
    return rows.select((F.col("start") + F.col("pos")).alias("ord"), shape.alias("shape"),
                       cells["comment_closing_date"].alias("closing_cell"), cells["issue_date"].alias("issue_cell"))


@register("feed_rejects", lambda: f"""SELECT DISTINCT page AS file, CASE WHEN page % 3 = 1 THEN 'unreadable JSON' ELSE 'no list at $.data' END AS reason
FROM (SELECT o_orderkey // {PAGE_SIZE} AS page FROM orders) o WHERE page % 3 > 0""")
def feed_rejects(spark, sf_dir):
    """Landed pages of which some are cut short and some hold an object in place of their list."""
    page = F.col("page")
    cut = F.substring("payload", 1, F.length("payload") - 2)
    obj = F.concat(F.replace("payload", F.lit('"data":['), F.lit('"data":{"rows":[')), F.lit("}"))
    files = landed_fda_pages(spark, sf_dir).select(page.alias("file"), F.when(page % 3 == 1, cut).when(page % 3 == 2, obj).otherwise(F.col("payload")).alias("payload"))
    return FD.feed_rejects(files, "$.data").select("file", "reason")


# ---------------------------------------------------------------- EMA feed from documents

_EMA_SUFFIX = [" - Scientific guideline", " - Regulatory and procedural guideline", ""]
_EMA_CATS = ["Quality", "Clinical efficacy and safety", "Multidisciplinary"]


def _ema_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    ks = k.cast("string")
    base = F.date_add(F.lit("2020-01-01").cast("date"), (k % 2400).cast("int"))
    dmy = lambda c: F.concat(F.dayofmonth(c).cast("string"), F.lit("/"), F.month(c).cast("string"), F.lit("/"), F.year(c).cast("string"))
    title = F.when(k % 50 == 0, F.lit("  ")).otherwise(
        F.concat(pick(PHRASES, k % 23), F.lit(" "), F.coalesce(F.col("text"), F.lit("")), pick(_EMA_SUFFIX, k % 3)))
    url = F.when(k % 51 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://www.ema.europa.eu/en/doc-"), ks,
                                                               F.when(k % 4 == 0, F.lit("-scientific-guideline")).otherwise(F.lit(""))))
    row = F.struct(
        title.alias("title"),
        F.when(k % 9 == 0, F.lit("")).otherwise(F.col("text")).alias("summary"),
        F.concat(F.lit("Human;"), pick(_EMA_CATS, k % 3)).alias("categories"),
        F.when(k % 13 == 0, F.lit("")).otherwise(dmy(base)).alias("first_published_date"),
        F.when(k % 2 == 0, F.date_format(base, "dd/MM/yy")).otherwise(F.date_format(base, "yyyy-MM-dd")).alias("last_updated_date"),
        url.alias("general_url"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("EMA/"), ks, F.lit("/2024"))).alias("reference_number"),
        F.when(k % 6 == 0, F.concat(dmy(base), F.lit(" to "), dmy(F.date_add(base, 90)))).alias("consultation_date"))
    return d.select(k.alias("k"), (k / PAGE_SIZE).cast("long").alias("page"), F.to_json(row).alias("j"))


def landed_ema_feed(spark, sf_dir):
    """S3 landing: feed pages {meta:{total_records, page}, data:[...]} with one non-object entry each."""
    rows = _ema_rows(spark, sf_dir)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    pages = _bounded_pages(rows, lambda data: data.alias("data")).crossJoin(total)
    payload = F.concat(F.lit('{"meta":{"total_records":"'), F.format_number(F.col("total"), 0), F.lit('","page":'),
                       F.col("page").cast("string"), F.lit('},"data":[42,'), F.col("payload"), F.lit("]}"))
    return _spread(pages.select(payload.alias("payload")))


def _sql_ema_src() -> str:
    dmy = lambda c: f"CAST(day({c}) AS VARCHAR) || '/' || CAST(month({c}) AS VARCHAR) || '/' || CAST(year({c}) AS VARCHAR)"
    b = "(DATE '2020-01-01' + CAST(doc_id % 2400 AS INTEGER))"
    return f"""SELECT doc_id AS k, doc_id // {PAGE_SIZE} AS page, doc_id % {PAGE_SIZE} + 1 AS pos,
  CASE WHEN doc_id % 50 = 0 THEN '  ' ELSE {S.lst(PHRASES)}[doc_id % 23 + 1] || ' ' || coalesce(text, '')
    || {S.lst(_EMA_SUFFIX)}[doc_id % 3 + 1] END AS title,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS summary,
  'Human;' || {S.lst(_EMA_CATS)}[doc_id % 3 + 1] AS categories,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE {dmy(b)} END AS first_published_date,
  CASE WHEN doc_id % 2 = 0 THEN strftime({b}, '%d/%m/%y') ELSE strftime({b}, '%Y-%m-%d') END AS last_updated_date,
  CASE WHEN doc_id % 51 = 0 THEN NULL ELSE 'https://www.ema.europa.eu/en/doc-' || CAST(doc_id AS VARCHAR)
    || CASE WHEN doc_id % 4 = 0 THEN '-scientific-guideline' ELSE '' END END AS general_url,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'EMA/' || CAST(doc_id AS VARCHAR) || '/2024' END AS reference_number,
  CASE WHEN doc_id % 6 = 0 THEN {dmy(b)} || ' to ' || {dmy(b + ' + 90')} END AS consultation_date
FROM documents"""


def _sql_split(t: str, legacy: bool = False) -> tuple[str, str]:
    sci = f"ends_with({t}, ' - Scientific guideline')"
    reg = f"ends_with({t}, ' - Regulatory and procedural guideline')"
    if legacy:
        return (f"CASE WHEN {sci} THEN {S.strip_ws(f'left({t}, length({t}) - 23)')} ELSE {t} END",
                f"CASE WHEN {sci} THEN 'Scientific guideline' ELSE 'Guidance' END")
    return (f"CASE WHEN {sci} THEN {S.strip_ws(f'left({t}, length({t}) - 23)')} WHEN {reg} THEN {S.strip_ws(f'left({t}, length({t}) - 38)')} ELSE {t} END",
            f"CASE WHEN {sci} THEN 'Scientific guideline' WHEN {reg} THEN 'Regulatory and procedural guideline' ELSE 'Guidance' END")


def _sql_ema_documents() -> str:
    name, st = _sql_split("rt")
    return f"""WITH src AS ({_sql_ema_src()}),
a AS (SELECT *, {S.clean('title')} AS rt, {S.clean('general_url')} AS u, {S.clean('summary')} AS sm, {S.clean('categories')} AS tr,
  {S.clean('reference_number')} AS rf FROM src),
b AS (SELECT *, {name} AS nm, {st} AS sr, CASE WHEN sm <> '' THEN sm ELSE 'Not available.' END AS smry FROM a WHERE rt <> '' AND u <> ''),
c AS (SELECT *, {S.status_index('nm', 'sr', "'EMA'", 'NULL')} AS si FROM b)
SELECT page, pos, nm AS title, 'EMA' AS agency, 'EU' AS jurisdiction, u AS source_page_url,
  {S.date_chain(S.clean('first_published_date'), S.DAY_FIRST)} AS published_date,
  {S.date_chain(S.clean('last_updated_date'), S.DAY_FIRST)} AS updated_date,
  {S.date_chain(S.clean(f"string_split({S.clean('consultation_date')}, ' to ')[-1]"), S.DAY_FIRST)} AS comment_end_date,
  sr AS status_raw, {S.status_of('si')} AS status_normalized, {S.sub_status_of('si')} AS sub_status, tr AS topic_raw,
  {S.topic('nm', 'tr', 'smry')} AS topic_normalized, smry AS summary, 'EN' AS language,
  CASE WHEN rf <> '' THEN rf END AS reference_number FROM c"""


@register("ema_feed_rows", _sql_ema_documents)
def ema_feed_rows(spark, sf_dir):
    """S3 + P1 + F11 + F4 + F7: feed pages -> EMA catalog rows (non-objects and rows without title/URL skipped)."""
    rows = FD.ema_feed_rows(landed_ema_feed(spark, sf_dir))
    return FD.ema_documents(rows)


@register("ema_legacy_feed", lambda: f"""WITH src AS ({_sql_ema_src()}),
a AS (SELECT *, {S.normalize_ws('title')} AS rt FROM src
  WHERE contains(lower({S.clean('title')}), 'scientific guideline') OR ends_with(lower({S.clean('general_url')}), '-scientific-guideline'))
SELECT page, pos, 'EMA' AS health_authority, {_sql_split('rt', True)[0]} AS guidance_name, {S.normalize_ws('summary')} AS summary,
  {S.legacy_iso('first_published_date', day_first=True)} AS issue_date, 'European Medicines Agency' AS fda_organization,
  replace({S.normalize_ws('categories')}, ';', '; ') AS topic, {_sql_split('rt', True)[1]} AS guidance_status,
  CASE WHEN contains(lower({_sql_split('rt', True)[1]}), 'draft') OR contains(lower({_sql_split('rt', True)[1]}), 'consultation') THEN 'Yes' ELSE '' END AS open_for_comment,
  {S.legacy_iso(f"string_split({S.clean(S.normalize_ws('consultation_date'))}, ' to ')[-1]", day_first=True)} AS comment_closing_date_on_draft,
  '' AS guidance_pdf_link, {S.normalize_ws('general_url')} AS guidance_page_link, {S.normalize_ws('reference_number')} AS docket_number
FROM a""")
def ema_legacy_feed(spark, sf_dir):
    """S4 + P2 + F5 + F14 + F31: only scientific guidelines, as legacy records."""
    rows = FD.ema_feed_rows(landed_ema_feed(spark, sf_dir))
    return FD.ema_legacy_records(rows)


@register("feed_completeness", lambda: f"""WITH d AS ({_sql_ema_documents()})
SELECT (SELECT count(*) FROM documents) AS declared_total, (SELECT count(*) FROM d) AS parsed,
  (SELECT count(*) FROM documents) + 23 AS external_count, 'mismatch' AS verdict""")
def feed_completeness(spark, sf_dir):
    """A7 on the EMA feed: declared total vs parsed rows vs a search page that lists 23 more."""
    files = landed_ema_feed(spark, sf_dir)
    rows = FD.ema_feed_rows(files)
    docs = FD.ema_documents(rows)
    declared = rows.agg(F.max(F.expr("try_cast(replace(total_records, ',', '') AS BIGINT)")).alias("d"))
    return FD.feed_completeness(rows, docs, None).drop("external_count", "verdict").crossJoin(declared).select(
        "declared_total", "parsed", (F.col("d") + 23).alias("external_count"),
        F.when((F.col("declared_total") != F.col("d") + 23) | (F.col("parsed") != F.col("d") + 23), F.lit("mismatch"))
        .otherwise(F.lit("ok")).alias("verdict"))


# ---------------------------------------------------------------- CDE items

_AREAS = ["化学药", "生物制品", "中药", "化学药品", ""]
_NOWSTATE = ["现行", "试行", ""]


def _cde_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    ks = k.cast("string")
    t = F.when(k % 19 == 0, F.lit("")).otherwise(clean_text("text"))
    area = pick(_AREAS, k % 5)
    code = F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("Z"), (k % 400).cast("string")))
    b = F.date_add(F.lit("2024-01-01").cast("date"), (k % 700).cast("int"))
    name = pick(MONTH_NAMES, F.month(b) - 1)
    v = k % 4
    j0 = F.to_json(F.struct(t.alias("title"), area.alias("drugType"), F.date_format(b, "yyyyMMdd").alias("publishDate"),
                            F.concat(F.lit("/zdyz/detail/"), ks).alias("url"), code.alias("zdyzIdCODE"),
                            pick(_NOWSTATE, k % 3).alias("nowstate")))
    j1 = F.to_json(F.struct(t.alias("TITLE"), area.alias("fclass"), F.date_format(b, "yyyy-MM-dd").alias("issueDate"),
                            F.concat(F.lit("/files/"), ks, F.lit(".pdf")).alias("fileUrl"), code.alias("idCODE")))
    j2 = F.to_json(F.struct(t.alias("name"), area.alias("scope"),
                            F.concat(name, F.lit(" "), F.dayofmonth(b).cast("string"), F.lit(", "), F.year(b).cast("string")).alias("date"),
                            code.alias("id"), F.lit("  ").alias("summary"), F.col("text").alias("description")))
    j3 = F.to_json(F.struct(F.lit("").alias("bt"), t.alias("noticeTitle"),
                            F.concat(F.lit("https://x.example/"), ks, F.lit(".docx")).alias("document_url"),
                            F.lit("").alias("document_format"), F.lit("公开征求意见").alias("status")))
    j = F.when(v == 0, j0).when(v == 1, j1).when(v == 2, j2).otherwise(j3)
    return d.select(k.alias("k"), j.alias("json"))


@register("item_key_aliases", lambda: _sql_cde())
def item_key_aliases(spark, sf_dir):
    """S6 + S7 + W3 + F9 + F19 + P3: two overlapping lists (together every item) concatenated, keep-first by id else title."""
    items = _cde_items(spark, sf_dir)
    a = items.filter(F.col("k") % 3 != 0).withColumn("list", F.lit(1))
    b = items.filter((F.col("k") % 2 == 0) | (F.col("k") % 3 == 0)).withColumn("list", F.lit(2))
    both = a.unionByName(b).select("list", "k", F.from_json("json", "map<string,string>").alias("item"))
    keyed = both.withColumn("_dk", FD.first_value(F.col("item"), FD.CDE_KEYS["code"]))
    keyed = keyed.withColumn("_dk", F.when(F.col("_dk") != "", F.col("_dk")).otherwise(
        FD.first_value(F.col("item"), FD.CDE_KEYS["dedupe_title"])))
    first = DD.keep_first(keyed.withColumn("ord", F.struct("list", "k")), F.col("_dk")).drop("_dk", "ord")
    docs = FD.cde_items(first)
    return docs.select("k", "title", "source_page_url", "document_url", "document_format", "published_date",
                       "status_raw", "status_normalized", "sub_status", "topic_normalized", "product_area", "summary",
                       "reference_number")


def _sql_cde() -> str:
    t = f"CASE WHEN doc_id % 19 = 0 THEN '' ELSE {S.clean('text')} END"
    code = "CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'Z' || CAST(doc_id % 400 AS VARCHAR) END"
    b = "(DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER))"
    base = f"""SELECT doc_id AS k, doc_id % 4 AS v, {t} AS t, {S.lst(_AREAS)}[doc_id % 5 + 1] AS area, {code} AS code, {b} AS b,
  {S.lst(_NOWSTATE)}[doc_id % 3 + 1] AS ns, {S.clean('text')} AS descr FROM documents"""
    lists = "SELECT 1 AS list, * FROM base WHERE k % 3 <> 0 UNION ALL SELECT 2 AS list, * FROM base WHERE k % 2 = 0 OR k % 3 = 0"
    sel = f"""SELECT list, k, t AS title, v, area, code,
  CASE WHEN v = 0 THEN strftime(b, '%Y%m%d') WHEN v = 1 THEN strftime(b, '%Y-%m-%d')
       WHEN v = 2 THEN {S.lst(MONTH_NAMES)}[month(b)] || ' ' || CAST(day(b) AS VARCHAR) || ', ' || CAST(year(b) AS VARCHAR) ELSE '' END AS pub,
  CASE WHEN v = 0 THEN 'https://www.cde.org.cn/zdyz/detail/' || CAST(k AS VARCHAR)
       WHEN v IN (1, 2) AND code <> '' THEN 'https://www.cde.org.cn/zdyz/domesticinfopage?zdyzIdCODE=' || code
       WHEN v = 0 AND code <> '' THEN 'x'
       ELSE '{FD.CDE_LIST_URL}' END AS src,
  CASE WHEN v = 1 THEN 'https://www.cde.org.cn/files/' || CAST(k AS VARCHAR) || '.pdf'
       WHEN v = 3 THEN 'https://x.example/' || CAST(k AS VARCHAR) || '.docx' END AS doc_url,
  CASE WHEN v = 1 THEN 'PDF' WHEN v = 3 THEN 'DOCX' END AS fmt,
  CASE WHEN v = 0 THEN ns WHEN v = 3 THEN '公开征求意见' ELSE '' END AS status_raw,
  CASE WHEN v = 2 AND descr <> '' THEN descr ELSE 'Not available.' END AS summary,
  CASE WHEN code <> '' AND v <> 3 THEN code ELSE CASE WHEN v = 3 THEN '' ELSE t END END AS dk,
  CASE WHEN v <> 3 AND code <> '' THEN code END AS reference_number,
  CASE WHEN v = 3 THEN '' ELSE area END AS parea
FROM lists"""
    return f"""WITH base AS ({base}), lists AS ({lists}), x AS ({sel}),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY list, k) AS rn FROM x) y WHERE rn = 1),
f AS (SELECT *, {S.status_index('title', 'status_raw', "'CDE'", 'NULL')} AS si FROM d
      WHERE title <> '' AND (parea = '' OR contains(parea, '化学药') OR contains(parea, '生物制品')))
SELECT k, title, src AS source_page_url, doc_url AS document_url, fmt AS document_format,
  {S.date_chain(S.clean('pub'), S.CATALOG_CHAIN)} AS published_date, status_raw, {S.status_of('si')} AS status_normalized,
  {S.sub_status_of('si')} AS sub_status, {S.topic('title', "nullif(parea, '')", 'summary')} AS topic_normalized,
  nullif(parea, '') AS product_area, summary, reference_number FROM f"""


# ---------------------------------------------------------------- ICH tree

_STATUS = ["Step 2b", "Step 3", "Step 4", "Step 5", "Public consultation", ""]
_FG = {
    0: '[{"title":"Guideline","weight":2,"files":[{"uri":"https://database.ich.org/E{k}_Guideline.pdf","mimetype":"application/pdf"}]},'
       '{"title":"Presentation","weight":1,"files":[{"uri":"https://database.ich.org/E{k}_Presentation.pptx","mimetype":"application/vnd.ms-powerpoint"}]}]',
    1: '[{"title":"Step 4 Presentation","weight":3,"files":[{"uri":"https://database.ich.org/E{k}.pptx","mimetype":"application/vnd.ms-powerpoint"}]},'
       '{"title":"Training","weight":1,"files":[{"uri":"https://database.ich.org/E{k}_Training.mp4","mimetype":"video/mp4"}]}]',
    2: '[]',
    3: '[{"title":"Guideline","weight":5,"files":[{"uri":"https://database.ich.org/E{k}.docx","mimetype":"application/msword"}]},'
       '{"title":"Q&A","files":[{"uri":"https://database.ich.org/E{k}_QA.pdf","mimetype":"application/pdf"}]}]',
    4: '[{"title":"Draft","weight":1,"files":[]},{"title":"Other","weight":2,"files":[{"mimetype":"text/html"}]},'
       '{"title":"Annex","weight":3,"files":[{"uri":"https://database.ich.org/E{k}_Annex.pdf"}]}]',
    5: '[{"title":"Other","weight":2,"files":[{"mimetype":"text/html"}]}]',
    6: '[{"title":"guideline ","files":[{"uri":"https://database.ich.org/E{k}.PDF","mimetype":"application/pdf"}]}]',
}
# Expected (uri template or None, format) of the primary document per case.
_FG_EXPECTED = {0: ("https://database.ich.org/E{k}_Guideline.pdf", "PDF"), 1: ("https://database.ich.org/E{k}_Training.mp4", "VIDEO"),
                2: (None, None), 3: ("https://database.ich.org/E{k}.docx", "DOCX"), 4: ("https://database.ich.org/E{k}_Annex.pdf", "PDF"),
                5: (None, "text/html"), 6: ("https://database.ich.org/E{k}.PDF", "PDF")}
GROUP = 25


def landed_ich_trees(spark, sf_dir):
    """S5 landing: one efficacy-page payload per 25 documents, leaves nested 0-2 levels deeper by chunk."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    ks = k.cast("string")
    code = F.when(k % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("E"), ks))
    title = F.when(k % 11 == 0, code).otherwise(clean_text("text"))
    end = F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int"))
    deadline = F.concat(F.lit("Deadline for comments by "), F.dayofmonth(end).cast("string"), F.lit(" "),
                        pick(MONTH_NAMES, F.month(end) - 1), F.lit(" "), F.year(end).cast("string"), F.lit("; see notes"))
    details = F.struct(raw_date_text(k, F.date_add(F.lit("2020-01-01").cast("date"), (k % 2400).cast("int"))).alias("stepDate"),
                       F.when(k % 4 == 0, F.lit("<b>Draft  Guideline</b>")).otherwise(F.lit("")).alias("infoTitle"),
                       F.array(F.struct(deadline.alias("text")), F.struct(F.lit("Note").alias("text")),
                               F.struct(F.lit("Deadline for comments by 1 January 2024").alias("text"))).alias("info"))
    head = F.to_json(F.struct(code.alias("code"), title.alias("title"),
                              F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("description"),
                              pick(_STATUS, k % 6).alias("status"),
                              F.when(k % 5 != 0, details).alias("details")))
    fg = F.replace(pick([_FG[i] for i in range(7)], k % 7), F.lit("{k}"), ks)
    leaf = F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"fileGroups":'), fg, F.lit("}"))
    leaves = d.select((k / GROUP).cast("long").alias("c"), k.alias("k"), leaf.alias("j"))
    g = leaves.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "j"))).alias("rows"))
    items = F.concat(F.lit('{"title":"Efficacy Guidelines","items":['),
                     F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit('],"code":"X","extra":{"code":"Y"}}'))
    c = F.col("c")
    wrapped = (F.when(c % 3 == 0, items).when(c % 3 == 1, F.concat(F.lit('{"items":['), items, F.lit("]}")))
               .otherwise(F.concat(F.lit('{"group":{"items":[{"items":['), items, F.lit("]}]}}"))))
    updated = F.when(c % 2 == 0, F.lit("2025-08-12T10:00:00+02:00")).otherwise(F.lit("2025-08-11"))
    payload = F.concat(F.lit('{"items":[{"bundleInfo":{"updated":"'), updated,
                       F.lit('"},"mainWidgets":{"items":[{"accordions":{"items":['), wrapped, F.lit("]}}]}}]}"))
    return _spread(g.select(c.alias("tree_id"), payload.alias("payload")))


@register("tree_walk_guidelines", lambda: _sql_ich())
def tree_walk_guidelines(spark, sf_dir):
    """S5 + W7 + A8 + F24 + F6: every guideline object at any depth of each page -> ICH catalog rows."""
    pages = FD.with_updated_date(FD.tree_pages(landed_ich_trees(spark, sf_dir), "tree_id"))
    objs = FD.walk_objects(pages, "tree_id", "page", keep=FD.is_guideline, carry=["updated_date"])
    rows = FD.ich_catalog(FD.ich_documents(objs, pages, "tree_id"), "tree_id", AS_OF_DATE)
    return rows.select("reference_number", "title", "document_url", "document_format", "published_date", "updated_date",
                       "comment_end_date", "status_raw", "status_normalized", "sub_status", "topic_normalized", "summary")


def _sql_ich() -> str:
    code = "'E' || CAST(doc_id AS VARCHAR)"
    title0 = f"CASE WHEN doc_id % 11 = 0 THEN {code} ELSE {S.clean('text')} END"
    end = "(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER))"
    step = S.raw_date_text("doc_id", "(DATE '2020-01-01' + CAST(doc_id % 2400 AS INTEGER))")
    uri = "CASE doc_id % 7 " + " ".join(
        f"WHEN {i} THEN " + ("NULL" if u is None else f"replace({S.q(u)}, '{{k}}', CAST(doc_id AS VARCHAR))")
        for i, (u, _f) in _FG_EXPECTED.items()) + " END"
    fmt = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN {S.q(f)}" for i, (_u, f) in _FG_EXPECTED.items()) + " END"
    desc = "'<p>' || coalesce(text, '') || '</p>'"
    summ = f"coalesce(nullif({S.normalize_ws(SH.fragment_text(S.clean(desc)))}, ''), 'Not available.')"
    status = f"{S.lst(_STATUS)}[doc_id % 6 + 1]"
    info_title = "CASE WHEN doc_id % 5 <> 0 AND doc_id % 4 = 0 THEN 'Draft Guideline' END"
    return f"""WITH b AS (SELECT doc_id, {code} AS code, {title0} AS t0, {summ} AS summary,
  concat_ws(' - ', nullif({status}, ''), {info_title}) AS sr0,
  CASE WHEN doc_id % 5 <> 0 THEN greatest({end}, DATE '2024-01-01') END AS comment_end_date,
  CASE WHEN doc_id % 5 <> 0 THEN {S.date_chain(S.clean(step), S.CATALOG_CHAIN)} END AS published_date,
  CASE WHEN (doc_id // {GROUP}) % 2 = 0 THEN DATE '2025-08-12' ELSE DATE '2025-08-11' END AS updated_date,
  {uri} AS document_url, {fmt} AS document_format FROM documents WHERE doc_id % 17 <> 0),
c AS (SELECT *, CASE WHEN coalesce(t0, '') = '' OR t0 = code THEN 'ICH ' || code ELSE 'ICH ' || code || ' - ' || t0 END AS title,
  nullif(sr0, '') AS status_raw FROM b),
d AS (SELECT *, {S.status_index('title', 'status_raw', "'ICH'", 'comment_end_date')} AS si FROM c)
SELECT code AS reference_number, title, document_url, document_format, published_date, updated_date, comment_end_date, status_raw,
  {S.status_of('si')} AS status_normalized, {S.sub_status_of('si')} AS sub_status,
  {S.topic('title', "'Efficacy'", 'summary')} AS topic_normalized, summary FROM d"""
