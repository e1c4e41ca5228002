"""Semi-structured feed ingest.

Landed payloads are read as text (one JSON document per row, e.g.
``spark.read.text(path, wholetext=True)``) and parsed with Spark's own JSON and
VARIANT functions: ``parse_json`` / ``try_variant_get`` for schema-on-read,
``from_json`` for known shapes.  Rows keep a feed order (page start, position)
so order-dependent rules (caps, keep-first) stay deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.functions.classify import split_title_status, with_status, with_topic
from doccat.functions.dates import (
    DEADLINE,
    legacy_iso_date,
    parse_api_datetime,
    parse_date,
    parse_date_day_first,
    range_end,
)
from doccat.functions.labels import yes_no
from doccat.functions.rules import (
    CDE_ALLOWED_PRODUCT_AREAS,
    EMA_ORGANIZATION,
    NOT_AVAILABLE,
)
from doccat.functions.text import category_separator, clean_text, fragment_text, let, normalize_whitespace, nullif_empty, plain_references, strip_tags
from doccat.functions.urls import HREF_TAG, absolute_url, absolute_url_col, first_pdf_or_download, href_value, mime_format

# ---------------------------------------------------------------------------
# FIXED VALUES: bases and the FDA row layout (cell name -> keys, first present wins; list index = position)
# ---------------------------------------------------------------------------
FDA_BASE_URL = "https://www.fda.gov"
CDE_BASE_URL = "https://www.cde.org.cn"
CDE_LIST_URL = "https://www.cde.org.cn/zdyz/listpage/9cd8db3b7530c6fa0c86485e563f93c7?isHomePage=true"
CDE_DETAIL_URL = "https://www.cde.org.cn/zdyz/domesticinfopage?zdyzIdCODE="
ICH_EFFICACY_URL = "https://www.ich.org/page/efficacy-guidelines"

FDA_CELL_KEYS = [
    ("summary", ["field_summary", "summary", "title", "0"]),
    ("document", ["field_document", "field_associated_media_2", "document", "1"]),
    ("issue_date", ["field_issue_date", "field_issue_datetime", "issue_date", "2"]),
    ("organization", ["field_organization", "field_issuing_office_taxonomy", "organization", "fda_organization", "3"]),
    ("topic", ["field_topic", "topics-product", "field_topics", "topic", "4"]),
    ("guidance_status", ["field_guidance_status", "field_final_guidance_1", "guidance_status", "status", "5"]),
    ("open_for_comment", ["field_open_for_comment", "open-comment", "open_for_comment", "6"]),
    ("comment_closing_date", ["field_comment_closing_date", "field_comment_closing_date_on_draft",
                              "field_comment_close_date", "comment_closing_date", "7"]),
    ("docket_number", ["field_docket_number", "docket_number", "8"]),
]

# CDE item key aliases (first non-empty after cleanup; exact key, then case-insensitive).
CDE_KEYS = {
    "title": ["title", "name", "bt", "noticeTitle", "guideName"],
    "product_area": ["productArea", "drugType", "scope", "适用范围", "fclass"],
    "document": ["document_url", "fileUrl", "attachmentUrl"],
    "document_format": ["document_format", "fileFormat"],
    "published": ["published_date", "publishDate", "date", "发布日期", "issueDate"],
    "updated": ["updated_date", "updateDate"],
    "summary": ["summary", "content", "description"],
    "status": ["status", "nowstate", "versionState"],
    "code": ["zdyzIdCODE", "idCODE", "id"],
    "url": ["url", "href", "link", "source_page_url"],
    "dedupe_title": ["title", "name"],
}

#: The first href that is not empty.
FIRST_HREF = HREF_TAG.replace('("[^"]*"|\'[^\']*\'', '("[^"]+"|\'[^\']+\'', 1)


def read_landed_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: (file, payload text)."""
    return (spark.read.option("wholetext", True).text(path)
            .select(F.input_file_name().alias("file"), F.col("value").alias("payload")))


def _reject_reason(v: Column, path: str) -> Column:
    return F.when(v.isNull(), F.lit("unreadable JSON")).when(
        F.try_variant_get(v, path, "array<variant>").isNull(), F.lit(f"no list at {path}"))


def feed_rejects(files: DataFrame, list_path: str, payload_col: str = "payload", file_col: str = "file") -> DataFrame:
    """Landed files that a feed reader cannot use: (file, reason, length in characters).

    The readers skip such files unless they are strict; this frame is the trace of what they skip.
    """
    p = F.coalesce(F.col(payload_col), F.lit(""))
    out = files.select(F.col(file_col).alias("file"), _reject_reason(F.try_parse_json(p), list_path).alias("reason"), F.length(p).alias("length"))
    return out.filter(F.col("reason").isNotNull())


def _feed_list(v: Column, path: str, strict: bool) -> Column:
    """The list at ``path``; where there is none, null, or an error if ``strict``."""
    rows = F.try_variant_get(v, path, "array<variant>")
    if not strict:
        return rows
    reason = _reject_reason(v, path)
    return F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("feed payload: "), reason)).cast("array<variant>")).otherwise(rows)


# ---------------------------------------------------------------- FDA list


def fda_paged_rows(pages: DataFrame, payload_col: str = "payload", strict: bool = False) -> DataFrame:
    """DataTables pages -> (start, pos, total, row) in feed order; empty pages add nothing.

    Unusable pages are skipped (see ``feed_rejects``), or raise if ``strict``.
    """
    v = F.try_parse_json(F.col(payload_col))
    total = F.coalesce(F.nullif(F.try_variant_get(v, "$.recordsFiltered", "bigint"), F.lit(0)),
                       F.try_variant_get(v, "$.recordsTotal", "bigint"), F.lit(0))
    p = pages.select(F.coalesce(F.try_variant_get(v, "$.start", "bigint"), F.lit(0)).alias("start"),
                     total.alias("total"), _feed_list(v, "$.data", strict).alias("data"))
    return p.select("start", "total", F.posexplode("data").alias("pos", "row"))


def paged_totals(pages: DataFrame, source_col: str, payload_col: str = "payload") -> DataFrame:
    """S2 + A7: per paged feed its declared total, landed pages, parsed rows, missing rows and the verdict.

    Pages that disagree on the total, or unusable ones, are a mismatch too: nothing is passed over in silence.
    """
    v = F.try_parse_json(F.col(payload_col))
    total = F.coalesce(F.nullif(F.try_variant_get(v, "$.recordsFiltered", "bigint"), F.lit(0)), F.try_variant_get(v, "$.recordsTotal", "bigint"))
    read = pages.select(F.col(source_col).alias("source"), total.alias("total"), F.size(F.try_variant_get(v, "$.data", "array<variant>")).alias("n"))
    sums = read.groupBy("source").agg(
        F.max("total").alias("declared_total"), F.min("total").alias("least"), F.count(F.lit(1)).alias("pages"),
        F.sum(F.greatest(F.coalesce("n", F.lit(0)), F.lit(0))).cast("bigint").alias("parsed"), F.count_if(F.coalesce("n", F.lit(-1)) < 0).alias("unusable"))
    whole = (F.col("declared_total") == F.col("parsed")) & (F.col("least") == F.col("declared_total")) & (F.col("unusable") == 0)
    return sums.select("source", "declared_total", "pages", "parsed", (F.col("declared_total") - F.col("parsed")).alias("missing"),
                       F.when(whole, F.lit("ok")).otherwise(F.lit("mismatch")).alias("verdict"))


def fda_static_rows(files: DataFrame, payload_col: str = "payload", file_col: str = "file", strict: bool = False) -> DataFrame:
    """Static JSON array files -> (file, pos, row); unusable files are skipped, or raise if ``strict``."""
    v = F.try_parse_json(F.col(payload_col))
    return files.select(file_col, F.posexplode(_feed_list(v, "$", strict)).alias("pos", "row"))


def fda_row_cells(row: Column, arr: Column | None = None, obj: Column | None = None,
                  is_obj: Column | None = None) -> Column:
    """a row (array of up to 9 cells, or object keyed by aliases) -> struct of 9 cell strings.

    Arrays are padded with ''; objects take the first *present* key even when
    its value is empty; other JSON types give a null struct (rejected rows).
    Pass ``arr`` / ``obj`` / ``is_obj`` already projected (see ``parse_fda_rows``)
    to evaluate the JSON conversions once per row.
    """
    arr = F.try_variant_get(row, "$", "array<variant>") if arr is None else arr
    obj = F.from_json(F.to_json(row), "map<string,string>") if obj is None else obj
    is_obj = F.try_variant_get(row, "$", "map<string,variant>").isNotNull() if is_obj is None else is_obj
    fields = []
    for i, (name, keys) in enumerate(FDA_CELL_KEYS):
        from_arr = F.coalesce(F.try_variant_get(row, f"$[{i}]", "string"), F.lit(""))
        pick = None
        for k in keys:
            cond = F.map_contains_key(obj, k)
            val = F.coalesce(F.element_at(obj, F.lit(k)), F.lit(""))
            pick = F.when(cond, val) if pick is None else pick.when(cond, val)
        from_obj = pick.otherwise(F.lit(""))
        fields.append(F.when(arr.isNotNull(), from_arr).when(is_obj, from_obj).alias(name))
    return F.when(arr.isNotNull() | is_obj, F.struct(*fields))


def cell_text(cell: Column) -> Column:
    """H3: text of an HTML cell (tags to blanks, F2), falling back to the cleaned raw value."""
    return F.coalesce(let(normalize_whitespace(strip_tags(cell)), nullif_empty), normalize_whitespace(cell))


def cell_links(cell: Column, base: str = FDA_BASE_URL) -> Column:
    """H3: absolute hrefs of the anchors in a cell, in order."""
    markup = plain_references(F.coalesce(cell, F.lit("")))
    hrefs = F.filter(F.transform(F.regexp_extract_all(markup, F.lit(HREF_TAG), 1), href_value), lambda h: h != "")
    return F.transform(hrefs, lambda h: absolute_url(h, base))


def fda_record(cells: Column) -> list[Column]:
    """Legacy record fields from the 9 cells (name = summary text, PDF link F26 or document text)."""
    summary_text = cell_text(cells["summary"])
    # the page link is the first anchor with a non-empty href: one codegen'd regex, no array lambdas
    first_href = F.regexp_extract(plain_references(F.coalesce(cells["summary"], F.lit(""))), FIRST_HREF, 1)
    page_link = let(first_href, lambda x: F.when(x != "", absolute_url(href_value(x), FDA_BASE_URL)))
    doc_text = cell_text(cells["document"])
    pdf = first_pdf_or_download(cell_links(cells["document"]))
    return [
        F.lit("FDA").alias("health_authority"),
        summary_text.alias("guidance_name"),
        summary_text.alias("summary"),
        legacy_iso_date(cells["issue_date"]).alias("issue_date"),
        normalize_whitespace(cells["organization"]).alias("fda_organization"),
        normalize_whitespace(cells["topic"]).alias("topic"),
        normalize_whitespace(cells["guidance_status"]).alias("guidance_status"),
        yes_no(cells["open_for_comment"]).alias("open_for_comment"),
        legacy_iso_date(cells["comment_closing_date"]).alias("comment_closing_date_on_draft"),
        F.coalesce(let(pdf, nullif_empty), doc_text).alias("guidance_pdf_link"),
        F.coalesce(page_link, F.lit("")).alias("guidance_page_link"),
        cell_text(cells["docket_number"]).alias("docket_number"),
    ]


def parse_fda_rows(rows: DataFrame, order_cols: list[str]) -> DataFrame:
    """Rows -> legacy records (rejects: rows of an unsupported JSON type are dropped)."""
    staged = rows.select(*order_cols, "row", F.try_variant_get("row", "$", "array<variant>").alias("_arr"),
                         F.from_json(F.to_json("row"), "map<string,string>").alias("_obj"),
                         F.try_variant_get("row", "$", "map<string,variant>").isNotNull().alias("_is_obj"))
    c = staged.select(*order_cols, fda_row_cells(F.col("row"), F.col("_arr"), F.col("_obj"), F.col("_is_obj")).alias("cells"))
    c = c.filter(F.col("cells").isNotNull()).select(*order_cols, "cells.*")
    cells = {name: F.col(name) for name, _k in FDA_CELL_KEYS}
    return c.select(*order_cols, *fda_record(cells))


# ---------------------------------------------------------------- EMA feed

EMA_ROW_SCHEMA = ("title string, summary string, categories string, first_published_date string, "
                  "last_updated_date string, general_url string, reference_number string, consultation_date string")


def ema_feed_rows(files: DataFrame, payload_col: str = "payload", strict: bool = False) -> DataFrame:
    """S3: feed payloads -> (total_records, pos, row struct); non-object entries are skipped.

    Payloads without a list of data are skipped (see ``feed_rejects``), or raise if ``strict``.
    """
    v = F.try_parse_json(F.col(payload_col))
    data = _feed_list(v, "$.data", strict)
    p = files.select(F.try_variant_get(v, "$.meta.total_records", "string").alias("total_records"),
                     F.coalesce(F.try_variant_get(v, "$.meta.page", "bigint"), F.lit(0)).alias("page"),
                     data.alias("data"))
    r = p.select("total_records", "page", F.posexplode("data").alias("pos", "row")).withColumn("pos", F.col("pos").cast("bigint"))
    r = r.filter(F.try_variant_get(F.col("row"), "$", "map<string,variant>").isNotNull())
    return r.select("total_records", "page", "pos",
                    F.from_json(F.to_json("row"), EMA_ROW_SCHEMA).alias("r"))


def ema_documents(rows: DataFrame) -> DataFrame:
    """S3 -> catalog rows: title and URL required, suffix split, day-first dates, EMA status, topic."""
    title = clean_text(F.col("r.title"))
    url = clean_text(F.col("r.general_url"))
    r = rows.filter((title != "") & (url != "")).select(
        "page", "pos", title.alias("raw_title"), url.alias("source_page_url"),
        clean_text(F.col("r.summary")).alias("_summary"), clean_text(F.col("r.categories")).alias("topic_raw"),
        F.col("r.first_published_date").alias("_pub"), F.col("r.last_updated_date").alias("_upd"),
        F.col("r.consultation_date").alias("_cons"), clean_text(F.col("r.reference_number")).alias("_ref"))
    name, status_raw = split_title_status(F.col("raw_title"))
    r = r.select("*", name.alias("title"), status_raw.alias("status_raw"))
    summary = F.when(F.col("_summary") != "", F.col("_summary")).otherwise(F.lit(NOT_AVAILABLE))
    r = r.withColumn("summary", summary)
    r = with_status(r, "title", "status_raw", F.lit("EMA"), F.lit(None).cast("date"), "1970-01-01")
    r = with_topic(r, "title", "topic_raw", "summary")
    return r.select(
        "page", "pos", "title", F.lit("EMA").alias("agency"), F.lit("EU").alias("jurisdiction"), "source_page_url",
        parse_date_day_first(F.col("_pub")).alias("published_date"),
        parse_date_day_first(F.col("_upd")).alias("updated_date"),
        parse_date_day_first(range_end(F.col("_cons"))).alias("comment_end_date"),
        "status_raw", "status_normalized", "sub_status", "topic_raw", "topic_normalized",
        "summary", F.lit("EN").alias("language"),
        F.when(F.col("_ref") != "", F.col("_ref")).alias("reference_number"))


def ema_legacy_records(rows: DataFrame) -> DataFrame:
    """Scientific-guideline rows only -> legacy records (P2, F11 legacy, F5 day-first, F14, F31)."""
    from doccat.functions.classify import open_for_comment_flag
    from doccat.operators.search import scientific_guideline
    r = rows.filter(scientific_guideline(F.col("r.title"), F.col("r.general_url")))
    raw_title = normalize_whitespace(F.col("r.title"))
    name, status = split_title_status(raw_title, legacy=True)
    return r.select(
        "page", "pos",
        F.lit("EMA").alias("health_authority"), name.alias("guidance_name"),
        normalize_whitespace(F.col("r.summary")).alias("summary"),
        legacy_iso_date(F.col("r.first_published_date"), day_first=True).alias("issue_date"),
        F.lit(EMA_ORGANIZATION).alias("fda_organization"),
        category_separator(normalize_whitespace(F.col("r.categories"))).alias("topic"),
        status.alias("guidance_status"), open_for_comment_flag(status).alias("open_for_comment"),
        legacy_iso_date(range_end(normalize_whitespace(F.coalesce(F.col("r.consultation_date"), F.lit("")))),
                        day_first=True).alias("comment_closing_date_on_draft"),
        F.lit("").alias("guidance_pdf_link"),
        normalize_whitespace(F.col("r.general_url")).alias("guidance_page_link"),
        normalize_whitespace(F.col("r.reference_number")).alias("docket_number"))


def feed_completeness(rows: DataFrame, documents: DataFrame, search_count: Column | None) -> DataFrame:
    """A7 on a feed: declared meta total (else parsed count) vs parsed documents vs the search-page count."""
    declared = rows.agg(F.max(F.expr("try_cast(replace(total_records, ',', '') AS BIGINT)")).alias("declared_total"))
    parsed = documents.agg(F.count(F.lit(1)).alias("parsed"))
    j = declared.crossJoin(parsed)
    ext = search_count if search_count is not None else F.lit(None).cast("bigint")
    j = j.withColumn("external_count", ext)
    json_count = F.coalesce(F.nullif(F.col("declared_total"), F.lit(0)), F.col("parsed"))
    verdict = (F.when(F.col("external_count").isNull(), F.lit("unverified"))
               .when((json_count != F.col("external_count")) | (F.col("parsed") != F.col("external_count")), F.lit("mismatch"))
               .otherwise(F.lit("ok")))
    return j.select("declared_total", "parsed", "external_count", verdict.alias("verdict"))


# ---------------------------------------------------------------- CDE items


def first_value(m: Column, keys: list[str]) -> Column:
    """F9 (list feed): first key whose value is non-empty after F1; exact key, then any case; else ''."""
    parts = []
    for k in keys:
        exact = F.element_at(m, F.lit(k))
        anycase = F.try_element_at(F.map_values(F.map_filter(m, lambda kk, _v: F.lower(kk) == F.lit(k.lower()))), F.lit(-1))
        v = clean_text(F.coalesce(exact, anycase))
        parts.append(F.when(v != "", v))
    return F.coalesce(*parts, F.lit(""))


def cde_format(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low == "", F.lit(None)).when(low.endswith(".pdf"), F.lit("PDF")).when(
        low.endswith(".doc") | low.endswith(".docx"), F.lit("DOCX"))


def cde_items(items: DataFrame, map_col: str = "item") -> DataFrame:
    """Items (map<string,string>) -> catalog rows; P3 drops items of other product areas."""
    m = F.col(map_col)
    fv = {k: first_value(m, keys) for k, keys in CDE_KEYS.items()}
    x = items.select("*", *[v.alias(f"_{k}") for k, v in fv.items()])
    area_ok = (F.col("_product_area") == "") | F.exists(
        F.array(*[F.lit(a) for a in CDE_ALLOWED_PRODUCT_AREAS]), lambda a: F.col("_product_area").contains(a))
    x = x.filter((F.col("_title") != "") & area_ok)
    src = (F.when(F.col("_url") != "", absolute_url(F.col("_url"), CDE_BASE_URL))
           .when(F.col("_code") != "", F.concat(F.lit(CDE_DETAIL_URL), F.col("_code")))
           .otherwise(F.lit(CDE_LIST_URL)))
    doc_url = F.when(F.col("_document") != "", absolute_url(F.col("_document"), CDE_BASE_URL))
    fmt = F.coalesce(F.when(F.col("_document_format") != "", F.col("_document_format")), cde_format(F.col("_document")))
    fmt = F.coalesce(fmt, cde_format(doc_url))
    summary = F.when(F.col("_summary") != "", F.col("_summary")).otherwise(F.lit(NOT_AVAILABLE))
    area = F.when(F.col("_product_area") != "", F.col("_product_area"))
    keep = [c for c in items.columns if c != map_col]
    x = x.withColumn("_summary_out", summary).withColumn("_area", area)
    x = with_status(x, "_title", "_status", F.lit("CDE"), F.lit(None).cast("date"), "1970-01-01")
    x = with_topic(x, "_title", "_area", "_summary_out")
    return x.select(
        *keep, F.col("_title").alias("title"), F.lit("CDE").alias("agency"), F.lit("China").alias("jurisdiction"),
        src.alias("source_page_url"), doc_url.alias("document_url"), fmt.alias("document_format"),
        parse_date(F.col("_published")).alias("published_date"), parse_date(F.col("_updated")).alias("updated_date"),
        F.col("_status").alias("status_raw"), "status_normalized", "sub_status",
        F.col("_area").alias("topic_raw"), "topic_normalized",
        F.col("_area").alias("product_area"), F.col("_summary_out").alias("summary"), F.lit("ZH").alias("language"),
        F.when(F.col("_code") != "", F.col("_code")).alias("reference_number"),
        F.coalesce(F.when(F.col("_code") != "", F.col("_code")), F.when(F.col("_dedupe_title") != "", F.col("_dedupe_title")),
                   F.lit("")).alias("dedupe_key"))


# ---------------------------------------------------------------- ICH tree


def _tree_reason(v: Column) -> Column:
    """Why a payload has no page: it must be JSON with an object as the first of its items."""
    page = F.try_variant_get(v, "$.items[0]", "map<string,variant>")
    return F.when(v.isNull(), F.lit("unreadable JSON")).when(page.isNull(), F.lit("no page at $.items[0]"))


def tree_pages(trees: DataFrame, id_col: str, payload_col: str = "payload", strict: bool = False) -> DataFrame:
    """(id, page) with ``page`` the first item of each payload; payloads without one are left to ``tree_rejects``,
    or raise if ``strict``, as the source does."""
    def page(v: Column) -> Column:
        first = F.try_variant_get(v, "$.items[0]", "variant")
        if not strict:
            return F.when(_tree_reason(v).isNull(), first)
        return let(_tree_reason(v), lambda reason: F.when(reason.isNotNull(), F.raise_error(F.concat(
            F.lit("tree payload: "), reason)).cast("variant")).otherwise(first))

    # exploded and not filtered: a filter would be pushed down and parse every payload again
    parsed = let(F.try_parse_json(F.coalesce(F.col(payload_col), F.lit(""))), page)
    return trees.select(id_col, F.explode(F.array_compact(F.array(parsed))).alias("page"))


def tree_rejects(trees: DataFrame, payload_col: str = "payload", file_col: str = "file") -> DataFrame:
    """Landed tree payloads without a page: (file, reason, length in characters)."""
    p = F.coalesce(F.col(payload_col), F.lit(""))
    out = trees.select(F.col(file_col).alias("file"), _tree_reason(F.try_parse_json(p)).alias("reason"), F.length(p).alias("length"))
    return out.filter(F.col("reason").isNotNull())


#: Levels that one step of the walk goes down; deeper nodes are left to the next step.
WALK_LEVELS = 24
_NODES = "array<struct<path:array<string>,node:variant,done:boolean>>"


def _children(node: Column, path: Column, obj: Column) -> Column:
    """Members of an object (``obj``: the node as a map, else null) or elements of an array, with extended paths."""
    def child(key: Column, value: Column) -> Column:
        return F.struct(F.concat(path, F.array(key)).alias("path"), value.alias("node"), F.lit(False).alias("done"))

    members = F.transform(F.map_entries(obj), lambda e: child(F.concat(F.lit("k:"), e["key"]), e["value"]))
    elements = F.transform(F.try_variant_get(node, "$", "array<variant>"),
                           lambda v, i: child(F.concat(F.lit("i:"), F.lpad(i.cast("string"), 10, "0")), v))
    return F.coalesce(members, elements, F.array()).cast(_NODES)


def _one_level_down(nodes: Column, keep: Callable[[Column], Column] | None) -> Column:
    """Each node that is not done yet becomes itself, done, if it is an object to keep, and its children; others go."""
    def down(x: Column) -> Column:
        def expanded(obj: Column) -> Column:
            kept = obj.isNotNull() if keep is None else obj.isNotNull() & keep(x["node"])
            itself = F.array(F.struct(x["path"].alias("path"), x["node"].alias("node"), F.lit(True).alias("done")))
            return F.concat(F.when(kept, itself).otherwise(F.array()).cast(_NODES), _children(x["node"], x["path"], obj))

        return F.when(x["done"], F.array(x).cast(_NODES)).otherwise(
            let(F.try_variant_get(x["node"], "$", "map<string,variant>"), expanded))

    return F.flatten(F.transform(nodes, down))


def walk_objects(roots: DataFrame, id_col: str, v_col: str, keep: Callable[[Column], Column] | None = None,
                 carry: Sequence[str] = (), levels: int = WALK_LEVELS) -> DataFrame:
    """Every JSON object at any depth of each root, with its path (pre-order = sort by path).

    ``keep`` says which objects are returned (all are looked at; the default returns all); columns named in
    ``carry`` go from a root to its objects.

    A step goes down ``levels`` levels within a row: each level replaces the open nodes by their children, so
    subtrees are neither written nor shuffled from level to level.  What a step found and what it left open are
    spread round-robin over the default parallelism, so the objects of a large payload reach all tasks (a payload
    itself is bounded by the size of a variant), and checkpointed to the shared checkpoint folder, so payloads are
    parsed and walked once.  A payload is finite, so the loop ends when nothing is open, however deep it is.
    """
    from doccat.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(roots.sparkSession)
    n_parts = max(1, roots.sparkSession.sparkContext.defaultParallelism)
    level = roots.select(F.col(id_col).alias("_id"), *carry, F.array().cast("array<string>").alias("path"), F.col(v_col).alias("node"))
    found = []
    while True:
        step = level.select("_id", *carry, F.array(F.struct("path", "node", F.lit(False).alias("done"))).cast(_NODES).alias("nodes"))
        for _ in range(levels):  # a projection each, which the optimizer puts together
            step = step.select("_id", *carry, _one_level_down(F.col("nodes"), keep).alias("nodes"))
        step = step.select("_id", *carry, F.explode("nodes").alias("x")).select("_id", *carry, "x.*")
        step = step.repartition(n_parts).checkpoint(eager=True)
        found.append(step.filter("done").select("_id", *carry, "path", F.col("node").alias("obj")))
        level = step.filter(~F.col("done")).drop("done")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).withColumnRenamed("_id", id_col)


def _vstr(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def html_text(c: Column) -> Column:
    """H2 on a feed field: cleaned fragment text, null when empty."""
    return nullif_cleaned(normalize_whitespace(strip_tags(clean_text(c))))


def nullif_cleaned(c: Column) -> Column:
    """The text, null when empty, computed once."""
    return let(c, lambda t: F.when(t != "", t))


FILE_GROUPS_TYPE = "array<struct<title:string,weight:bigint,files:array<variant>>>"


def primary_document(file_groups: Column) -> Column:
    """struct(uri, format) of the first file of the best group.

    Groups sorted by weight (missing = 0, stable); a group titled 'guideline'
    wins; otherwise the first group with files whose first file has a URI, else
    the last such candidate without one.
    """
    def cand(x):
        f = x["g"]["files"][0]
        is_obj = F.try_variant_get(f, "$", "map<string,variant>").isNotNull()
        return let(nullif_cleaned(_vstr(f, "$.uri")), lambda uri: let(nullif_cleaned(_vstr(f, "$.mimetype")), lambda mime: F.struct(
            F.when(is_obj, uri).alias("uri"), F.when(is_obj, mime_format(mime, uri)).alias("format"),
            F.lower(clean_text(x["g"]["title"])).alias("t"))))

    def candidates(groups):
        keys = F.array_sort(F.transform(groups, lambda g, i: F.struct(F.coalesce(g["weight"], F.lit(0)).alias("w"), i.alias("i"))))
        ordered = F.transform(keys, lambda x: F.struct(F.element_at(groups, x["i"] + 1).alias("g")))
        return F.transform(F.filter(ordered, lambda x: x["g"].isNotNull() & (F.size(x["g"]["files"]) > 0)), cand)

    def best(cands):
        guideline = F.try_element_at(F.filter(cands, lambda c: c["t"] == "guideline"), F.lit(1))
        with_uri = F.try_element_at(F.filter(cands, lambda c: c["uri"].isNotNull()), F.lit(1))
        return F.coalesce(guideline, with_uri, F.try_element_at(cands, F.lit(-1)))

    # groups, candidates and the best one are bound once: each is read by many expressions
    chosen = let(let(F.try_variant_get(file_groups, "$", FILE_GROUPS_TYPE), candidates), best)
    return let(chosen, lambda c: F.struct(c["uri"].alias("uri"), c["format"].alias("format")))


def latest_deadline(details: Column) -> Column:
    """Latest parseable 'Deadline for comments by ...' date among the info texts."""
    info = F.try_variant_get(details, "$.info", "array<variant>")
    dates = F.transform(info, lambda e: parse_date(F.trim(F.regexp_extract(F.coalesce(_vstr(e, "$.text"), F.lit("")), DEADLINE, 1))))
    return F.array_max(F.filter(dates, lambda d: d.isNotNull()))


def is_guideline(obj: Column) -> Column:
    """An object with a truthy code and a fileGroups key."""
    return (clean_text(_vstr(obj, "$.code")) != "") & F.map_contains_key(F.try_variant_get(obj, "$", "map<string,variant>"), F.lit("fileGroups"))


def with_updated_date(pages: DataFrame) -> DataFrame:
    """pages (page variant = items[0]) with the date they were updated."""
    return pages.withColumn("updated_date", parse_api_datetime(_vstr(F.col("page"), "$.bundleInfo.updated")))


def ich_documents(objects: DataFrame, pages: DataFrame | None, id_col: str) -> DataFrame:
    """S5 -> catalog rows: guideline objects (truthy code and a fileGroups key) of each page.

    ``pages`` (id, page variant = items[0]) gives the page's updated date (F6), unless the objects carry it.
    """
    g = objects.filter(is_guideline(F.col("obj")))
    if "updated_date" not in objects.columns:
        g = g.join(with_updated_date(pages).select(id_col, "updated_date"), id_col, "left")
    obj = F.col("obj")
    details_ok = F.try_variant_get(obj, "$.details", "map<string,variant>").isNotNull()
    details = F.col("_details")
    # what an object holds is taken out first, so that texts are cleaned once and no subtree goes on
    g = g.withColumn("_details", F.when(details_ok, F.try_variant_get(obj, "$.details", "variant")))
    g = g.select(id_col, "path", "updated_date", clean_text(_vstr(obj, "$.code")).alias("_code"), clean_text(_vstr(obj, "$.title")).alias("_title0"),
                 strip_tags(clean_text(_vstr(obj, "$.description"))).alias("_description"), clean_text(_vstr(obj, "$.status")).alias("_status"),
                 strip_tags(clean_text(_vstr(details, "$.infoTitle"))).alias("_info"),
                 strip_tags(clean_text(_vstr(details, "$.stepDateLabel"))).alias("_label"),
                 latest_deadline(details).alias("comment_end_date"), parse_date(_vstr(details, "$.stepDate")).alias("published_date"),
                 primary_document(F.try_variant_get(obj, "$.fileGroups", "variant")).alias("_doc"))
    code, title0 = F.col("_code"), F.col("_title0")
    full = let(F.when(title0 != "", title0).otherwise(code), lambda title: F.when(title == code, F.concat(F.lit("ICH "), code)).otherwise(
        F.concat(F.lit("ICH "), code, F.lit(" - "), title)))
    text = {c: nullif_cleaned(normalize_whitespace(F.col(c))) for c in ("_description", "_info", "_label")}
    status_raw = F.concat_ws(" - ", F.nullif(F.col("_status"), F.lit("")), text["_info"], text["_label"])
    return g.select(id_col, "path", "updated_date", full.alias("title"), code.alias("reference_number"),
                    F.coalesce(text["_description"], F.lit(NOT_AVAILABLE)).alias("summary"), nullif_cleaned(status_raw).alias("status_raw"),
                    "comment_end_date", "published_date", "_doc")


def ich_catalog(x: DataFrame, id_col: str, as_of: str) -> DataFrame:
    x = with_status(x, "title", "status_raw", F.lit("ICH"), "comment_end_date", as_of)
    x = with_topic(x, "title", F.lit("Efficacy"), "summary")
    return x.select(
        id_col, "path", "title", F.lit("ICH").alias("agency"), F.lit("International").alias("jurisdiction"),
        F.lit(ICH_EFFICACY_URL).alias("source_page_url"), F.col("_doc.uri").alias("document_url"),
        F.col("_doc.format").alias("document_format"), "published_date", "updated_date", "comment_end_date",
        "status_raw", "status_normalized", "sub_status", F.lit("Efficacy").alias("topic_raw"), "topic_normalized",
        F.lit("Efficacy").alias("product_area"), "summary", F.lit("EN").alias("language"), "reference_number")
