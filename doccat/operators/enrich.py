"""Detail-page enrichment joins.

Records meet their detail pages through one left equi join on the URL; a
record without a page keeps its values.  What a record takes from a page is
extracted first, in the scan, and only that is shuffled: one row per URL, the
latest crawl (largest ``page_id``; among equal or absent ids the largest
extracted value), so a page crawled twice never doubles a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.functions.classify import status_columns
from doccat.operators import html as H


def _one_page(pages: DataFrame, **extracted: Column) -> DataFrame:
    """``_url`` and the extracted columns of the latest crawl of each URL."""
    crawl = F.col("page_id") if "page_id" in pages.columns else F.lit(0)
    rows = pages.filter(F.col("url").isNotNull()).select(F.col("url").alias("_url"), crawl.alias("_crawl"), F.struct(
        *[c.alias(n) for n, c in extracted.items()]).alias("_got"))
    return rows.groupBy("_url").agg(F.max(F.struct("_crawl", "_got")).alias("_last")).select("_url", "_last._got.*")


def enrich_summaries(records: DataFrame, pages: DataFrame, url_col: str = "guidance_page_link",
                     summary_col: str = "summary") -> DataFrame:
    """summary = page summary when non-empty, else the record's own; missing pages keep the record."""
    pg = _one_page(pages, _page_summary=H.page_summary(F.col("html")))
    j = records.join(pg, records[url_col] == pg["_url"], "left")
    return j.withColumn(summary_col, F.coalesce(F.when(F.col("_page_summary") != "", F.col("_page_summary")),
                                                F.col(summary_col))).drop("_url", "_page_summary")


def enrich_status_and_pdf(docs: DataFrame, pages: DataFrame, as_of: str) -> DataFrame:
    """The detail page's current-version status (re-classified) and first PDF link.

    Status fields change only when the page gives a status; a PDF link replaces
    ``document_url`` and sets the format to PDF.
    """
    pg = _one_page(pages, _status_raw=H.current_version_status(F.col("html")),
                   _pdf=H.first_pdf_link(F.col("html"), F.lit("https://www.ema.europa.eu")))
    j = docs.join(pg, docs["source_page_url"] == pg["_url"], "left")
    st, sub = status_columns(F.col("title"), F.col("_status_raw"), F.lit("EMA"), F.col("comment_end_date"), as_of)
    has = F.col("_status_raw").isNotNull() & (F.col("_status_raw") != "")
    return (j.withColumn("status_normalized", F.when(has, st).otherwise(F.col("status_normalized")))
            .withColumn("sub_status", F.when(has, sub).otherwise(F.col("sub_status")))
            .withColumn("status_raw", F.when(has, F.col("_status_raw")).otherwise(F.col("status_raw")))
            .withColumn("document_url", F.coalesce(F.col("_pdf"), F.col("document_url")))
            .withColumn("document_format", F.when(F.col("_pdf").isNotNull(), F.lit("PDF")).otherwise(F.col("document_format")))
            .drop("_url", "_status_raw", "_pdf"))


def enrich_attachments(items: DataFrame, pages: DataFrame, url_col: str = "detail_url",
                       base: str = "https://www.cde.org.cn") -> DataFrame:
    """The detail page's first attachment sets document_url / document_format when found."""
    pg = _one_page(pages, _att=H.first_attachment(F.col("html"), F.lit(base)))
    j = items.join(pg, items[url_col] == pg["_url"], "left")
    return (j.withColumn("document_url", F.coalesce(F.col("_att.url"), F.col("document_url")))
            .withColumn("document_format", F.coalesce(F.col("_att.format"), F.col("document_format")))
            .drop("_url", "_att"))


def in_scope_links(links: DataFrame, sources: DataFrame, parent_col: str, section_col: str) -> DataFrame:
    """Links of configured source pages whose sections pass the source's rules.

    ``sources`` (url, product_area, allowed_sections array or null,
    required_parent or null) is a configuration table: its size is checked
    before it is broadcast.
    """
    n = sources.count()
    src = F.broadcast(sources) if n <= 100_000 else sources
    j = links.join(src, "url")
    ok = ((F.col("required_parent").isNull() | (F.col(parent_col) == F.col("required_parent")))
          & (F.col("allowed_sections").isNull() | F.array_contains(F.col("allowed_sections"), F.col(section_col))))
    return j.filter(ok)


def source_audit(sources: DataFrame, pages: DataFrame, kept_links: DataFrame) -> DataFrame:
    """Every configured page must be present and yield rows: verdict per source URL."""
    present = pages.select("url").distinct().withColumn("_present", F.lit(True))
    counts = kept_links.groupBy("url").agg(F.count(F.lit(1)).alias("rows"))
    j = sources.select("url").join(present, "url", "left").join(counts, "url", "left")
    verdict = (F.when(F.col("_present").isNull(), F.lit("missing page"))
               .when(F.coalesce(F.col("rows"), F.lit(0)) == 0, F.lit("no rows")).otherwise(F.lit("ok")))
    return j.select("url", F.coalesce(F.col("rows"), F.lit(0)).alias("rows"), verdict.alias("verdict"))


def link_documents(links: DataFrame, title_col: str = "text", href_col: str = "href") -> DataFrame:
    """P9 (+F21, F20, F17): links pointing into '/files/' with a non-empty cleaned title."""
    from doccat.functions.text import clean_title
    from doccat.functions.urls import path_format, reference_number
    t = clean_title(F.col(title_col))
    return (links.withColumn("title", t)
            .filter(F.col(href_col).contains("/files/") & (F.col("title") != ""))
            .withColumn("reference_number", reference_number(F.col(href_col)))
            .withColumn("document_format", path_format(F.col(href_col))))
