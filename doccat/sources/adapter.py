"""Catalog adapter: ``documents`` -> catalog-shaped rows (deterministic, SURVEY 7.2).

The driver tables hold no guidance records, so this adapter derives every
catalog column from ``documents`` by fixed rules; the DuckDB oracle uses the
very same rules.  It is a pure projection: no shuffle, one pass, codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.functions.classify import with_status, with_topic
from doccat.functions.rules import AGENCIES, JURISDICTION, NOT_AVAILABLE
from doccat.functions.text import clean_text
from doccat.functions.urls import document_format, reference_number

# FIXED VALUES of the adapter (title phrases: one per topic rule in order, then two that hit none).
PHRASES = [
    "Estimand", "Adaptive design", "Bayesian", "Platform trial", "External control", "Real-world",
    "Vaccine", "Immunogenicity", "Pharmacovigilance", "Pediatric", "Rare disease", "Oncology",
    "Bioequivalence", "Pharmacokinetic", "Manufacturing", "Toxicology", "SDTM", "Implementation",
    "Submission", "Statistics", "Clinical trial", "Contacts", "Fees",
]
# Raw status texts: reach every agency block, and null.
RAW_STATUSES = [
    None, "Draft", "Final", "Adopted", "Consultation open", "Draft: consultation closed", "Step 2b",
    "Step 3", "Step 4", "Step 5", "公开征求意见", "试行", "颁布", "Notification", "Superseded",
    "Withdrawn", "Administrative notice",
]
AS_OF_DATE = "2024-06-01"
RUN_TS_V1 = "2024-06-01 00:00:00"
RUN_TS_V2 = "2024-06-08 00:00:00"


def pick(values: list, key: Column) -> Column:
    """``values[key]`` for a non-negative integer key (constant array, folded by Catalyst)."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (key + F.lit(1)).cast("int"))


def jurisdiction(agency: Column) -> Column:
    expr = None
    for a, j in JURISDICTION.items():
        expr = F.when(agency == a, F.lit(j)) if expr is None else expr.when(agency == a, F.lit(j))
    return expr


def catalog_from_documents(documents: DataFrame, as_of: str = AS_OF_DATE) -> DataFrame:
    """Catalog rows, one per document."""
    d = F.col("doc_id")
    text = clean_text("text")  # once: the phrases hold no whitespace runs, so cleaning the title again would change nothing
    base = documents.select(
        d.alias("ord"),
        d,
        pick(AGENCIES, d % 5).alias("agency"),
        pick(PHRASES, d % 23).alias("_phrase"),
        text.alias("_text"),
        pick(RAW_STATUSES, d % 17).alias("status_raw"),
        F.col("source").alias("topic_raw"),
        F.upper(F.col("lang")).alias("language"),
        F.when(d % 13 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (d % 2400).cast("int"))).alias("published_date"),
        F.when(d % 3 == 0, F.date_add(F.lit("2024-01-01").cast("date"), (d % 400).cast("int"))).alias("comment_end_date"),
        F.concat(F.lit("https://example.org/"), F.coalesce(F.col("source"), F.lit("")), F.lit("/"),
                 (d % 700).cast("string")).alias("source_page_url"),
        (F.when(d % 4 == 1, F.concat(F.lit("https://example.org/files/"), d.cast("string"), F.lit(".pdf")))
         .when(d % 4 == 2, F.concat(F.lit("https://example.org/files/"), d.cast("string"), F.lit(".docx")))
         .when(d % 4 == 3, F.concat(F.lit("https://example.org/media/"), d.cast("string"), F.lit("/download")))
         ).alias("document_url"),
    ).withColumns({
        "title": F.coalesce(F.trim(F.concat("_phrase", F.lit(" "), "_text")), F.lit("")),
        "summary": F.when(F.col("_text") != "", F.col("_text")).otherwise(F.lit(NOT_AVAILABLE)),
    })
    staged = with_status(base, "title", "status_raw", "agency", "comment_end_date", as_of, pmda=True)
    staged = with_topic(staged, "title", "topic_raw", "summary")
    return staged.select(
        "ord", "doc_id", "title", "agency",
        jurisdiction(F.col("agency")).alias("jurisdiction"),
        "source_page_url", "document_url",
        document_format(F.col("document_url")).alias("document_format"),
        "published_date",
        F.lit(None).cast("date").alias("updated_date"),
        F.lit(None).cast("date").alias("comment_start_date"),
        "comment_end_date", "status_raw", "status_normalized", "sub_status", "topic_raw", "topic_normalized",
        F.lit(None).cast("string").alias("product_area"),
        "summary", "language",
        F.when(F.col("document_url").isNotNull(), reference_number(F.col("document_url"))).alias("reference_number"),
        ((F.col("agency") == "PMDA") & F.col("published_date").isNull()).alias("needs_manual_review"),
    )
