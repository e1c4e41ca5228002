"""M1: documents -> catalog adapter -> status / topic / ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccat.functions.ids import content_hash, stable_id
from doccat.plans import sql as S
from doccat.plans.registry import register
from doccat.sources.adapter import catalog_from_documents
from doccat.sources.tables import table


def catalog(spark, sf_dir):
    return catalog_from_documents(table(spark, sf_dir, "documents"))


@register("status_by_agency", lambda: S.with_catalog(
    "SELECT agency, status_normalized, sub_status, count(*) AS n FROM catalog GROUP BY ALL"))
def status_by_agency(spark, sf_dir):
    """Status distribution per agency (sub status kept apart)."""
    return catalog(spark, sf_dir).groupBy("agency", "status_normalized", "sub_status").agg(F.count(F.lit(1)).alias("n"))


@register("topic_by_agency", lambda: S.with_catalog(
    "SELECT agency, topic_normalized, count(*) AS n FROM catalog GROUP BY ALL"))
def topic_by_agency(spark, sf_dir):
    """J8 / F13 topic classification counted per agency."""
    return catalog(spark, sf_dir).groupBy("agency", "topic_normalized").agg(F.count(F.lit(1)).alias("n"))


@register("stable_ids", lambda: S.with_catalog(
    f"""SELECT doc_id, {S.stable_id('agency', 'title', 'source_page_url', 'document_url')} AS id,
    {S.content_hash()} AS content_hash FROM catalog"""))
def stable_ids(spark, sf_dir):
    """F15 + F16 for every catalog row."""
    c = catalog(spark, sf_dir)
    return c.select(
        "doc_id",
        stable_id(F.col("agency"), F.col("title"), F.col("source_page_url"), F.col("document_url")).alias("id"),
        content_hash().alias("content_hash"),
    )


@register("catalog_rows", lambda: S.with_catalog("SELECT * FROM catalog"))
def catalog_rows(spark, sf_dir):
    """The whole adapted catalog (every column of SURVEY 1.2 that the adapter fills)."""
    return catalog(spark, sf_dir)


def benchmark_rules(spark, sf_dir):
    """Rule table from ``benchmark``: every word of 4 letters or more of each item, priority = item id."""
    from doccat.sources.tables import table
    b = table(spark, sf_dir, "benchmark")
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-zß-ÿ]{4,})"), F.lit(1))))
    return b.select(F.col("item_id").alias("priority"), F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("topic"),
                    words.alias("keyword"))


_RULE_SQL = """WITH r AS (SELECT item_id AS priority, 'item_' || CAST(item_id AS VARCHAR) AS topic,
    unnest(list_distinct(regexp_extract_all(lower(text), '([a-zß-ÿ]{4,})', 1))) AS keyword FROM benchmark),
k AS (SELECT keyword, min(priority) AS priority, arg_min(topic, priority) AS topic FROM r GROUP BY keyword),
hits AS (SELECT d.doc_id, arg_min(k.topic, k.priority) AS topic FROM documents d JOIN k ON contains(lower(d.text), k.keyword)
         GROUP BY d.doc_id)
SELECT d.doc_id, coalesce(h.topic, 'other') AS topic FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id"""


@register("rule_table_topics", _RULE_SQL)
def rule_table_topics(spark, sf_dir):
    """J8 with a data-driven rule table over whole document texts."""
    from doccat.functions.classify import classify_with_rules
    from doccat.sources.tables import table
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_with_rules(d, benchmark_rules(spark, sf_dir), "text").select("doc_id", "topic")


@register("rule_table_topics_join", _RULE_SQL)
def rule_table_topics_join(spark, sf_dir):
    """J8 with the same rules joined on their rarest 3-gram, as tables too large for a CASE are."""
    from doccat.functions.classify import classify_by_grams
    from doccat.sources.tables import table
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify_by_grams(d, benchmark_rules(spark, sf_dir), "text").select("doc_id", "topic")
