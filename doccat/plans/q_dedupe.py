"""M4: keep-first dedupe, overlapping lists, agency union and seed fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from doccat.functions.rules import AGENCIES
from doccat.functions.text import clean_text
from doccat.operators import dedupe as DD
from doccat.operators.audit import overlap_report
from doccat.plans import sql as S
from doccat.plans.q_catalog import catalog
from doccat.plans.registry import register
from doccat.sources.adapter import AS_OF_DATE, PHRASES, pick
from doccat.sources.seed import SEED_ROWS, seed_documents
from doccat.sources.tables import table




@register("dedupe_keep_first", lambda: S.with_catalog(f"""SELECT * FROM (WITH x AS (SELECT ord, doc_id,
  CASE WHEN doc_id % 4 IN (1, 2) THEN 'https://example.org/files/' || CAST(doc_id % 300 AS VARCHAR) || '.PDF' END AS document_url,
  'https://example.org/' || coalesce(topic_raw, '') AS source_page_url,
  {S.lst(PHRASES)}[doc_id % 23 + 1] AS title FROM catalog)
SELECT doc_id, title, document_url FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(coalesce(nullif(document_url, ''),
    concat_ws('|', coalesce(source_page_url, 'None'), coalesce(title, 'None')))) ORDER BY ord) AS rn FROM x) y
WHERE rn = 1)"""))
def dedupe_keep_first(spark, sf_dir):
    """Keep the first row per lower(document URL), else per lower('page|title').

    URLs and page/title pairs are drawn from small pools so most rows collide.
    """
    c = catalog(spark, sf_dir)
    k = F.col("doc_id")
    x = c.select("ord", "doc_id",
                 F.when((k % 4 == 1) | (k % 4 == 2), F.concat(F.lit("https://example.org/files/"),
                                                               (k % 300).cast("string"), F.lit(".PDF"))).alias("document_url"),
                 F.concat(F.lit("https://example.org/"), F.coalesce("topic_raw", F.lit(""))).alias("source_page_url"),
                 pick(PHRASES, k % 23).alias("title"))
    key = DD.url_or_page_title_key(F.col("document_url"), F.col("source_page_url"), F.col("title"))
    return DD.keep_first(x, key).select("doc_id", "title", "document_url")


def _items(spark, sf_dir):
    """List items with ids in two spellings and a title; some have none (they collapse to one)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    return d.select(
        k.alias("ord"), k.alias("doc_id"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Z"), (k % 300).cast("string"))).alias("zdyzIdCODE"),
        F.when(k % 7 == 0, F.concat(F.lit("I"), (k % 50).cast("string"))).alias("idCODE"),
        F.when(k % 11 == 0, F.lit(" ")).otherwise(F.col("text")).alias("title"))


_SQL_ITEMS = """items AS (SELECT doc_id AS ord, doc_id,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Z' || CAST(doc_id % 300 AS VARCHAR) END AS zdyzIdCODE,
  CASE WHEN doc_id % 7 = 0 THEN 'I' || CAST(doc_id % 50 AS VARCHAR) END AS idCODE,
  CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS title FROM documents)"""


def _sql_item_key() -> str:
    parts = [f"nullif({S.clean(c)}, '')" for c in ("zdyzIdCODE", "idCODE", "title")]
    return f"coalesce({', '.join(parts)}, '')"


def _item_key():
    return DD.first_id_or_title_key([F.col("zdyzIdCODE"), F.col("idCODE")], [F.col("title")])


@register("dedupe_items", lambda: f"""WITH {_SQL_ITEMS}
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_sql_item_key()} ORDER BY ord) AS rn FROM items) x WHERE rn = 1""")
def dedupe_items(spark, sf_dir):
    """Keep the first item per first non-empty id, else title; keyless items collapse to one."""
    return DD.keep_first(_items(spark, sf_dir), _item_key()).select("doc_id")


@register("overlap_union", lambda: f"""WITH {_SQL_ITEMS},
a AS (SELECT DISTINCT {_sql_item_key()} AS key FROM items WHERE doc_id % 3 <> 0),
b AS (SELECT DISTINCT {_sql_item_key()} AS key FROM items WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT (SELECT count(*) FROM a) AS list_a, (SELECT count(*) FROM b) AS list_b,
  (SELECT count(*) FROM a JOIN b USING (key)) AS overlap,
  (SELECT count(*) FROM (SELECT key FROM a UNION SELECT key FROM b)) AS unique_keys""")
def overlap_union(spark, sf_dir):
    """Two overlapping lists (together every item): sizes, overlap and unique keys after the union."""
    it = _items(spark, sf_dir).withColumn("key", _item_key())
    return overlap_report(it.filter(F.col("doc_id") % 3 != 0), it.filter((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 0)))


#: The page that the PMDA frame is read from.
@register("union_agencies", lambda: S.with_catalog(
    "SELECT agency, count(*) AS n_rows, 'ok' AS status FROM catalog WHERE agency <> 'PMDA' GROUP BY ALL "
    "UNION ALL SELECT 'PMDA', 0, 'failed: missing required source page: https://missing.example.org/config'"))
def union_agencies(spark, sf_dir):
    """Per-agency frames unioned; one failing agency is reported, not fatal.

    PMDA reads its configured source pages (S9); one of them has not landed, so its reader raises, and the
    union goes on without it.
    """
    from doccat.plans.q_html import pmda_inputs
    from doccat.operators.pmda import pmda_documents

    c = catalog(spark, sf_dir)

    def pmda():
        landed, sources = pmda_inputs(spark, sf_dir)
        lost = spark.createDataFrame([(-1, "https://missing.example.org/config", "Area", None, None)], sources.schema)
        return pmda_documents(landed, sources.unionByName(lost)).select("agency")

    readers = {a: (lambda a=a: c.filter(F.col("agency") == a).select("agency")) for a in AGENCIES} | {"PMDA": pmda}
    frames, status = [], []
    for a in AGENCIES:
        try:
            frames.append(readers[a]())
            status.append((a, "ok"))
        except ValueError as exc:
            status.append((a, f"failed: {exc}"))
    u = DD.union_all(frames)
    st = spark.createDataFrame(status, ["agency", "status"])
    counts = u.groupBy("agency").agg(F.count(F.lit(1)).alias("n_rows"))
    return st.join(counts, "agency", "left").select("agency", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "status")


def _sql_seeds() -> str:
    from doccat.sources.seed import SEED_COLUMNS
    vals = ", ".join("(" + ", ".join([str(i)] + [S.q(v) for v in r]) + ")" for i, r in enumerate(SEED_ROWS))
    return f"seeds AS (SELECT * FROM (VALUES {vals}) v(ord, {', '.join(SEED_COLUMNS)}))"


@register("seed_fallback", lambda: f"""WITH catalog AS ({S.catalog_cte()}), {_sql_seeds()},
crawled AS (SELECT agency, title FROM catalog WHERE agency NOT IN ('CDE', 'PMDA')),
missing AS (SELECT a AS agency FROM (VALUES ('FDA'), ('EMA'), ('ICH'), ('CDE'), ('PMDA')) r(a)
            WHERE a NOT IN (SELECT DISTINCT upper(agency) FROM crawled))
SELECT agency, count(*) AS n, count(*) FILTER (WHERE needs_review) AS seeded FROM (
  SELECT agency, false AS needs_review FROM crawled
  UNION ALL SELECT agency, true FROM seeds WHERE upper(agency) IN (SELECT agency FROM missing)) u GROUP BY ALL""")
def seed_fallback(spark, sf_dir):
    """J4 + S12: agencies asked for but not crawled get the demo rows (PMDA has none)."""
    crawled = catalog(spark, sf_dir).filter(~F.col("agency").isin("CDE", "PMDA")).withColumn(
        "needs_manual_review", F.lit(False))
    seeds = seed_documents(spark, None, AS_OF_DATE)
    requested = spark.createDataFrame([(a,) for a in AGENCIES], ["agency"])
    out = DD.seed_fallback(crawled.select("agency", "title", "needs_manual_review"),
                           seeds.select("agency", "title", "needs_manual_review"), requested)
    return out.groupBy("agency").agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_manual_review").alias("seeded"))


@register("seed_documents", lambda: f"""WITH {_sql_seeds()}, x AS (
  SELECT *, {S.date_chain(S.clean('published_date'), S.CATALOG_CHAIN)} AS pd,
    {S.date_chain(S.clean('comment_end_date'), S.CATALOG_CHAIN)} AS ed FROM seeds WHERE agency IN ('ICH', 'CDE'))
SELECT title, agency, pd AS published_date, ed AS comment_end_date,
  {S.status_of(S.status_index('title', 'status_raw', 'agency', 'ed'))} AS status_normalized,
  {S.sub_status_of(S.status_index('title', 'status_raw', 'agency', 'ed'))} AS sub_status,
  {S.topic('title', 'topic_raw', 'summary')} AS topic_normalized, coalesce(language, 'EN') AS language FROM x""")
def seed_documents_query(spark, sf_dir):
    """Demo rows for the agency set {ich, cde} (set is case-insensitive; empty = all)."""
    s = seed_documents(spark, ["ich", "cde"], AS_OF_DATE)
    return s.select("title", "agency", "published_date", "comment_end_date", "status_normalized", "sub_status",
                    "topic_normalized", "language")
