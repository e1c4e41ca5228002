"""Search, facets, metrics and limits over the catalog.

All filters are plain Column predicates so Catalyst pushes what it can into
the parquet scan; all metrics are single-pass partial aggregations.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.functions.classify import with_status, with_topic
from doccat.functions.dates import parse_date
from doccat.functions.rules import (
    CDE_ALLOWED_PRODUCT_AREAS,
    HIGH_PRIORITY_TOPICS,
    NOT_AVAILABLE,
    REPORT_COLUMNS,
    REPORT_FALLBACKS,
    WHY_IT_MATTERS,
    WHY_IT_MATTERS_DEFAULT,
)
from doccat.functions.text import clean_text, search_corpus


def facet_filter(df: DataFrame, selections: dict[str, list[str]]) -> DataFrame:
    """Conjunction of multi-value IN filters; an empty selection means no filter."""
    for col, values in selections.items():
        if values:
            df = df.filter(F.col(col).isin(list(values)))
    return df


def text_filter(df: DataFrame, cols: list[str], query: str) -> DataFrame:
    """P5: literal, case-folded substring over ' c1 c2 ...' (null -> ''); empty query = no filter."""
    if not query:
        return df
    return df.filter(search_corpus(cols).contains(query.lower()))


def date_range_keep_null(df: DataFrame, col: str, start: str | _dt.date, end: str | _dt.date) -> DataFrame:
    """Keep rows whose date is null or inside [start, end]."""
    c = F.col(col)
    return df.filter(c.isNull() | c.between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


def dashboard_filter(rows: DataFrame, query: str = "", authority: str = "", organization: str = "",
                     topic: str = "", status: str = "", comments: str = "") -> DataFrame:
    """The report page's filters over report rows (REPORT_COLUMNS names)."""
    q = query.strip().lower()
    if q:
        corpus = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in
                                            ["Health Authority", "Guidance Name", "Summary",
                                             "Organization / Committee", "Topic", "Guidance Status"]]))
        rows = rows.filter(corpus.contains(q))
    for col, val in (("Health Authority", authority), ("Organization / Committee", organization),
                     ("Topic", topic), ("Guidance Status", status)):
        if val:
            rows = rows.filter(F.col(f"`{col}`") == F.lit(val))
    if comments == "Open":
        rows = rows.filter(F.col("`Open for Comment`") == "Yes")
    elif comments == "Closed":
        rows = rows.filter(~(F.col("`Open for Comment`") == "Yes") | F.col("`Open for Comment`").isNull())
    return rows


def required_fields(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``reject_reason`` (null when kept): the first required field that is empty after F1."""
    reason = None
    for c in cols:
        cond = clean_text(F.col(c)) == ""
        reason = F.when(cond, F.lit(f"missing {c}")) if reason is None else reason.when(cond, F.lit(f"missing {c}"))
    return df.withColumn("reject_reason", reason)


def scientific_guideline(title: Column, url: Column) -> Column:
    """Title mentions 'scientific guideline' or URL ends with '-scientific-guideline'."""
    return (F.lower(clean_text(title)).contains("scientific guideline")
            | F.lower(clean_text(url)).endswith("-scientific-guideline"))


def product_area_allowed(area: Column) -> Column:
    """Keep when the area is empty or holds one of the allowed product areas."""
    a = clean_text(area)
    return (a == "") | reduce(lambda x, y: x | y, [a.contains(v) for v in CDE_ALLOWED_PRODUCT_AREAS])


def metrics(df: DataFrame) -> DataFrame:
    """A1: total / final / draft / open-for-comment counters in one pass."""
    s = F.col("status_normalized")
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(s == "final").alias("final"),
                  F.count_if(s == "draft").alias("draft"),
                  F.count_if(s == "open_for_comment").alias("open_for_comment"))


def distinct_metrics(rows: DataFrame, exact: bool = True) -> DataFrame:
    """A3: records, authorities, open, topics over report rows ('' ignored).

    ``exact=False`` swaps the distinct counts for HyperLogLog estimates.
    """
    cd = F.count_distinct if exact else F.approx_count_distinct
    return rows.agg(F.count(F.lit(1)).alias("records"),
                    cd(F.nullif(F.col("`Health Authority`"), F.lit(""))).alias("authorities"),
                    F.count_if(F.col("`Open for Comment`") == "Yes").alias("open"),
                    cd(F.nullif(F.col("`Topic`"), F.lit(""))).alias("topics"))


def facet_options(df: DataFrame, facets: list[str]) -> DataFrame:
    """A4: (facet, value, n) for every non-empty value of every facet, in one scan."""
    args = []
    for f in facets:
        args += [F.lit(f), F.col(f).cast("string")]
    st = df.select(F.stack(F.lit(len(facets)), *args).alias("facet", "value"))
    return (st.filter(F.col("value").isNotNull() & (F.col("value") != ""))
            .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")))


def date_bounds(df: DataFrame, col: str) -> DataFrame:
    """A5: min and max of the non-null dates."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def report_counters(df: DataFrame) -> DataFrame:
    """Total / new / updated / open / high-priority in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col("change_type") == "new").alias("new"),
                  F.count_if(F.col("change_type") == "updated").alias("updated"),
                  F.count_if(F.col("status_normalized") == "open_for_comment").alias("open"),
                  F.count_if(F.col("topic_normalized").isin(HIGH_PRIORITY_TOPICS)).alias("high_priority"))


def parse_stamp(c: Column) -> Column:
    """ISO stamp text (or timestamp) -> timestamp; unparseable -> null."""
    return F.try_to_timestamp(F.replace(clean_text(c.cast("string")), F.lit("Z"), F.lit("+00:00")))


def refresh_status(df: DataFrame, key: str = "agency", stamp: str = "last_seen_at") -> DataFrame:
    """A2: per key (nulls dropped) the row count and latest parseable stamp, 'yyyy-MM-dd HH:mm UTC'."""
    g = (df.filter(F.col(key).isNotNull())
         .groupBy(F.col(key).alias("agency"))
         .agg(F.count(F.lit(1)).alias("records"), F.max(parse_stamp(F.col(stamp))).alias("_last")))
    text = F.coalesce(F.concat(F.date_format("_last", "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit(NOT_AVAILABLE))
    return g.select("agency", "records", text.alias("last_crawled_utc"))


def refresh_status_text(status: DataFrame) -> DataFrame:
    """A2 caption: 'Last crawled by agency: A t | B t' ordered by agency (one row per agency in)."""
    parts = F.sort_array(F.collect_list(F.struct("agency", F.concat_ws(" ", "agency", "last_crawled_utc").alias("t"))))
    return status.agg(F.concat(F.lit("Last crawled by agency: "),
                               F.array_join(F.transform(parts, lambda x: x["t"]), " | ")).alias("caption"))


def newest_first(records: DataFrame, n: int, date_col: str = "issue_date", ord_col: str = "ord") -> DataFrame:
    """L1: newest first by the date *text*, blanks last, ties in feed order, then the first ``n``.

    Planned as TakeOrderedAndProject: each task keeps its own top n, so the
    cost is one scan plus n x tasks rows to the final merge.
    """
    return records.orderBy(F.coalesce(F.col(date_col), F.lit("")).desc(), F.col(ord_col).asc()).limit(n)


def first_n(df: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    """L2: first ``n`` rows in feed order."""
    return df.orderBy(F.col(ord_col).asc()).limit(n)


def _fixed_table(spark: SparkSession, rows: list[tuple], cols: list[str]) -> DataFrame:
    return spark.createDataFrame(rows, cols)


def high_priority(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """J6 + J7: high-priority rows (broadcast semi join on a fixed 11-row topic table) with rationale.

    Both side tables are fixed literal lists, so their broadcast size is bounded
    by construction, whatever the catalog size.
    """
    topics = _fixed_table(spark, [(t,) for t in HIGH_PRIORITY_TOPICS], ["topic_normalized"])
    why = _fixed_table(spark, list(WHY_IT_MATTERS.items()), ["topic_normalized", "why"])
    hp = catalog.join(F.broadcast(topics), "topic_normalized", "left_semi")
    return (hp.join(F.broadcast(why), "topic_normalized", "left")
            .withColumn("why", F.coalesce(F.col("why"), F.lit(WHY_IT_MATTERS_DEFAULT))))


def report_rows(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """REPORT_COLUMNS with header aliases: own value, else the first non-empty fallback, else ''.

    ``keep`` names extra columns (such as ``ord``) carried through unchanged.
    """
    have = set(records.columns)

    def val(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in have else F.lit("")

    cols = []
    for name in REPORT_COLUMNS:
        chain = [val(name)] + [val(f) for f in REPORT_FALLBACKS.get(name, [])]
        expr = chain[-1]
        for c in reversed(chain[:-1]):
            expr = F.when(c != "", c).otherwise(expr)
        cols.append(expr.alias(name))
    return records.select(*(keep or []), *cols)


def legacy_to_catalog(records: DataFrame, as_of: str) -> DataFrame:
    """Legacy record -> catalog row (format 'PDF' iff the PDF link is non-empty)."""
    pdf = F.col("guidance_pdf_link")
    end = parse_date(F.col("comment_closing_date_on_draft"))
    x = records.select(
        "ord",
        F.col("guidance_name").alias("title"),
        F.lit("FDA").alias("agency"),
        F.lit("US").alias("jurisdiction"),
        F.nullif(F.col("guidance_page_link"), F.lit("")).alias("source_page_url"),
        F.nullif(pdf, F.lit("")).alias("document_url"),
        F.when(F.coalesce(pdf, F.lit("")) != "", F.lit("PDF")).alias("document_format"),
        parse_date(F.col("issue_date")).alias("published_date"),
        end.alias("comment_end_date"),
        F.col("guidance_status").alias("status_raw"),
        F.col("topic").alias("topic_raw"),
        "summary",
        F.lit("EN").alias("language"),
        F.nullif(F.col("docket_number"), F.lit("")).alias("reference_number"),
        F.lit(False).alias("needs_manual_review"),
    )
    x = with_status(x, "title", "status_raw", "agency", "comment_end_date", as_of)
    return with_topic(x, "title", "topic_raw", "summary")
