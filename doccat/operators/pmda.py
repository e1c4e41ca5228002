"""Sectioned link pages -> catalog rows.

A source page lists document links under h2/h3/h4 headings.  Each configured
source (url, product_area, allowed_sections, required_parent) keeps the links
under the 'Regulations and Notifications' h2, below its required h3 and inside
its allowed h4 sections.  Link metadata (H9) is the rest of the link's list
item when it holds a date, else the paragraph right after the link's list.
Everything runs on the element table with windows partitioned by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doccat.functions.classify import pmda_adjust, with_status, with_topic
from doccat.functions.dates import MONTH_DAY_YEAR_IN_TEXT, parse_date
from doccat.functions.text import clean_text, clean_title
from doccat.functions.urls import absolute_url, path_format, reference_number
from doccat.operators.dedupe import keep_first, url_or_page_title_key
from doccat.operators.html import carry_forward, element_table, heading_events

# FIXED VALUES
BASE_URL = "https://www.pmda.go.jp"
SECTION_H2 = "Regulations and Notifications"
LEVELS = ["h2", "h3", "h4"]


def _inside(e: DataFrame, tags: list[str], name: str) -> DataFrame:
    """Add ``name`` = position of the enclosing open tag among ``tags`` (null when outside)."""
    w = Window.partitionBy("page_id").orderBy("pos")
    b = F.when(F.col("tag").isin(tags) & F.col("kind").isin("open", "close"),
               F.struct(F.col("pos").alias("p"), F.col("kind").alias("k"), F.col("tag").alias("t")))
    last = F.last(b, ignorenulls=True).over(w)
    return e.withColumn(name, F.when(last["k"] == "open", last["p"]))


def _texts(e: DataFrame, key: str) -> DataFrame:
    """(page_id, key position, cleaned text of the text tokens under it)."""
    t = e.filter((F.col("kind") == "text") & F.col(key).isNotNull()).groupBy("page_id", F.col(key).alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_t"))
    return t.select("page_id", "k", clean_text(F.array_join(F.transform("_t", lambda x: x["text"]), " ")).alias("txt"))


def link_metadata(elements: DataFrame) -> DataFrame:
    """H9: per link (page_id, pos): link text and its metadata text ('' when none)."""
    e = elements
    e = _inside(e, ["a"], "_in_a")
    e = _inside(e, ["li", "ul"], "_in_li")
    e = _inside(e, ["p"], "_in_p")
    w = Window.partitionBy("page_id").orderBy("pos")
    # Lists open at each position (a stray closing tag opens and closes nothing); a link and the closing tag
    # of its innermost list share their level, and no other list of that level closes between them.
    is_ul = (F.col("tag") == "ul") & F.col("kind").isin("open", "close")
    e = e.withColumn("_run", F.sum(F.when(is_ul, F.when(F.col("kind") == "open", 1).otherwise(-1)).otherwise(0)).over(w))
    e = e.withColumn("_depth", F.col("_run") - F.least(F.lit(0), F.min("_run").over(w)))
    ends = is_ul & (F.col("kind") == "close")
    e = e.withColumn("_level", F.col("_depth") + F.when(ends, 1).otherwise(0))
    fw = Window.partitionBy("page_id", "_level").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    e = e.withColumn("_ul", F.when(F.col("_depth") > 0, F.col("_depth")))
    e = e.withColumn("_ul_end", F.when(F.col("_ul").isNotNull(), F.first(F.when(ends, F.col("pos")), True).over(fw)))
    # the first tag token after each position (for the sibling that follows a list)
    tags = e.filter(F.col("kind") != "text").select(
        "page_id", "pos", F.lead(F.struct("kind", "tag", "pos")).over(w).alias("_next"))
    link_text = _texts(e, "_in_a")
    li_text = _texts(e, "_in_li")
    p_text = _texts(e, "_in_p")
    links = e.filter((F.col("kind") == "open") & (F.col("tag") == "a")).select(
        "page_id", "pos", "href", "_in_li", "_ul", "_ul_end")
    links = links.join(link_text.withColumnRenamed("k", "pos").withColumnRenamed("txt", "link_text"), ["page_id", "pos"], "left")
    links = links.join(li_text.select("page_id", F.col("k").alias("_in_li"), F.col("txt").alias("li_text")),
                       ["page_id", "_in_li"], "left")
    nxt = tags.select("page_id", F.col("pos").alias("_ul_end"), "_next")
    links = links.join(nxt, ["page_id", "_ul_end"], "left")
    pt = p_text.select(F.col("page_id").alias("_pp"), F.col("k").alias("_p"), F.col("txt").alias("p_text"))
    links = links.join(pt, (F.col("page_id") == F.col("_pp")) & (F.col("_next.pos") == F.col("_p")), "left").drop("_pp", "_p")
    lt = F.coalesce(F.col("link_text"), F.lit(""))
    li = F.coalesce(F.col("li_text"), F.lit(""))
    remaining = F.when(li.startswith(lt), F.trim(F.substring(li, F.length(lt) + 1, 1 << 30))).otherwise(li)
    sibling_p = F.when((F.col("_next.kind") == "open") & (F.col("_next.tag") == "p"), F.coalesce(F.col("p_text"), F.lit("")))
    meta = (F.when(F.col("_in_li").isNotNull() & remaining.rlike(MONTH_DAY_YEAR_IN_TEXT), remaining)
            .when(F.col("_ul").isNotNull(), F.coalesce(sibling_p, F.lit("")))
            .otherwise(F.lit("")))
    return links.select("page_id", "pos", "href", lt.alias("link_text"), meta.alias("metadata"))


def pmda_documents(pages: DataFrame, sources: DataFrame, strict: bool = True) -> DataFrame:
    """S9 + W1 + J9 + H9 + P9: documents of every configured source page (URL-deduped, source order kept).

    ``pages`` (url, html); ``sources`` (src_ord, url, product_area, allowed_sections, required_parent) is a
    small configuration table (broadcast after a size check).  Where several pages have one URL, ``pages``
    also carries the ``src_ord`` of the source that each was landed for, and a source reads its own page
    alone.  With ``strict`` a missing page or a page without in-scope rows raises, as the source does.
    """
    own = ["url", "src_ord"] if "src_ord" in pages.columns else ["url"]
    n = sources.count()
    small = n <= 100_000  # broadcast only a configuration of checked size; shuffle join beyond it
    src = F.broadcast(sources) if small else sources
    pg = pages.join(src, own).withColumn("page_id", F.col("src_ord"))
    main = F.regexp_extract(F.col("html"), r"(?is)(<main[\s>].*?</main\s*>)", 1)
    pg = pg.withColumn("html", main)
    el = element_table(pg.select("page_id", "html"))
    heads = carry_forward(heading_events(el, "page_id", LEVELS, "a"), "page_id", LEVELS, "a")
    meta = link_metadata(el).drop("href")
    cfg = sources.withColumnRenamed("src_ord", "page_id")
    x = heads.join(meta, ["page_id", "pos"]).join(F.broadcast(cfg) if small else cfg, "page_id")
    x = x.filter((F.col("h2_text") == SECTION_H2)
                 & (F.col("required_parent").isNull() | (F.col("h3_text") == F.col("required_parent")))
                 & (F.col("allowed_sections").isNull() | F.array_contains(F.col("allowed_sections"), F.col("h4_text"))))
    href = clean_text(F.col("href"))
    title = clean_title(F.col("link_text"))
    x = x.select("page_id", "pos", "url", "product_area", "h4_text", "metadata", href.alias("href"), title.alias("title"))
    x = x.filter((F.col("href") != "") & F.col("href").contains("/files/") & (F.col("title") != ""))
    doc_url = absolute_url(F.col("href"), BASE_URL)
    date_txt = F.regexp_extract(F.col("metadata"), MONTH_DAY_YEAR_IN_TEXT, 1)
    rest = F.substring(F.col("metadata"), F.position(date_txt, F.col("metadata")) + F.length(date_txt), 1 << 30)
    status_raw = F.when(date_txt != "", F.regexp_replace(rest, r"^[ -]+|[ -]+$", "")).otherwise(
        F.when(F.col("metadata") != "", F.col("metadata")))
    topic_raw = F.when(F.col("h4_text") != "", F.concat_ws(" / ", F.col("product_area"), F.col("h4_text"))).otherwise(
        F.col("product_area"))
    d = x.select("page_id", "pos", "title", F.lit("PMDA").alias("agency"), F.lit("Japan").alias("jurisdiction"),
                 F.col("url").alias("source_page_url"), doc_url.alias("document_url"),
                 path_format(doc_url).alias("document_format"), parse_date(date_txt).alias("published_date"),
                 status_raw.alias("status_raw"), topic_raw.alias("topic_raw"), "product_area",
                 F.lit("Not available.").alias("summary"), F.lit("EN").alias("language"),
                 reference_number(doc_url).alias("reference_number"))
    d = with_status(d, "title", "status_raw", "agency", F.lit(None).cast("date"), "1970-01-01", pmda=True)
    d = with_topic(d, "title", "topic_raw", F.lit(None).cast("string"))
    d = d.withColumn("needs_manual_review", F.col("published_date").isNull())
    key = url_or_page_title_key(F.col("document_url"), F.col("source_page_url"), F.col("title"))
    d = keep_first(d.withColumn("ord", F.struct("page_id", "pos")), key).drop("ord")
    if strict:
        audit = (sources.select("url", "src_ord").join(pages.select(*own).distinct().withColumn("_p", F.lit(1)), own, "left")
                 .join(d.groupBy(F.col("page_id").alias("src_ord")).agg(F.count(F.lit(1)).alias("_n")), "src_ord", "left"))
        bad = audit.filter(F.col("_p").isNull() | F.col("_n").isNull()).select("url", "_p").collect()  # at most one row per source
        if bad:
            reason = "missing required source page" if bad[0]["_p"] is None else "returned no in-scope documents"
            raise ValueError(f"{reason}: {bad[0]['url']}")
    return d
