"""HTML extraction as table jobs.

Each page is one row, so per-page extractors are array expressions over that
row (``split``, ``regexp_extract_all``, ``filter``, ``transform``): no shuffle,
no Python.  Only the element table (H1) and the heading carry-forward (W1)
need windows, partitioned by page.

Rules for malformed markup (stated once, mirrored by the oracle):
* script, style and comments are removed first (so '</p>' inside a script string
  is not markup);
* a paragraph starts at ``<p>`` / ``<p ...>`` and ends at the next ``<p``,
  ``</p>`` or ``</article>``; tags inside become blanks, common entities are
  decoded and whitespace collapsed (F2);
* elements nest as ``html_tree`` says; containers (H5) are intervals of that tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccat.functions.rules import PROTECTION_PAGE_MARKERS
from doccat.functions.text import clean_text, fragment_text, plain_references, unescape_common
from doccat.functions.urls import ANCHOR, HREF_TAG, absolute_url_col, href_value
from doccat.operators.html_tree import attributes, element_tree, is_summary_candidate, let, page_summary, strip_noise, tag_code, tokens  # noqa: F401

P_OPEN = r"(?i)<p>|<p\s[^>]*>"
P_END = r"(?is)</(p|article)(\s[^>]*)?>.*$"


# ---------------------------------------------------------------- H1 element table


def with_stripped(df: DataFrame, html_col: str = "html", out: str = "_stripped") -> DataFrame:
    """Project the noise-free page once (referenced by several extractors afterwards)."""
    return df.withColumn(out, strip_noise(F.col(html_col)))


def element_table(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """H1: one row per token (tag or text run) in document order.

    Columns: page id, ``pos`` (0-based), ``kind`` open/close/text, ``tag``
    (lower case, '' for text), ``text`` (decoded, cleaned; '' for tags),
    ``href`` (anchors), ``cls`` and ``role`` attributes.
    """
    toks = pages.select(id_col, tokens(F.col("html")).alias("t")).select(id_col, F.posexplode("t").alias("pos", "tok"))
    rows = toks.select(id_col, F.col("pos").cast("bigint").alias("pos"), "tok", tag_code(F.col("tok")).alias("code"),
                       attributes(F.col("tok")).alias("attrs"))
    code, attr = F.col("code"), F.col("attrs")
    kind = F.when(code == "", F.lit("text")).when(code.startswith("/"), F.lit("close")).otherwise(F.lit("open"))
    return rows.select(
        id_col, "pos", kind.alias("kind"), F.when(code == "!", F.lit("")).otherwise(F.regexp_replace(code, "^/", "")).alias("tag"),
        F.when(code == "", clean_text(unescape_common(F.col("tok")))).otherwise(F.lit("")).alias("text"),
        *[F.coalesce(attr[a], F.lit("")).alias(out) for a, out in (("href", "href"), ("class", "cls"), ("role", "role"))])


# ---------------------------------------------------------------- paragraphs


def paragraphs(html: Column, stripped: bool = False) -> Column:
    """Array of paragraph texts in document order (empty ones kept as '')."""
    pieces = F.split(html if stripped else strip_noise(html), P_OPEN)
    body = F.slice(pieces, 2, 1 << 30)
    return F.transform(body, lambda p: fragment_text(F.regexp_replace(p, P_END, "")))


# ---------------------------------------------------------------- links


def links(html: Column, base: Column) -> Column:
    """H1/H3: array<struct<href, text>> of anchors with an href, href made absolute against ``base``."""
    h = strip_noise(html)
    hrefs = F.regexp_extract_all(h, F.lit(ANCHOR), 1)
    texts = F.regexp_extract_all(h, F.lit(ANCHOR), 2)
    return F.transform(F.arrays_zip(hrefs.alias("h"), texts.alias("t")),
                       lambda z: F.struct(absolute_url_col(href_value(z["h"]), base).alias("href"),
                                          fragment_text(z["t"]).alias("text")))


def first_pdf_link(html: Column, base: Column) -> Column:
    """H6: first link whose href holds '.pdf' and '/documents/' (absolute), else null."""
    hrefs = F.transform(F.regexp_extract_all(strip_noise(html), F.lit(HREF_TAG), 1), href_value)
    hit = F.filter(hrefs, lambda x: F.lower(x).contains(".pdf") & F.lower(x).contains("/documents/"))
    return let(F.try_element_at(hit, F.lit(1)), lambda first: F.when(first.isNotNull(), absolute_url_col(first, base)))


def first_attachment(html: Column, base: Column) -> Column:
    """H7: first anchor whose href holds 'downloadAtt' -> struct(url, format from url + link text)."""
    def attached(page: Column) -> Column:
        hrefs = F.transform(F.regexp_extract_all(page, F.lit(ANCHOR), 1), href_value)
        both = F.arrays_zip(hrefs.alias("h"), F.regexp_extract_all(page, F.lit(ANCHOR), 2).alias("t"))
        return F.try_element_at(F.filter(both, lambda x: x["h"].contains("downloadAtt")), F.lit(1))

    def described(url: Column, text: Column) -> Column:
        def document(probe: Column) -> Column:
            fmt = F.when(probe.endswith(".pdf"), F.lit("PDF")).when(probe.endswith(".doc") | probe.endswith(".docx"), F.lit("DOCX"))
            return F.struct(url.alias("url"), fmt.alias("format"))
        return let(F.lower(F.trim(F.concat_ws(" ", url, fragment_text(text)))), document)

    # every page, link and URL is bound once: each is read by many expressions
    first = let(strip_noise(html), attached)
    return let(first, lambda x: F.when(x.isNotNull(), let(absolute_url_col(x["h"], base), lambda url: described(url, x["t"]))))


def result_count(html: Column) -> Column:
    """H8: count from the active facet attribute, else the number in 'Search results (n)'; null if none."""
    html = plain_references(html)
    facet = F.regexp_extract(html, r"""(?is)<a\s[^>]*class\s*=\s*"[^"]*is-active[^"]*"[^>]*data-drupal-facet-item-count\s*=\s*"([^"]*)"[^>]*>""", 1)
    heading = F.regexp_extract(fragment_text(html), r"(?i)Search results\s*\(?\s*([0-9,]+)\s*\)?", 1)
    return F.coalesce(parse_int(F.when(facet != "", facet)), parse_int(F.when(heading != "", heading)))


def parse_int(c: Column) -> Column:
    """integer with thousands separators, else null."""
    t = F.trim(F.replace(c, F.lit(","), F.lit("")))
    return F.when(t.rlike(r"^[0-9]+$"), t.cast("long"))


def looks_like_protection_page(html: Column) -> Column:
    """P10: a protection marker anywhere in the page."""
    page = F.coalesce(html, F.lit(""))
    return reduce(lambda a, b: a | b, [page.contains(m) for m in PROTECTION_PAGE_MARKERS])


BLOCK_OPEN = r"""(?i)<[a-z0-9]+\s[^>]*class\s*=\s*"[^"]*paragraph--type--ema-documents[^"]*"[^>]*>"""
BLOCK_HEADING = r"(?is)<h[23][^>]*>(.*?)</h[23]\s*>"
META_OPEN = r"""(?is)class\s*=\s*"([^"]*\s)?file-metadata"[^>]*>(.*)$"""
ROW_OPEN = r"""(?i)<[a-z0-9]+\s[^>]*class\s*=\s*"([^"]*\s)?file-metadata-row(\s[^"]*)?"[^>]*>"""
LABEL_CLASS = r'class\s*=\s*"([^"]*\s)?label(\s[^"]*)?"'
VALUE_CLASS = r"""(?is)class\s*=\s*"([^"]*\s)?value(\s[^"]*)?"[^>]*>(.*?)</"""


def current_version_status(html: Column) -> Column:
    """The status in the 'Current version' document block, else null.

    Blocks start at an element with class ``paragraph--type--ema-documents``; the
    block whose first h2/h3 reads 'current version' is used; inside its
    ``file-metadata`` part the first row without a ``label`` gives its
    ``value`` text (or the whole row text).
    """
    h = strip_noise(html)
    blocks = F.slice(F.split(h, BLOCK_OPEN), 2, 1 << 30)
    heading = lambda b: F.lower(fragment_text(F.regexp_extract(b, BLOCK_HEADING, 1)))
    cur = F.try_element_at(F.filter(blocks, lambda b: heading(b) == "current version"), F.lit(1))
    meta = F.regexp_extract(cur, META_OPEN, 2)
    rows = F.slice(F.split(meta, ROW_OPEN), 2, 1 << 30)
    unlabeled = F.filter(rows, lambda r: ~F.lower(r).rlike(LABEL_CLASS))
    vals = F.transform(unlabeled, lambda r: F.coalesce(
        F.nullif(fragment_text(F.regexp_extract(r, VALUE_CLASS, 3)), F.lit("")), fragment_text(r)))
    return F.try_element_at(F.filter(vals, lambda v: v != ""), F.lit(1))


# ---------------------------------------------------------------- W1 heading carry-forward


def heading_events(elements: DataFrame, id_col: str, levels: list[str], target: str = "a") -> DataFrame:
    """Headings (with their text) and target elements of the element table, as (id, pos, tag, text, href).

    A heading's text is the text tokens after its opening tag up to the next
    heading boundary (open or close of any listed level).
    """
    w = Window.partitionBy(id_col).orderBy("pos")
    boundary = F.when(F.col("tag").isin(levels) & F.col("kind").isin("open", "close"),
                      F.struct(F.col("pos").alias("p"), F.col("kind").alias("k")))
    e = elements.withColumn("_b", F.last(boundary, ignorenulls=True).over(w))
    inside = (F.col("kind") == "text") & (F.col("_b.k") == "open")
    wanted = (F.col("kind") == "open") & (F.col("tag").isin(levels) | (F.col("tag") == target))
    # a stretch between two boundaries has its texts and its events in one group, so elements are made once
    parts = (e.filter(inside | wanted).groupBy(id_col, F.col("_b.p").alias("_p"))
             .agg(F.sort_array(F.collect_list(F.when(inside, F.struct("pos", "text")))).alias("_t"),
                  F.collect_list(F.when(wanted, F.struct("pos", "tag", "href"))).alias("_e")))
    text = clean_text(F.array_join(F.transform("_t", lambda x: x["text"]), " "))
    return (parts.select(id_col, "_p", text.alias("_text"), F.explode("_e").alias("_e"))
            .select(id_col, "_e.pos", "_e.tag", F.when(F.col(id_col).isNotNull() & (F.col("_e.pos") == F.col("_p")), F.col("_text"))
                    .otherwise(F.lit("")).alias("text"), "_e.href"))


def carry_forward(events: DataFrame, id_col: str, levels: list[str], target: str,
                  chunk_size: int = 1 << 20) -> DataFrame:
    """Each ``target`` row gets, per level, the latest heading text before it ('' when none).

    A heading resets all lower levels.  Level i's value is the last heading of
    level <= i before the row when that heading is of level i, else '' - a
    last-non-null scan, which is associative, so it is computed as a chunked
    segmented scan: windows run over (id, pos div chunk_size), so one hot page or
    conversation (say a third of all rows) is spread over many tasks; a tiny
    per-chunk summary then carries the state across the chunks of an id.
    """
    lv = None
    for i, name in enumerate(levels, start=1):
        lv = F.when(F.col("tag") == name, F.lit(i)) if lv is None else lv.when(F.col("tag") == name, F.lit(i))
    e = events.withColumn("_lv", lv).withColumn("_chunk", F.floor(F.col("pos") / F.lit(chunk_size)))
    w = Window.partitionBy(id_col, "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = len(levels)
    for i in range(1, m + 1):
        e = e.withColumn(f"_w{i}", F.last(F.when(F.col("_lv") <= i, F.struct(F.col("_lv").alias("l"), F.col("text").alias("t"))),
                                          ignorenulls=True).over(w))
    # every chunk gets a summary row (null when it holds no heading) so that every chunk gets its carry-in
    summary = e.groupBy(id_col, "_chunk").agg(*[
        F.max_by(F.when(F.col("_lv") <= i, F.struct(F.col("_lv").alias("l"), F.col("text").alias("t"))),
                 F.when(F.col("_lv") <= i, F.col("pos"))).alias(f"_s{i}") for i in range(1, m + 1)])
    wc = Window.partitionBy(id_col).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(id_col, "_chunk", *[F.last(f"_s{i}", ignorenulls=True).over(wc).alias(f"_c{i}")
                                               for i in range(1, m + 1)])
    rest = [c for c in events.columns if c not in (id_col, "pos", "tag")]
    out = e.filter(F.col("tag") == target).join(carry, [id_col, "_chunk"], "left")
    cols = []
    for i, name in enumerate(levels, start=1):
        v = F.coalesce(F.col(f"_w{i}"), F.col(f"_c{i}"))
        cols.append(F.when(v["l"] == i, v["t"]).otherwise(F.lit("")).alias(f"{name}_text"))
    return out.select(id_col, "pos", *rest, *cols)


# ---------------------------------------------------------------- S8 table rows, W8 first date / area

TR_OPEN = r"(?i)<tr[\s>]"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]\s*>"


def first_parseable_date(cells: Column) -> Column:
    """The first cell that parses as a catalog date."""
    from doccat.functions.dates import parse_date
    return F.try_element_at(F.filter(F.transform(cells, lambda c: parse_date(c)), lambda d: d.isNotNull()), F.lit(1))


def first_matching_area(cells: Column, areas: list[str]) -> Column:
    """The first allowed product area found in the cells (cells in order, areas in order)."""
    def hit(c):
        return F.coalesce(*[F.when(c.contains(a), F.lit(a)) for a in areas])
    return F.try_element_at(F.filter(F.transform(cells, hit), lambda a: a.isNotNull()), F.lit(1))


def table_rows(html: Column, base: str) -> Column:
    """``tr`` rows with at least two cells and a link -> array<struct<title, url, cells>>.

    Title is the link text, else the first cell; the link is made absolute.
    A row ends at the next ``<tr``; cells are ``td``/``th`` contents as text.
    """
    rows = F.slice(F.split(strip_noise(html), TR_OPEN), 2, 1 << 30)

    def row(r, i):
        cells = F.transform(F.regexp_extract_all(r, F.lit(CELL), 1), lambda c: fragment_text(c))
        href = href_value(F.regexp_extract(r, HREF_TAG, 1))
        text = fragment_text(F.regexp_extract(r, ANCHOR, 2))
        title = F.when(text != "", text).otherwise(F.try_element_at(cells, F.lit(1)))
        from doccat.functions.urls import absolute_url
        return F.struct(i.cast("bigint").alias("row_pos"), title.alias("title"), F.when(href != "", absolute_url(href, base)).alias("url"),
                        cells.alias("cells"), (href != "").alias("_has_link"))

    parsed = F.transform(rows, row)
    return F.filter(parsed, lambda x: (F.size(x["cells"]) >= 2) & x["_has_link"] & (F.coalesce(x["title"], F.lit("")) != ""))

