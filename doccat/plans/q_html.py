"""M5: HTML extraction and detail-page enrichment.

The driver's pages are uniform (nav links, one article), so some queries
derive variants of the real pages (extra headings, PDF / attachment links,
facet counts, protection markers) with fixed rules repeated in the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from doccat.functions.classify import status_columns
from doccat.functions.text import clean_title
from doccat.functions.urls import absolute_url_col, path_format, reference_number
from doccat.operators import html as H
from doccat.operators import html_tree as T
from doccat.plans import sql as S
from doccat.plans import sql_html as SH
from doccat.plans.q_catalog import catalog
from doccat.plans.registry import register
from doccat.session import ensure_checkpoint_dir
from doccat.sources.adapter import AS_OF_DATE
from doccat.sources.tables import table


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


# ---------------------------------------------------------------- H1 elements


def _sql_elements(src: str = "pages", text: str = S.normalize_ws("tok")) -> str:
    t = "tok"
    return f"""SELECT page_id, pos - 1 AS pos,
  CASE WHEN NOT starts_with({t}, '<') THEN 'text' WHEN starts_with({t}, '</') THEN 'close' ELSE 'open' END AS kind,
  CASE WHEN starts_with({t}, '<') THEN lower(regexp_extract({t}, '^</?\\s*([a-zA-Z][a-zA-Z0-9]*)', 1)) ELSE '' END AS tag,
  CASE WHEN starts_with({t}, '<') THEN '' ELSE {text} END AS text,
  regexp_extract({t}, '(?i)href\\s*=\\s*"([^"]*)"', 1) AS href,
  regexp_extract({t}, '(?i)class\\s*=\\s*"([^"]*)"', 1) AS cls,
  regexp_extract({t}, '(?i)role\\s*=\\s*"([^"]*)"', 1) AS role
FROM {src}, unnest(regexp_extract_all({SH.strip_noise('html')}, {S.q(SH.TOKEN)}, 0)) WITH ORDINALITY AS u(tok, pos)"""


@register("page_elements", lambda: _sql_elements(text=SH.all_references("tok")))
def page_elements(spark, sf_dir):
    """H1: every page as ordered tokens (open/close tags and decoded text runs)."""
    return H.element_table(pages(spark, sf_dir))


def _sql_tree() -> str:
    """The stack of open elements as a recursive query, one token of every page at a time."""
    def sets(which: int) -> str:
        return "CASE code " + " ".join(f"WHEN {S.q(tag)} THEN {list(rule[which])}" for tag, rule in T.IMPLIED_ENDS.items()) + " ELSE []::VARCHAR[] END"

    last = "len(names) + 1 - coalesce(list_position(list_reverse(list_transform(names, lambda n: {test})), true), len(names) + 1)"
    return f"""WITH RECURSIVE el AS ({_sql_elements(text=SH.all_references("tok"))}),
t AS (SELECT page_id, pos, kind, text, CASE WHEN kind = 'text' THEN '' WHEN tag = '' THEN '!' ELSE tag END AS code FROM el),
w(page_id, pos, kind, code, parent, depth, closed, stack, names) AS (
  SELECT DISTINCT page_id, -1::BIGINT, '', '', -1::BIGINT, 0::BIGINT, NULL::BIGINT, []::BIGINT[], []::VARCHAR[] FROM t
  UNION ALL
  SELECT page_id, pos, kind, code, CASE WHEN kind = 'close' AND k > 0 THEN stack[k] WHEN keep > 0 THEN stack[keep] ELSE -1 END, keep,
    CASE WHEN kind = 'close' AND k > 0 THEN stack[k] END,
    CASE WHEN pushed THEN list_append(stack[1:keep], pos) ELSE stack[1:keep] END, CASE WHEN pushed THEN list_append(names[1:keep], code) ELSE names[1:keep] END
  FROM (SELECT *, CASE WHEN k > 0 THEN k - 1 ELSE len(names) END AS keep, kind = 'open' AND code <> '!' AND NOT code IN {tuple(T.VOID)} AS pushed
    FROM (SELECT page_id, t.pos, t.kind, t.code, w.stack, w.names,
        CASE t.kind WHEN 'close' THEN {last.format(test="n = t.code")} WHEN 'open' THEN
          CASE WHEN {last.format(test=f"list_contains(({sets(0).replace('CASE code', 'CASE t.code')}), n)")}
            > {last.format(test=f"list_contains(({sets(1).replace('CASE code', 'CASE t.code')}), n)")}
          THEN {last.format(test=f"list_contains(({sets(0).replace('CASE code', 'CASE t.code')}), n)")} ELSE 0 END ELSE 0 END AS k
      FROM w JOIN t USING (page_id) WHERE t.pos = w.pos + 1) a) b),
inside AS (SELECT page_id, unnest(stack) AS pos, max(pos) AS up_to FROM (SELECT page_id, pos, stack FROM w) x GROUP BY page_id, unnest(stack)),
shut AS (SELECT page_id, closed AS pos, pos AS at FROM w WHERE closed IS NOT NULL),
n AS (SELECT w.*, coalesce(shut.at, inside.up_to, w.pos) AS stop, kind = 'open' AND code <> '!' AS element
  FROM w LEFT JOIN inside ON w.page_id = inside.page_id AND w.pos = inside.pos LEFT JOIN shut ON w.page_id = shut.page_id AND w.pos = shut.pos WHERE w.pos >= 0),
o AS (SELECT *, CASE WHEN element THEN row_number() OVER (PARTITION BY page_id, parent, element ORDER BY pos) ELSE 0 END AS ordinal FROM n),
p(page_id, pos, path) AS (
  SELECT page_id, pos, CAST(ordinal AS VARCHAR) FROM o WHERE element AND parent = -1
  UNION ALL SELECT o.page_id, o.pos, p.path || '/' || o.ordinal FROM p JOIN o ON o.page_id = p.page_id AND o.parent = p.pos AND o.element)
SELECT o.page_id, o.pos, o.stop AS "end", o.depth, o.parent, o.ordinal, p.path, o.kind, CASE WHEN o.code = '!' THEN '' ELSE o.code END AS tag, t.text
FROM o JOIN t ON o.page_id = t.page_id AND o.pos = t.pos LEFT JOIN p ON o.page_id = p.page_id AND o.pos = p.pos"""


@register("page_tree", _sql_tree)
def page_tree(spark, sf_dir):
    """H1: every page as nested intervals: each token with its element's end, depth, parent, ordinal and path."""
    return H.element_tree(pages(spark, sf_dir)).drop("attrs")


@register("page_paragraphs", lambda: f"""SELECT page_id, pos - 1 AS p_idx, t AS text FROM pages,
  unnest({SH.paragraphs('html')}) WITH ORDINALITY AS u(t, pos) WHERE t <> ''""")
def page_paragraphs(spark, sf_dir):
    """H2: paragraphs per page under the stated malformed-markup rule (empty ones dropped)."""
    p = pages(spark, sf_dir)
    return (p.select("page_id", F.posexplode(H.paragraphs(F.col("html"))).alias("p_idx", "text"))
            .filter(F.col("text") != "").withColumn("p_idx", F.col("p_idx").cast("bigint")))


@register("page_summary", lambda: f"SELECT page_id, {SH.page_summary('html')} AS summary FROM pages")
def page_summary(spark, sf_dir):
    """W5 + H4 + H5: first non-boilerplate paragraph of 80+ characters in container priority order."""
    return pages(spark, sf_dir).select("page_id", H.page_summary(F.col("html")).alias("summary"))


@register("page_links", lambda: f"""SELECT page_id, pos - 1 AS pos, {SH.absolute('h', 'url')} AS href, {SH.fragment_text('t')} AS text
FROM (SELECT page_id, url, unnest({SH.anchors('html', 1)}) AS h, unnest({SH.anchors('html', 2)}) AS t,
  unnest(range(1, len({SH.anchors('html', 1)}) + 1)) AS pos FROM pages) x""")
def page_links(spark, sf_dir):
    """H3: anchors with absolute hrefs and their text."""
    p = pages(spark, sf_dir)
    return p.select("page_id", F.posexplode(H.links(F.col("html"), F.col("url"))).alias("pos", "l")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("l.href").alias("href"), F.col("l.text").alias("text"))


# ---------------------------------------------------------------- derived pages


def _pdf_pages(p):
    """Pages whose nav links point at documents (every third page)."""
    html = F.when(F.col("page_id") % 3 == 0,
                  F.regexp_replace("html", r'href="/([^"]*)"', 'href="/en/documents/$1_en.pdf"')).otherwise(F.col("html"))
    return p.select("page_id", "url", html.alias("html"))


_SQL_PDF_PAGES = """(SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, 'href="/([^"]*)"',
  'href="/en/documents/\\1_en.pdf"', 'g') ELSE html END AS html FROM pages)"""


@register("first_pdf_link", lambda: f"""SELECT page_id, CASE WHEN f IS NOT NULL THEN {SH.absolute('f', 'url')} END AS pdf_url FROM (
  SELECT page_id, url, list_filter(regexp_extract_all({SH.strip_noise('html')}, '(?i)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"[^>]*>', 1),
    lambda x: contains(lower(x), '.pdf') AND contains(lower(x), '/documents/'))[1] AS f FROM {_SQL_PDF_PAGES} p) x""")
def first_pdf_link(spark, sf_dir):
    """H6: first '.pdf' link under '/documents/' per page (absolute)."""
    p = _pdf_pages(pages(spark, sf_dir))
    return p.select("page_id", H.first_pdf_link(F.col("html"), F.col("url")).alias("pdf_url"))


def _att_pages(p):
    html = (F.when(F.col("page_id") % 4 == 0, F.regexp_replace("html", r'href="/([^"]*)"', 'href="/main/att/downloadAtt?id=$1"'))
            .when(F.col("page_id") % 4 == 1, F.regexp_replace("html", r'href="/([^"]*)">', 'href="/downloadAtt/$1.PDF">file '))
            .otherwise(F.col("html")))
    return p.select("page_id", "url", html.alias("html"))


_SQL_ATT_PAGES = """(SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN regexp_replace(html, 'href="/([^"]*)"', 'href="/main/att/downloadAtt?id=\\1"', 'g')
  WHEN page_id % 4 = 1 THEN regexp_replace(html, 'href="/([^"]*)">', 'href="/downloadAtt/\\1.PDF">file ', 'g') ELSE html END AS html FROM pages)"""


def _sql_attachment() -> str:
    z = f"list_filter(list_zip({SH.anchors('html', 1)}, {SH.anchors('html', 2)}), lambda x: contains(x[1], 'downloadAtt'))[1]"
    url = SH.absolute("f[1]", "url")
    probe = f"lower(trim(concat_ws(' ', {url}, {SH.fragment_text('f[2]')})))"
    return f"""SELECT page_id, CASE WHEN f IS NOT NULL THEN {url} END AS attachment_url,
  CASE WHEN f IS NOT NULL THEN CASE WHEN ends_with({probe}, '.pdf') THEN 'PDF'
    WHEN ends_with({probe}, '.doc') OR ends_with({probe}, '.docx') THEN 'DOCX' END END AS attachment_format
FROM (SELECT page_id, url, {z} AS f FROM {_SQL_ATT_PAGES} p) x"""


@register("first_attachment", _sql_attachment)
def first_attachment(spark, sf_dir):
    """H7: first 'downloadAtt' link per page and its format from URL + link text."""
    p = _att_pages(pages(spark, sf_dir))
    a = H.first_attachment(F.col("html"), F.col("url"))
    return p.select("page_id", a["url"].alias("attachment_url"), a["format"].alias("attachment_format"))


_MARK = '<script>var $_ts=1;</script>'


@register("protection_gate", f"""SELECT page_id, contains(h, '9DhefwqGPrzGxEp9hPaoag') OR contains(h, '$_ts') AS rejected
FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '{_MARK}' || html WHEN page_id % 10 = 1 THEN repeat(' ', 5000) || '{_MARK}' || html
  ELSE html END AS h FROM pages) x""")
def protection_gate(spark, sf_dir):
    """P10: pages that carry a protection marker are rejected."""
    p = pages(spark, sf_dir)
    h = (F.when(F.col("page_id") % 10 == 0, F.concat(F.lit(_MARK), "html"))
         .when(F.col("page_id") % 10 == 1, F.concat(F.repeat(F.lit(" "), 5000), F.lit(_MARK), "html"))
         .otherwise(F.col("html")))
    return p.select("page_id", H.looks_like_protection_page(h).alias("rejected"))


_FACET = ('<a class="facet-item is-active" data-drupal-facet-item-value="004_ema_guidance_and_info" '
          'data-drupal-facet-item-count="{n}">Guidance</a>')


@register("result_count", lambda: f"""SELECT page_id, coalesce(
  CASE WHEN f <> '' AND regexp_matches(trim(replace(f, ',', '')), '^[0-9]+$') THEN CAST(trim(replace(f, ',', '')) AS BIGINT) END,
  CASE WHEN g <> '' AND regexp_matches(trim(replace(g, ',', '')), '^[0-9]+$') THEN CAST(trim(replace(g, ',', '')) AS BIGINT) END) AS result_count
FROM (SELECT page_id, regexp_extract(h, '(?is)<a\\s[^>]*class\\s*=\\s*"[^"]*is-active[^"]*"[^>]*data-drupal-facet-item-count\\s*=\\s*"([^"]*)"[^>]*>', 1) AS f,
  regexp_extract({SH.fragment_text('h')}, '(?i)Search results\\s*\\(?\\s*([0-9,]+)\\s*\\)?', 1) AS g FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace('{_FACET}', '{{n}}', format('{{:,}}', page_id * 37)) || html
    WHEN page_id % 3 = 1 THEN '<h2>Search results (' || CAST(page_id * 7 AS VARCHAR) || ')</h2>' || html ELSE html END AS h FROM pages) a) b""")
def result_count(spark, sf_dir):
    """H8 + F25: result count from the active facet, else from the 'Search results (n)' heading."""
    p = pages(spark, sf_dir)
    n = F.format_number(F.col("page_id") * 37, 0)
    h = (F.when(F.col("page_id") % 3 == 0, F.concat(F.replace(F.lit(_FACET), F.lit("{n}"), n), "html"))
         .when(F.col("page_id") % 3 == 1, F.concat(F.lit("<h2>Search results ("), (F.col("page_id") * 7).cast("string"),
                                                   F.lit(")</h2>"), "html"))
         .otherwise(F.col("html")))
    return p.select("page_id", H.result_count(h).alias("result_count"))


# ---------------------------------------------------------------- W1 carry-forward

_LEVELS = ["h1", "h2", "h3"]


def _section_pages(p):
    """Pages with trailing sections: h2 'Annex k' with a file link, an h3 on even pages, a second h2 and h3."""
    pid = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit("<h2>Annex "), (F.col("page_id") % 3).cast("string"), F.lit('</h2><ul><li><a href="/files/a'), pid,
        F.lit('.pdf">Annex file [12KB]</a></li></ul>'),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<h3>Part B</h3><ul><li><a href="/files/b'), pid,
                                                   F.lit('.pdf">(Attachment) Part B</a></li></ul>'))).otherwise(F.lit("")),
        F.lit('<h2>Other</h2><a href="/x">x</a><h3>Part C</h3><a href="/files/c.pdf">C &amp; D</a>'))
    return p.select("page_id", "url", F.concat("html", extra).alias("html"))


_SQL_SECTION_PAGES = """(SELECT page_id, url, html || '<h2>Annex ' || CAST(page_id % 3 AS VARCHAR) || '</h2><ul><li><a href="/files/a'
  || CAST(page_id AS VARCHAR) || '.pdf">Annex file [12KB]</a></li></ul>' || CASE WHEN page_id % 2 = 0 THEN '<h3>Part B</h3><ul><li><a href="/files/b'
  || CAST(page_id AS VARCHAR) || '.pdf">(Attachment) Part B</a></li></ul>' ELSE '' END
  || '<h2>Other</h2><a href="/x">x</a><h3>Part C</h3><a href="/files/c.pdf">C &amp; D</a>' AS html FROM pages)"""


def _sql_carry(events: str, idc: str, levels: list[str], target: str, extra_cols: str) -> str:
    w = f"(PARTITION BY {idc} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    counts = ", ".join(f"sum(CASE WHEN tag = {S.q(lv)} THEN 1 ELSE 0 END) OVER {w} AS n_{lv}" for lv in levels)
    lasts, outs = [], []
    for i, lv in enumerate(levels):
        key = "[" + ", ".join(f"n_{h}" for h in levels[:i]) + "]" if i else "[]::BIGINT[]"
        lasts.append(f"last_value(CASE WHEN tag = {S.q(lv)} THEN struct_pack(k := {key}, t := text) END IGNORE NULLS) OVER {w} AS l_{lv}")
        outs.append(f"CASE WHEN l_{lv}.k = {key} THEN l_{lv}.t ELSE '' END AS {lv}_text")
    return f"""SELECT {idc}, pos, {extra_cols}, {', '.join(outs)} FROM (
  SELECT *, {', '.join(lasts)} FROM (SELECT *, {counts} FROM {events} ev) a) b WHERE tag = {S.q(target)}"""


def _sql_heading_events(levels: list[str], target: str) -> str:
    lv = ", ".join(S.q(x) for x in levels)
    w = "(PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""(WITH el AS ({_sql_elements(_SQL_SECTION_PAGES + ' sp')}),
b AS (SELECT *, last_value(CASE WHEN tag IN ({lv}) AND kind IN ('open', 'close') THEN struct_pack(p := pos, k := kind) END IGNORE NULLS)
  OVER {w} AS bnd FROM el),
tx AS (SELECT page_id, bnd.p AS pos, {S.clean("string_agg(text, ' ' ORDER BY pos)")} AS text FROM b
  WHERE kind = 'text' AND bnd.k = 'open' GROUP BY page_id, bnd.p)
SELECT e.page_id, e.pos, e.tag, coalesce(tx.text, '') AS text, e.href FROM b e LEFT JOIN tx ON e.page_id = tx.page_id AND e.pos = tx.pos
WHERE e.kind = 'open' AND (e.tag IN ({lv}) OR e.tag = {S.q(target)}))"""


def section_links(spark, sf_dir):
    el = H.element_table(_section_pages(pages(spark, sf_dir)))
    ensure_checkpoint_dir(spark)
    # read twice below (rows and summaries of chunks): pages are taken apart once
    ev = H.heading_events(el, "page_id", _LEVELS, "a").checkpoint(eager=True)
    return H.carry_forward(ev, "page_id", _LEVELS, "a")


@register("section_carry_forward", lambda: _sql_carry(_sql_heading_events(_LEVELS, "a"), "page_id", _LEVELS, "a", "text, href"))
def section_carry_forward(spark, sf_dir):
    """Every link with the latest h1 / h2 / h3 before it; a higher heading resets the lower ones."""
    return section_links(spark, sf_dir)


_ROLES = ["system", "user"]


@register("conversation_carry_forward", lambda: _sql_carry(
    "(SELECT conv_id, turn AS pos, role AS tag, text FROM conversations)", "conv_id", _ROLES, "assistant", "text"))
def conversation_carry_forward(spark, sf_dir):
    """W1 on conversations: each assistant turn with the latest system and user turn before it (system resets user)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("tag"), "text")
    return H.carry_forward(c, "conv_id", _ROLES, "assistant")


# ---------------------------------------------------------------- J1-J3 enrichment


def _with_page(records, key, pg):
    """Each record with the page whose id is its key modulo the number of pages, so all pages are used."""
    total = pg.agg(F.count(F.lit(1)).alias("_pages"))
    keyed = records.crossJoin(F.broadcast(total)).withColumn("_page", F.expr(f"try_mod({key}, _pages)"))
    return keyed.join(pg, keyed["_page"] == pg["page_id"], "left").drop("_pages", "_page")


def _records_with_pages(spark, sf_dir):
    from doccat.plans.q_search import legacy_records
    rec = legacy_records(spark, sf_dir).select("ord", "guidance_page_link", "summary")
    pg = pages(spark, sf_dir).select("page_id", "url")
    j = _with_page(rec, "ord", pg)
    link = F.coalesce(F.col("url"), F.concat(F.lit("https://missing.example.org/"), F.col("ord").cast("string")))
    return j.select("ord", link.alias("guidance_page_link"), "summary")


@register("enrich_summaries", lambda: f"""WITH legacy AS ({S.legacy_cte()}),
rec AS (SELECT l.ord, coalesce(p.url, 'https://missing.example.org/' || CAST(l.ord AS VARCHAR)) AS link, l.summary
        FROM legacy l LEFT JOIN pages p ON l.ord % (SELECT count(*) FROM pages) = p.page_id),
ps AS (SELECT url, {SH.page_summary('html')} AS ps FROM pages WHERE url IN (SELECT link FROM rec) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
SELECT rec.ord, coalesce(nullif(ps.ps, ''), rec.summary) AS summary FROM rec LEFT JOIN ps ON rec.link = ps.url""")
def enrich_summaries(spark, sf_dir):
    """Record summary replaced by its detail page's summary when the page gives one."""
    from doccat.operators.enrich import enrich_summaries as enrich
    out = enrich(_records_with_pages(spark, sf_dir), pages(spark, sf_dir))
    return out.select("ord", "summary")


_CUR = ('<div class="paragraph--type--ema-documents"><h3>Document history</h3><div class="file-metadata">'
        '<div class="file-metadata-row"><span class="value">Draft</span></div></div></div>'
        '<div class="paragraph--type--ema-documents"><h2>Current version</h2><div class="file-metadata">'
        '<div class="file-metadata-row"><span class="label">Status</span><span class="value">ignored</span></div>'
        '<div class="file-metadata-row"><span class="value">{v}</span></div></div></div>')


def _detail_pages(p):
    base = _pdf_pages(p)
    html = (F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit(_CUR.replace("{v}", "Adopted"))))
            .when(F.col("page_id") % 10 == 5, F.concat("html", F.lit(_CUR.replace("{v}", "Consultation open"))))
            .otherwise(F.col("html")))
    return base.select("page_id", "url", html.alias("html"))


_SQL_DETAIL_PAGES = f"""(SELECT page_id, url, CASE WHEN page_id % 10 = 0 THEN html || {S.q(_CUR.replace('{v}', 'Adopted'))}
  WHEN page_id % 10 = 5 THEN html || {S.q(_CUR.replace('{v}', 'Consultation open'))} ELSE html END AS html FROM {_SQL_PDF_PAGES} pp)"""


@register("enrich_status_pdf", lambda: f"""WITH catalog AS ({S.catalog_cte()}), dp AS {_SQL_DETAIL_PAGES},
docs AS (SELECT c.doc_id, c.title, c.comment_end_date, c.status_raw, c.status_normalized, c.sub_status, c.document_url, c.document_format,
  coalesce(p.url, 'https://missing.example.org/' || CAST(c.doc_id AS VARCHAR)) AS source_page_url
  FROM catalog c LEFT JOIN pages p ON c.doc_id % (SELECT count(*) FROM pages) = p.page_id),
pg AS (SELECT url, {SH.current_version_status('html')} AS sr, {SH.first_pdf('html', "'https://www.ema.europa.eu'")} AS pdf
  FROM dp WHERE url IN (SELECT source_page_url FROM docs) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1),
j AS (SELECT d.*, pg.sr, pg.pdf, {S.status_index('d.title', 'pg.sr', "'EMA'", 'd.comment_end_date')} AS si
  FROM docs d LEFT JOIN pg ON d.source_page_url = pg.url)
SELECT doc_id, CASE WHEN coalesce(sr, '') <> '' THEN sr ELSE status_raw END AS status_raw,
  CASE WHEN coalesce(sr, '') <> '' THEN {S.status_of('si')} ELSE status_normalized END AS status_normalized,
  CASE WHEN coalesce(sr, '') <> '' THEN {S.sub_status_of('si')} ELSE sub_status END AS sub_status,
  coalesce(pdf, document_url) AS document_url, CASE WHEN pdf IS NOT NULL THEN 'PDF' ELSE document_format END AS document_format
FROM j""")
def enrich_status_pdf(spark, sf_dir):
    """J2 + W6 + H6: current-version status re-classified and the PDF link taken from each detail page."""
    from doccat.operators.enrich import enrich_status_and_pdf
    c = catalog(spark, sf_dir)
    pg = pages(spark, sf_dir).select("page_id", "url")
    docs = _with_page(c, "doc_id", pg).select(
        "doc_id", "title", "comment_end_date", "status_raw", "status_normalized", "sub_status", "document_url",
        "document_format",
        F.coalesce(F.col("url"), F.concat(F.lit("https://missing.example.org/"), F.col("doc_id").cast("string")))
        .alias("source_page_url"))
    out = enrich_status_and_pdf(docs, _detail_pages(pages(spark, sf_dir)), AS_OF_DATE)
    return out.select("doc_id", "status_raw", "status_normalized", "sub_status", "document_url", "document_format")


@register("enrich_attachments", lambda: f"""WITH ap AS {_SQL_ATT_PAGES},
items AS (SELECT d.doc_id, coalesce(p.url, 'https://missing.example.org/' || CAST(d.doc_id AS VARCHAR)) AS detail_url
  FROM documents d LEFT JOIN pages p ON d.doc_id % (SELECT count(*) FROM pages) = p.page_id),
pg AS (SELECT url, f FROM (SELECT url, list_filter(list_zip({SH.anchors('html', 1)}, {SH.anchors('html', 2)}),
  lambda x: contains(x[1], 'downloadAtt'))[1] AS f FROM ap WHERE url IN (SELECT detail_url FROM items) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1) z),
a AS (SELECT url, CASE WHEN f IS NOT NULL THEN {SH.absolute('f[1]', "'https://www.cde.org.cn'")} END AS au, f FROM pg)
SELECT i.doc_id, a.au AS document_url,
  CASE WHEN a.f IS NOT NULL THEN CASE WHEN ends_with(lower(trim(concat_ws(' ', a.au, {SH.fragment_text('a.f[2]')}))), '.pdf') THEN 'PDF'
    WHEN ends_with(lower(trim(concat_ws(' ', a.au, {SH.fragment_text('a.f[2]')}))), '.doc')
      OR ends_with(lower(trim(concat_ws(' ', a.au, {SH.fragment_text('a.f[2]')}))), '.docx') THEN 'DOCX' END END AS document_format
FROM items i LEFT JOIN a ON i.detail_url = a.url""")
def enrich_attachments(spark, sf_dir):
    """J3 + H7: items take the first attachment of their detail page."""
    from doccat.operators.enrich import enrich_attachments as enrich
    d = table(spark, sf_dir, "documents").select("doc_id")
    pg = pages(spark, sf_dir).select("page_id", "url")
    items = _with_page(d, "doc_id", pg).select(
        "doc_id", F.coalesce(F.col("url"), F.concat(F.lit("https://missing.example.org/"), F.col("doc_id").cast("string")))
        .alias("detail_url"),
        F.lit(None).cast("string").alias("document_url"), F.lit(None).cast("string").alias("document_format"))
    return enrich(items, _att_pages(pages(spark, sf_dir))).select("doc_id", "document_url", "document_format")


# ---------------------------------------------------------------- J9 / S9 / P9


def _sources(spark, sf_dir):
    p = pages(spark, sf_dir)
    cfg = p.select(
        "url", F.concat(F.lit("Area "), (F.col("page_id") % 3).cast("string")).alias("product_area"),
        F.when(F.col("page_id") % 2 == 0, F.array(F.lit("Part B"))).alias("allowed_sections"),
        F.when(F.col("page_id") % 3 == 0, F.lit("Annex 0")).alias("required_parent"))
    missing = spark.createDataFrame([("https://missing.example.org/config", "Area X", None, None)],
                                    "url string, product_area string, allowed_sections array<string>, required_parent string")
    return cfg.unionByName(missing)


_SQL_SOURCES = """(SELECT url, 'Area ' || CAST(page_id % 3 AS VARCHAR) AS product_area,
  CASE WHEN page_id % 2 = 0 THEN ['Part B'] END AS allowed_sections, CASE WHEN page_id % 3 = 0 THEN 'Annex 0' END AS required_parent
  FROM pages UNION ALL SELECT 'https://missing.example.org/config', 'Area X', NULL, NULL)"""


def _kept_links(spark, sf_dir):
    from doccat.operators.enrich import in_scope_links
    links = section_links(spark, sf_dir).join(pages(spark, sf_dir).select("page_id", "url"), "page_id")
    return in_scope_links(links, _sources(spark, sf_dir), "h2_text", "h3_text")


def _sql_kept() -> str:
    carry = _sql_carry(_sql_heading_events(_LEVELS, "a"), "page_id", _LEVELS, "a", "text, href")
    return f"""kept AS (SELECT c.page_id, c.pos, c.href, s.url, s.product_area FROM ({carry}) c JOIN pages p ON c.page_id = p.page_id
  JOIN {_SQL_SOURCES} s ON s.url = p.url
  WHERE (s.required_parent IS NULL OR c.h2_text = s.required_parent)
    AND (s.allowed_sections IS NULL OR list_contains(s.allowed_sections, c.h3_text)))"""


@register("in_scope_links", lambda: f"WITH {_sql_kept()} SELECT page_id, pos, href, product_area FROM kept")
def in_scope_links_query(spark, sf_dir):
    """Links of configured pages (every page is configured) under the source's required parent and allowed sections."""
    return _kept_links(spark, sf_dir).select("page_id", "pos", "href", "product_area")


@register("source_audit", lambda: f"""WITH {_sql_kept()}
SELECT s.url, coalesce(k.n, 0) AS rows, CASE WHEN p.url IS NULL THEN 'missing page' WHEN coalesce(k.n, 0) = 0 THEN 'no rows'
  ELSE 'ok' END AS verdict
FROM {_SQL_SOURCES} s LEFT JOIN (SELECT DISTINCT url FROM pages) p ON s.url = p.url
LEFT JOIN (SELECT url, count(*) AS n FROM kept GROUP BY url) k ON s.url = k.url""")
def source_audit(spark, sf_dir):
    """Each configured source page must exist and yield in-scope rows."""
    from doccat.operators.enrich import source_audit as audit
    return audit(_sources(spark, sf_dir), pages(spark, sf_dir), _kept_links(spark, sf_dir))


@register("link_documents", lambda: f"""SELECT page_id, pos, href, title, {S.reference_number('href')} AS reference_number,
  CASE WHEN ends_with(lower({S.url_path('href')}), '.pdf') THEN 'PDF' END AS document_format FROM (
  SELECT page_id, pos, href, CASE WHEN starts_with(lower(t1), '(attachment)') THEN {S.strip_ws('substr(t1, 13)')} ELSE t1 END AS title FROM (
    SELECT page_id, pos - 1 AS pos, {SH.absolute('h', 'url')} AS href,
      regexp_replace(regexp_replace({S.clean(SH.fragment_text('t'))}, {S.q(_file_size())}, '', 'g'), '^[ \\-–—]+|[ \\-–—]+$', '', 'g') AS t1
    FROM (SELECT page_id, url, unnest({SH.anchors('html', 1)}) AS h, unnest({SH.anchors('html', 2)}) AS t,
      unnest(range(1, len({SH.anchors('html', 1)}) + 1)) AS pos FROM {_SQL_SECTION_PAGES} sp) x) y) z
WHERE contains(href, '/files/') AND title <> ''""")
def link_documents(spark, sf_dir):
    """P9 + F21 + F20: links into '/files/' with a cleaned, non-empty title; stem as reference number."""
    from doccat.operators.enrich import link_documents as docs
    p = _section_pages(pages(spark, sf_dir))
    links = p.select("page_id", F.posexplode(H.links(F.col("html"), F.col("url"))).alias("pos", "l")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("l.href").alias("href"), F.col("l.text").alias("text"))
    return docs(links).select("page_id", "pos", "href", "title", "reference_number", "document_format")


def _file_size():
    from doccat.functions.text import FILE_SIZE_SUFFIX
    return FILE_SIZE_SUFFIX


# ---------------------------------------------------------------- S8 / W8 table rows

_TABLE = ('<table><tr><th>标题</th><th>发布日期</th><th>分类</th></tr>'
          '<tr><td><a href="/zdyz/domesticinfopage?zdyzIdCODE=P{id}">指导原则 {id}</a></td><td>n/a</td><td>2024-03-1{d}</td><td>生物制品 化学药</td></tr>'
          '<tr><td>无链接</td><td>2024-01-01</td></tr>'
          '<tr><td><a href="detail/{id}.html"></a>附件 {id}</td><td>06/0{d}/2023</td></tr>'
          '<tr><td><a href="/x">only one cell</a></td></tr></table>')


def _table_pages(p):
    t = F.replace(F.replace(F.lit(_TABLE), F.lit("{id}"), F.col("page_id").cast("string")), F.lit("{d}"),
                  (F.col("page_id") % 9 + 1).cast("string"))
    return p.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat("html", t)).otherwise(F.col("html")).alias("html"))


def _sql_table_rows() -> str:
    from doccat.functions.rules import CDE_ALLOWED_PRODUCT_AREAS
    from doccat.sources.feeds import CDE_BASE_URL
    cell_re = H.CELL
    t = (f"replace(replace({S.q(_TABLE)}, '{{id}}', CAST(page_id AS VARCHAR)), '{{d}}', CAST(page_id % 9 + 1 AS VARCHAR))")
    rows = f"list_slice(string_split_regex({SH.strip_noise('h')}, {S.q(H.TR_OPEN)}), 2, 1000000)"
    href = "regexp_extract(r, '(?is)<a\\s[^>]*?href\\s*=\\s*\"([^\"]*)\"[^>]*>', 1)"
    text = SH.fragment_text(f"regexp_extract(r, {S.q(SH.ANCHOR)}, 2)")
    cells = f"list_transform(regexp_extract_all(r, {S.q(cell_re)}, 1), lambda c: {SH.fragment_text('c')})"
    area_hit = "coalesce(" + ", ".join(f"CASE WHEN contains(c, {S.q(a)}) THEN {S.q(a)} END" for a in CDE_ALLOWED_PRODUCT_AREAS) + ")"
    dates = f"list_filter(list_transform(cells, lambda c: {S.date_chain(S.clean('c'), S.CATALOG_CHAIN)}), lambda x: x IS NOT NULL)[1]"
    return f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html || {t} ELSE html END AS h FROM pages),
r AS (SELECT page_id, pos - 1 AS row_pos, r FROM p, unnest({rows}) WITH ORDINALITY AS u(r, pos)),
c AS (SELECT page_id, row_pos, {cells} AS cells, {href} AS href, {text} AS text FROM r),
d AS (SELECT *, CASE WHEN text <> '' THEN text ELSE cells[1] END AS title FROM c)
SELECT page_id, row_pos, title, {SH.absolute('href', S.q(CDE_BASE_URL))} AS source_page_url,
  {dates} AS published_date,
  list_filter(list_transform(cells, lambda c: {area_hit}), lambda a: a IS NOT NULL)[1] AS product_area
FROM d WHERE len(cells) >= 2 AND href <> '' AND coalesce(title, '') <> ''"""


@register("html_table_rows", _sql_table_rows)
def html_table_rows(spark, sf_dir):
    """S8 + W8: table rows with two or more cells and a link; first parseable date and first allowed area."""
    from doccat.functions.rules import CDE_ALLOWED_PRODUCT_AREAS
    from doccat.sources.feeds import CDE_BASE_URL
    p = _table_pages(pages(spark, sf_dir))
    x = p.select("page_id", F.explode(H.table_rows(F.col("html"), CDE_BASE_URL)).alias("r"))
    return x.select("page_id", F.col("r.row_pos").alias("row_pos"), F.col("r.title").alias("title"), F.col("r.url").alias("source_page_url"),
                    H.first_parseable_date(F.col("r.cells")).alias("published_date"),
                    H.first_matching_area(F.col("r.cells"), CDE_ALLOWED_PRODUCT_AREAS).alias("product_area"))


# ---------------------------------------------------------------- sectioned link pages


def _pmda_pages(p):
    """Every page turned into a sectioned link page (its own link list, a dated paragraph, an excluded section)."""
    pid = F.col("page_id").cast("string")
    sec = F.concat(F.lit("Section "), (F.col("page_id") % 3).cast("string"))
    html = F.concat(
        F.lit("<main><h2>Regulations and Notifications</h2><h4>"), sec, F.lit('</h4><ul><li><a href="/files/'), pid,
        F.lit('.pdf">Guidance '), pid, F.lit(" [12KB]</a></li></ul><p>March "), (F.col("page_id") % 28 + 1).cast("string"),
        F.lit(", 2024 Notice</p><h4>Other</h4><ul><li><a href=\"/files/o"), pid,
        F.lit('.pdf">(Attachment) Other '), pid, F.lit("</a> June 1, 2023 Early text</li></ul>"),
        F.lit('<h2>FAQ</h2><a href="/files/faq.pdf">FAQ</a></main>'), F.col("html"))
    return p.select("page_id", "url", html.alias("html"))


def pmda_inputs(spark, sf_dir):
    """Landed sectioned pages (url, html, and the source each was landed for, as URLs may repeat) and the configured sources."""
    p = _pmda_pages(pages(spark, sf_dir))
    src = p.select(F.col("page_id").alias("src_ord"), "url", F.lit("Area").alias("product_area"),
                   F.when(F.col("page_id") % 2 == 1, F.array(F.concat(F.lit("Section "), (F.col("page_id") % 3).cast("string"))))
                   .alias("allowed_sections"), F.lit(None).cast("string").alias("required_parent"))
    return p.select("url", "html", F.col("page_id").alias("src_ord")), src


@register("pmda_page_documents", lambda: f"""SELECT page_id AS src_ord, 'Guidance ' || CAST(page_id AS VARCHAR) AS title,
  'https://www.pmda.go.jp/files/' || CAST(page_id AS VARCHAR) || '.pdf' AS document_url,
  DATE '2024-03-01' + CAST(page_id % 28 AS INTEGER) AS published_date, 'Notice' AS status_raw, 'final' AS status_normalized,
  'Area / Section ' || CAST(page_id % 3 AS VARCHAR) AS topic_raw, CAST(page_id AS VARCHAR) AS reference_number FROM pages
UNION ALL SELECT page_id, 'Other ' || CAST(page_id AS VARCHAR), 'https://www.pmda.go.jp/files/o' || CAST(page_id AS VARCHAR) || '.pdf',
  DATE '2023-06-01', 'Early text', 'final', 'Area / Other', 'o' || CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 2 = 0""")
def pmda_page_documents(spark, sf_dir):
    """Sectioned link pages -> documents (H9 metadata, F22 dates, section rules, F21 titles, W2 URL dedupe).

    Every page is a configured source; odd pages only allow 'Section k' h4s.
    """
    from doccat.operators.pmda import pmda_documents
    d = pmda_documents(*pmda_inputs(spark, sf_dir))
    return d.select(F.col("page_id").alias("src_ord"), "title", "document_url", "published_date", "status_raw",
                    "status_normalized", "topic_raw", "reference_number")
