"""DuckDB mirrors of the HTML helpers (oracle only)."""

from __future__ import annotations

from html.entities import html5

from doccat.functions.rules import BOILERPLATE_MARKERS, SUMMARY_MIN_CHARS
from doccat.operators.html import P_END, P_OPEN
from doccat.plans.sql import clean, normalize_ws, q

NOISE = r"(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<!--.*?-->"
TOKEN = r"<[^>]*>|[^<]+"
DIV_MAIN = r"""<div\s[^>]*role\s*=\s*"main"[^>]*>"""
ARTICLE_MAIN = r"""<article\s[^>]*class\s*=\s*"[^"]*main-content[^"]*"[^>]*>"""


#: Anchors as the driver's pages write them: one href each, in double quotes, without references.
ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a\s*>"""


def strip_noise(h: str) -> str:
    return f"regexp_replace(coalesce({h}, ''), {q(NOISE)}, ' ', 'g')"


def fragment_text(x: str) -> str:
    return normalize_ws(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")


def all_references(x: str) -> str:
    """F2 with every name of the HTML5 table that ends in a semicolon, as the standard library lists it."""
    table = {k: v for k, v in html5.items() if k.endswith(";")}
    names = f"MAP {{{', '.join(f'{q(k[:-1])}: {q(v)}' for k, v in table.items())}}}"
    pieces = f"regexp_extract_all({x}, '&[A-Za-z][A-Za-z0-9]*;|[^&]+|&', 0)"
    return clean(f"array_to_string(list_transform({pieces}, lambda r: CASE WHEN starts_with(r, '&') AND length(r) > 2 "
                 f"THEN coalesce({names}[substr(r, 2, length(r) - 2)], r) ELSE r END), '')")


def paragraphs(h: str) -> str:
    pieces = f"string_split_regex({strip_noise(h)}, {q(P_OPEN)})"
    return f"list_transform(list_slice({pieces}, 2, len({pieces})), lambda p: {fragment_text(f"regexp_replace(p, {q(P_END)}, '')")})"


def candidate(t: str) -> str:
    bad = " OR ".join(f"contains(lower({t}), {q(m)})" for m in BOILERPLATE_MARKERS)
    return f"(length({t}) >= {SUMMARY_MIN_CHARS} AND NOT ({bad}))"


def _span(h: str, open_re: str, close_lit: str) -> str:
    rest = f"regexp_extract({h}, {q('(?is)(' + open_re + '.*)$')}, 1)"
    end = f"strpos(lower({rest}), {q(close_lit)})"
    return f"CASE WHEN {rest} <> '' THEN CASE WHEN {end} > 0 THEN substr({rest}, 1, {end} - 1) ELSE {rest} END END"


def _div_main(h: str) -> str:
    rest = f"regexp_extract({h}, {q('(?is)(' + DIV_MAIN + '.*)$')}, 1)"
    pieces = f"string_split_regex({rest}, '(?i)</div\\s*>')"
    opens = f"list_transform({pieces}, lambda p: len(regexp_extract_all(p, '(?i)<div[\\s>]', 0)))"
    depth = f"list_transform({opens}, lambda x, i: list_sum(list_slice({opens}, 1, i)) - i)"
    k = f"list_position({depth}, 0)"
    return (f"CASE WHEN {rest} <> '' THEN CASE WHEN coalesce({k}, 0) > 0 THEN array_to_string(list_slice({pieces}, 1, {k}), '</div>') "
            f"ELSE {rest} END END")


def containers(h: str) -> str:
    s = strip_noise(h)
    return (f"[{_div_main(s)}, {_span(s, ARTICLE_MAIN, '</article')}, {_span(s, '<article[\\s>]', '</article')}, "
            f"{_span(s, '<main[\\s>]', '</main')}, {s}]")


def page_summary(h: str) -> str:
    per = f"list_transform({containers(h)}, lambda c: list_filter({paragraphs('c')}, lambda t: {candidate('t')})[1])"
    return f"coalesce(list_filter({per}, lambda x: x IS NOT NULL)[1], '')"


def absolute(href: str, base: str) -> str:
    from doccat.plans.q_text_dates import _sql_absolute
    return _sql_absolute(href, base)


def anchors(h: str, group: int) -> str:
    return f"regexp_extract_all({strip_noise(h)}, {q(ANCHOR)}, {group})"


def current_version_status(h: str) -> str:
    from doccat.operators.html import BLOCK_HEADING, BLOCK_OPEN, LABEL_CLASS, META_OPEN, ROW_OPEN, VALUE_CLASS
    s = strip_noise(h)
    blocks = f"list_slice(string_split_regex({s}, {q(BLOCK_OPEN)}), 2, 1000000)"
    cur = (f"list_filter({blocks}, lambda b: lower({fragment_text(f'regexp_extract(b, {q(BLOCK_HEADING)}, 1)')}) "
           f"= 'current version')[1]")
    meta = f"regexp_extract({cur}, {q(META_OPEN)}, 2)"
    rows = f"list_slice(string_split_regex({meta}, {q(ROW_OPEN)}), 2, 1000000)"
    unl = f"list_filter({rows}, lambda r: NOT regexp_matches(lower(r), {q(LABEL_CLASS)}))"
    vals = (f"list_transform({unl}, lambda r: coalesce(nullif({fragment_text(f'regexp_extract(r, {q(VALUE_CLASS)}, 3)')}, ''), "
            f"{fragment_text('r')}))")
    return f"list_filter({vals}, lambda v: v <> '')[1]"


def first_pdf(h: str, base: str) -> str:
    f = (f"list_filter(regexp_extract_all({strip_noise(h)}, '(?i)<a\\s[^>]*?href\\s*=\\s*\"([^\"]*)\"[^>]*>', 1), "
         f"lambda x: contains(lower(x), '.pdf') AND contains(lower(x), '/documents/'))[1]")
    return f"CASE WHEN {f} IS NOT NULL THEN {absolute(f, base)} END"
