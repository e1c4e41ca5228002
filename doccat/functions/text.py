"""Text cleanup as native Column expressions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() whitespace set: ASCII blanks, \x0b, the \x1c-\x1f separators,
# NEL and every Unicode space/separator.  Java's \s alone is ASCII-only.
WS_CLASS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Whitespace runs that are not already one blank; most runs are, and need no replacement.
WS_RUN = rf"[{WS_CLASS}&&[^ ]]{WS_CLASS}*| {WS_CLASS}+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(c: Column | str) -> Column:
    """collapse every whitespace run to one blank, trim, null -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), WS_RUN, " "))


def strip_ws(c: Column | str) -> Column:
    """Remove Unicode whitespace at both ends only (``trim`` removes just blanks)."""
    return F.regexp_replace(_c(c), "^" + WS_CLASS + "+|" + WS_CLASS + "+$", "")


def nullif_empty(c: Column | str) -> Column:
    c = _c(c)
    return F.when(c != F.lit(""), c)


def unescape_common(c: Column | str) -> Column:
    """Decode the common HTML entities natively; ``&amp;`` last so it is not decoded twice."""
    out = _c(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


#: A possible reference that ``unescape_common`` does not decode: a number, or a name with or without semicolon.
RARE_REFERENCE = r"&(?!(?:lt|gt|quot|apos|nbsp|amp|#39);)(?:#[0-9xX]|[A-Za-z])"


@lru_cache(maxsize=None)
def _unescape_udf():
    """Arrow batches of texts through the standard library's table.  Defined here and not at module level, so
    that it is sent to the workers whole."""

    def run(texts: pd.Series) -> pd.Series:
        from html import unescape

        return texts.map(unescape, na_action="ignore")

    return F.pandas_udf(run, "string")


#: What a page is read as: whole tags, references, runs of text without either, and what begins neither.
PIECE = r"<[^>]*>|&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^<&]+|[<&]"


@lru_cache(maxsize=None)
def _plain_pieces_udf():
    """References, and tags with references, of each page in ``plain_references`` form; other pieces are null and stay so."""
    def run(pages: pd.Series) -> pd.Series:
        import re
        from html import unescape

        closed = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z0-9]{1,32});")
        kept = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"})

        def decoded(reference: str) -> str:
            char = unescape(reference)
            return reference if char == reference else char.translate(kept)

        def plain(piece: str | None) -> str | None:
            if piece is None:
                return None
            return closed.sub(lambda m: decoded(m[0]), piece) if piece[0] == "<" else decoded(piece)

        return pages.map(lambda pieces: [plain(p) for p in pieces], na_action="ignore")

    return F.pandas_udf(run, "array<string>")


def unescape_html(c: Column | str) -> Column:
    """Decode all character references as the HTML5 table has them, names without semicolon included.

    Texts with the common references alone never leave the JVM; of the others only the text goes through
    one Arrow function.  Not for use inside lambdas: there, texts come from ``plain_references``.
    """
    c = _c(c)
    common = let(c, lambda x: F.when(~x.rlike(RARE_REFERENCE), unescape_common(x)))
    return F.coalesce(common, _unescape_udf()(let(c, lambda x: F.when(x.rlike(RARE_REFERENCE), x))))


def plain_references(markup: Column | str) -> Column:
    """Markup in which every reference is decoded but those of ``& < > " '``, written by their common names: what
    remains ``unescape_common`` decodes natively, each reference once.  Inside tags only references with a
    semicolon count, so the query of a link keeps its ``&copy=1``.  Pages are taken apart and put together natively:
    only the references, and the tags that hold some, go through one Arrow function."""
    c = _c(markup)
    pieces = F.when(c.rlike(RARE_REFERENCE), F.regexp_extract_all(c, F.lit(PIECE), F.lit(0)))
    held = F.transform(pieces, lambda p: F.when(p.startswith("&") | (p.startswith("<") & p.contains("&")), p))
    plain = F.zip_with(pieces, _plain_pieces_udf()(held), lambda p, d: F.coalesce(d, p))
    return F.coalesce(F.array_join(plain, ""), c)


def normalize_whitespace(c: Column | str) -> Column:
    """character references decoded, then F1 (legacy records: null -> '')."""
    return clean_text(unescape_html(F.coalesce(_c(c).cast("string"), F.lit(""))))


#: A tag: quoted attribute values may hold '>'; one with an odd quote ends at its first '>'.
TAG = r"""<[^'">]*+(?:(?:"[^"]*"|'[^']*')[^'">]*+)*+>|<[^>]*>"""


def fragment_text(fragment: Column) -> Column:
    """H2: a piece of ``plain_references`` markup -> plain text (tags to blanks, references decoded, F1); native."""
    return clean_text(unescape_common(strip_tags(fragment)))


def strip_tags(c: Column | str) -> Column:
    """H2 helper: every tag becomes a blank (text of adjacent elements stays apart)."""
    return F.regexp_replace(_c(c), TAG, " ")


def html_to_text(c: Column | str) -> Column:
    """H2: fragment -> plain text; empty -> null."""
    return nullif_empty(normalize_whitespace(strip_tags(clean_text(c))))


FILE_SIZE_SUFFIX = r"(?i)" + WS_CLASS + r"*[\[［]" + WS_CLASS + r"*[0-9.,]+" + WS_CLASS + r"*(KB|MB)" + WS_CLASS + r"*[\]］]" + WS_CLASS + r"*$"


def clean_title(c: Column | str) -> Column:
    """drop a trailing file-size tag, surrounding blanks/dashes and a leading '(Attachment)'."""
    t = F.regexp_replace(F.regexp_replace(clean_text(c), FILE_SIZE_SUFFIX, ""), r"^[ \-–—]+|[ \-–—]+$", "")
    return F.when(F.lower(t).startswith("(attachment)"), strip_ws(F.substring(t, 13, 1 << 30))).otherwise(t)


def md_escape(c: Column | str) -> Column:
    """Markdown table-cell escape of the pipe."""
    return F.replace(_c(c), F.lit("|"), F.lit("\\|"))


def category_separator(c: Column | str) -> Column:
    """';' -> '; '."""
    return F.replace(_c(c), F.lit(";"), F.lit("; "))


def search_corpus(cols: list[str]) -> Column:
    """P5: lower-cased ' c1 c2 ...' with null -> '' (a hit may span columns)."""
    parts = []
    for name in cols:
        parts += [F.lit(" "), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return F.lower(F.concat(*parts))
