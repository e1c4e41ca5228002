"""Element tree of pages (H1) and what reads its intervals.

A page's tokens (tags and text runs) are numbered in document order.  One pass with a stack of open
elements, a page at a time in Arrow batches, gives each token its parent, depth, last token and number
among its siblings; everything else is native expressions over the page's arrays, so a page is never
spread over rows to be gathered again, and nothing is shuffled.

Rules for malformed markup:
* an opening tag ends open elements as HTML implies: ``li``, ``dt``/``dd``, table cells, rows and row groups, ``option``,
  and a ``p`` before block elements; what stands open inside them ends too;
* a closing tag ends the nearest open element of its name and all inside it; without one it means nothing;
* void elements hold nothing; at the end of the page everything ends;
* an attribute counts at its first occurrence; values stand in either kind of quotes or none, and a quoted one
  may hold ``>``.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.functions.rules import BOILERPLATE_MARKERS, SUMMARY_MIN_CHARS
from doccat.functions.text import TAG, clean_text, fragment_text, let, plain_references, unescape_common

NOISE = r"(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<!--.*?-->"
TOKEN = TAG + r"|[^<]+|<"
TAG_NAME = r"^</?\s*([a-zA-Z][a-zA-Z0-9]*)"
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'"""

# FIXED VALUES of the HTML standard
VOID = "area base br col embed hr img input link meta source track wbr".split()
BLOCKS = ("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
          "section table ul").split()
#: What the stack pass gives each token.
TREE = ("end", "depth", "parent", "ordinal", "path")
#: Opening tag: the open elements it ends, and the elements it does not look beyond.
IMPLIED_ENDS = {
    "li": (["li"], ["ul", "ol"]),
    "dt": (["dt", "dd"], ["dl"]),
    "dd": (["dt", "dd"], ["dl"]),
    "td": (["td", "th"], ["tr", "table"]),
    "th": (["td", "th"], ["tr", "table"]),
    "tr": (["tr"], ["table"]),
    "tbody": (["thead", "tbody", "tfoot"], ["table"]),
    "thead": (["thead", "tbody", "tfoot"], ["table"]),
    "tfoot": (["thead", "tbody", "tfoot"], ["table"]),
    "option": (["option"], ["select"]),
    **{tag: (["p"], ["td", "th", "table"]) for tag in BLOCKS},
}


def strip_noise(html: Column) -> Column:
    """Markup without scripts, styles and comments, its rare references decoded (``plain_references``)."""
    return F.regexp_replace(plain_references(F.coalesce(html, F.lit(""))), NOISE, " ")


def tokens(html: Column, stripped: bool = False) -> Column:
    return F.regexp_extract_all(html if stripped else strip_noise(html), F.lit(TOKEN), 0)


def tag_code(token: Column) -> Column:
    """'' for text, else the lower-case name, with a slash before it for a closing tag ('!' and '?' tags: '!')."""
    name = F.lower(F.regexp_extract(token, TAG_NAME, 1))
    return F.when(~token.rlike("(?s)^<.*>$"), F.lit("")).when(name == "", F.lit("!")).when(
        token.startswith("</"), F.concat(F.lit("/"), name)).otherwise(name)


@lru_cache(maxsize=None)
def _tree_udf(ends_only: bool = False):
    """``joined_codes`` of a page -> arrays (end, depth, parent, ordinal, path) with one value per token, or the ends alone;
    made here so that it is sent whole."""
    import numpy as np

    void, implied = frozenset(VOID), {k: (frozenset(a), frozenset(b)) for k, (a, b) in IMPLIED_ENDS.items()}

    def tree(joined: str) -> tuple:
        codes = joined.split(" ")[:-1]
        n, stack, names, end, parent, depth, ordinal, path, children = len(codes), [], [], [], [], [], [], [], [0]
        count: dict[str, int] = {}  # open elements by name
        for i, code in enumerate(codes):
            end.append(i)
            if code[:1] == "/":
                if count.get(code[1:]):
                    while True:
                        last = names.pop()
                        count[last] -= 1
                        children.pop()
                        at = stack.pop()
                        end[at] = i if last == code[1:] else i - 1
                        if last == code[1:]:
                            break
                    parent.append(at)  # a closing tag belongs to its element
                else:
                    parent.append(stack[-1] if stack else -1)
                depth.append(len(stack))
                ordinal.append(0)
                path.append(None)
                continue
            if code in implied and any(count.get(x) for x in implied[code][0]):
                ends, beyond = implied[code]
                for k in range(len(names) - 1, -1, -1):
                    if names[k] in ends:
                        for at, name in zip(stack[k:], names[k:]):
                            end[at] = i - 1
                            count[name] -= 1
                        del stack[k:], names[k:], children[k + 1:]
                        break
                    if names[k] in beyond:
                        break
            parent.append(stack[-1] if stack else -1)
            depth.append(len(stack))
            if code and code != "!":
                children[-1] += 1
                ordinal.append(children[-1])
                path.append(None if ends_only else (f"{path[stack[-1]]}/" if stack else "") + str(children[-1]))
                if code not in void:
                    stack.append(i)
                    names.append(code)
                    children.append(0)
                    count[code] = count.get(code, 0) + 1
            else:
                ordinal.append(0)
                path.append(None)
        for at in stack:
            end[at] = n - 1
        return end, depth, parent, ordinal, path

    def ends(pages: pd.Series) -> pd.Series:
        return pages.map(lambda joined: np.array(tree(joined)[0], "int32"))

    def run(pages: pd.Series) -> pd.DataFrame:
        found = [tree(joined) for joined in pages]
        columns = {name: [t[i] if name == "path" else np.array(t[i], "int32") for t in found] for i, name in enumerate(TREE)}
        return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})

    if ends_only:
        return F.pandas_udf(ends, "array<int>")
    return F.pandas_udf(run, "struct<end:array<int>,depth:array<int>,parent:array<int>,ordinal:array<int>,path:array<string>>")


def joined_codes(codes: Column) -> Column:
    """A page's codes as one text, each with a blank behind it."""
    return F.array_join(F.transform(codes, lambda c: F.concat(c, F.lit(" "))), "")


def positions(codes: Column, test) -> Column:
    """Positions, in order, of the tokens for which ``test(code, position)`` holds."""
    return F.filter(F.transform(codes, lambda c, i: F.when(test(c, i), i)), lambda i: i.isNotNull())


def token_text(toks: Column, codes: Column, first: Column, stop: Column) -> Column:
    """Text of the text tokens from ``first`` up to, not including, ``stop`` (H2)."""
    size = F.greatest(stop - first, F.lit(0))
    runs = F.zip_with(F.slice(toks, first + 1, size), F.slice(codes, first + 1, size), lambda t, c: F.when(c == "", t))
    return clean_text(unescape_common(F.array_join(runs, " ")))


BOILERPLATE_RE = "(?i)" + "|".join("\\Q" + m + "\\E" for m in BOILERPLATE_MARKERS)


def is_summary_candidate(text: Column) -> Column:
    """H4: at least 80 characters and none of the boilerplate markers (one case-insensitive scan)."""
    return (F.length(text) >= SUMMARY_MIN_CHARS) & ~text.rlike(BOILERPLATE_RE)


#: H5 containers in order of preference: tag and what its opening tag must hold.
CONTAINERS = [
    ("div", r"""(?is)\srole\s*=\s*(?:"main"|'main'|main[\s/>])"""),
    ("article", r"""(?is)\sclass\s*=\s*(?:"[^"]*main-content|'[^']*main-content|main-content[\s/>])"""),
    ("article", None),
    ("main", None),
]


def page_summary(html: Column, stripped: bool = False) -> Column:
    """W5 + H5: first qualifying paragraph of the first container that has one; '' when none.

    A paragraph starts at ``<p`` and ends at the next ``<p``, ``</p>`` or ``</article>``, and with its container.
    A container is the first element of its kind, with all its descendants (its interval in the tree), so nested
    and unclosed elements count as they stand.  Pass ``stripped=True`` with a column already run through
    ``strip_noise``.  The work is linear in the page's tags.
    """
    toks = tokens(html, stripped)
    page = F.struct(toks.alias("toks"), F.transform(toks, tag_code).alias("codes"), _tree_udf(ends_only=True)(joined_codes(F.transform(toks, tag_code))).alias("ends"))

    def paragraphs_in(p: Column) -> Column:
        stops = positions(p["codes"], lambda c, i: c.isin("p", "/p", "/article"))
        return let(stops, lambda s: F.filter(
            F.transform(s, lambda at, j: F.struct(at.alias("at"), F.coalesce(F.get(s, j + 1), F.size(p["toks"])).alias("stop"))),
            lambda x: F.get(p["codes"], x["at"]) == "p"))

    def first_candidate(p: Column, ps: Column, begin: Column, stop: Column) -> Column:
        inside = F.filter(ps, lambda x: (x["at"] >= begin) & (x["at"] < stop))
        texts = F.transform(inside, lambda x: token_text(p["toks"], p["codes"], x["at"] + 1, F.least(x["stop"], stop)))
        return F.try_element_at(F.filter(texts, is_summary_candidate), F.lit(1))

    def container(p: Column, tag: str, holds: str | None) -> Column:
        def test(c: Column, i: Column) -> Column:
            return (c == tag) & F.get(p["toks"], i).rlike(holds) if holds else c == tag
        return F.get(positions(p["codes"], test), F.lit(0))

    def summary(p: Column) -> Column:
        def pick(ps: Column) -> Column:
            ranked = [let(container(p, tag, holds), lambda at: F.when(at.isNotNull(), first_candidate(
                p, ps, at, F.get(p["ends"], at) + 1))) for tag, holds in CONTAINERS]
            # coalesce is lazy: the whole page is only read when no container holds a candidate
            return F.coalesce(*ranked, first_candidate(p, ps, F.lit(0), F.size(p["toks"])), F.lit(""))
        return let(paragraphs_in(p), pick)

    return let(page, summary)


def attributes(token: Column) -> Column:
    """Attributes of an opening tag as a map (names in lower case, '' where there is no value); empty for other tokens."""
    inside = F.regexp_replace(token, r"^<[^\s/>]*|/?>$", "")
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 1), F.lower).alias("k"),
                         F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 2).alias("v"))
    named = F.filter(pairs, lambda x: x["k"] != "")
    names = F.transform(named, lambda x: x["k"])
    first = F.filter(named, lambda x, i: F.array_position(names, x["k"]) == i + 1)
    found = F.map_from_entries(F.transform(first, lambda x: F.struct(
        x["k"], unescape_common(F.regexp_replace(x["v"], "^[\"']|[\"']$", "")).alias("v"))))
    has = token.startswith("<") & ~token.startswith("</") & token.rlike(r"^<[a-zA-Z][^\s/>]*[\s/]+[^\s/>]")
    return F.when(has, found).otherwise(F.create_map().cast("map<string,string>"))


def element_tree(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """H1: one row per token of each page: ``pos`` (from 0), ``end`` (last token of an element, its own position for
    others), ``depth``, ``parent`` (position of the enclosing element, -1 at the top; a closing tag's element),
    ``ordinal`` (number among the elements of its parent, from 1; 0 for other tokens), ``path`` (ordinals from the
    top, joined by '/'), ``kind`` open/close/text, ``tag``, ``text`` (decoded, cleaned) and ``attrs``.

    An element's descendants are the rows of its page with ``pos < other.pos <= end``.  Null pages have no rows.
    """
    t = pages.select(id_col, tokens(F.col("html")).alias("toks")).select(id_col, "toks", F.transform("toks", tag_code).alias("codes"))
    t = t.select(id_col, "toks", "codes", _tree_udf()(joined_codes(F.col("codes"))).alias("tree"))
    rows = t.select(id_col, F.posexplode(F.arrays_zip("toks", "codes", *[F.col("tree")[c].alias(c) for c in TREE])).alias("pos", "x"))
    up = F.col("x")
    rows = rows.select(id_col, F.col("pos").cast("bigint").alias("pos"), F.col("x.toks").alias("tok"), F.col("x.codes").alias("code"),
                       *[up[c].cast("bigint").alias(c) for c in ("end", "depth", "parent", "ordinal")], up["path"].alias("path"))
    code, tok = F.col("code"), F.col("tok")
    kind = F.when(code == "", F.lit("text")).when(code.startswith("/"), F.lit("close")).otherwise(F.lit("open"))
    tag = F.when(code == "!", F.lit("")).otherwise(F.regexp_replace(code, "^/", ""))
    return rows.select(id_col, "pos", "end", "depth", "parent", "ordinal", "path", kind.alias("kind"), tag.alias("tag"),
                       F.when(code == "", clean_text(unescape_common(tok))).otherwise(F.lit("")).alias("text"), attributes(tok).alias("attrs"))
