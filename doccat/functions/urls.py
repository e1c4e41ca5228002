"""URL helpers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccat.functions.text import let, unescape_common

URL_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def url_path(u: Column) -> Column:
    """Path part of an absolute URL ('' when there is none)."""
    return F.regexp_extract(F.coalesce(u, F.lit("")), URL_PATH, 1)


def document_format(u: Column) -> Column:
    """PDF / DOCX from the URL suffix, else null."""
    low = F.lower(F.trim(F.coalesce(u, F.lit(""))))
    return (F.when(low.endswith(".pdf"), F.lit("PDF"))
            .when(low.endswith(".doc") | low.endswith(".docx"), F.lit("DOCX")))


def path_format(u: Column) -> Column:
    """PDF when the URL path ends in .pdf (query and fragment ignored), else null."""
    return F.when(F.lower(url_path(u)).endswith(".pdf"), F.lit("PDF"))


def mime_format(mimetype: Column, uri: Column) -> Column:
    """F17 (tree feed): format from MIME text and file suffix, falling back to the MIME text."""
    suffix = F.regexp_extract(url_path(uri), r"(\.[^./]*)$", 1)
    text = F.lower(F.concat_ws(" ", F.coalesce(mimetype, F.lit("")), suffix))
    return (F.when(text.contains("pdf"), F.lit("PDF"))
            .when(text.contains("word") | text.contains(".docx"), F.lit("DOCX"))
            .when(text.contains("powerpoint") | text.contains(".ppt"), F.lit("PPT"))
            .when(text.contains("video") | text.contains(".mp4"), F.lit("VIDEO"))
            .otherwise(mimetype))


def reference_number(u: Column) -> Column:
    """file stem of the URL path (last segment without its last extension)."""
    last = F.substring_index(url_path(u), "/", -1)
    return F.regexp_replace(last, r"\.[^.]*$", "")


def _base_parts(base: str) -> tuple[str, str, str]:
    scheme, rest = base.split("://", 1)
    host = rest.split("/", 1)[0]
    path = "/" + rest.split("/", 1)[1] if "/" in rest else "/"
    return scheme, host, path


#: An anchor's opening tag with an href (group 1, as written, quotes included), and a whole anchor (group 2: content).
HREF_TAG = r"""(?is)<a(?=\s)(?:"[^"]*"|'[^']*'|[^"'>])*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)(?:"[^"]*"|'[^']*'|[^"'>])*>"""
ANCHOR = HREF_TAG + r"(.*?)</a\s*>"


def href_value(written: Column) -> Column:
    """An href as written (in ``plain_references`` markup), in either kind of quotes or none, without them and decoded."""
    return unescape_common(F.regexp_replace(written, "^[\"']|[\"']$", ""))


def without_dots(url: Column) -> Column:
    """The URL with '.' and '..' segments of its path resolved; others pass unchanged."""
    return let(url, _without_dots)


def _without_dots(url: Column) -> Column:
    head = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    segments = F.split(F.substring(path, 2, 1 << 30), "/", -1)

    def step(acc: Column, s: Column) -> Column:
        return F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    slash = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(head, F.lit("/"), F.array_join(kept, "/"), slash, rest)
    return F.when(url.rlike(r"^[^?#]*/\.\.?(?:[/?#]|$)"), resolved).otherwise(url)


def absolute_url(href: Column, base: str) -> Column:
    """resolve ``href`` against a fixed ``base`` URL.

    Cases: has a scheme -> as is; '//host' -> base scheme; '/path' -> base origin;
    '?q' -> base path + query; '#f' -> base (no fragment) + fragment; '' -> base;
    otherwise relative to the base directory.  Paths lose their dot segments.
    """
    scheme, host, path = _base_parts(base)
    base_dir = path[: path.rfind("/") + 1]
    base_no_frag = base.split("#", 1)[0]
    base_no_query = base_no_frag.split("?", 1)[0]

    def resolved(h: Column) -> Column:
        return (F.when(h == "", F.lit(base))
                .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h)
                .when(h.startswith("//"), F.concat(F.lit(scheme + ":"), h))
                .when(h.startswith("/"), without_dots(F.concat(F.lit(f"{scheme}://{host}"), h)))
                .when(h.startswith("?"), F.concat(F.lit(base_no_query), h))
                .when(h.startswith("#"), F.concat(F.lit(base_no_frag), h))
                .otherwise(without_dots(F.concat(F.lit(f"{scheme}://{host}{base_dir}"), h))))

    return let(F.trim(F.coalesce(href, F.lit(""))), resolved)


def first_pdf_or_download(links: Column) -> Column:
    """first link ending .pdf or holding /media/ or 'download', else first link, else ''."""
    def first(found: Column) -> Column:
        hit = F.filter(found, lambda x: F.lower(x).endswith(".pdf") | F.lower(x).contains("/media/")
                       | F.lower(x).contains("download"))
        return F.coalesce(F.try_element_at(hit, F.lit(1)), F.try_element_at(found, F.lit(1)), F.lit(""))

    return let(links, first)


def link_label(u: Column) -> Column:
    """'PDF' for document-like links, 'Page' otherwise, '' when empty."""
    x = F.coalesce(u, F.lit(""))
    return (F.when(x == "", F.lit(""))
            .when(x.rlike(r"(?i)\.pdf$|/media/|/documents/"), F.lit("PDF"))
            .otherwise(F.lit("Page")))


def absolute_url_col(href: Column, base: Column) -> Column:
    """F18 with a per-row base URL (same cases as ``absolute_url``)."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    no_frag = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    base_dir = F.when(url_path(base) == "", F.concat(origin, F.lit("/"))).otherwise(
        F.regexp_replace(no_query, r"[^/]*$", ""))

    def resolved(h: Column) -> Column:
        return (F.when(h == "", base)
                .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), h)
                .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
                .when(h.startswith("/"), without_dots(F.concat(origin, h)))
                .when(h.startswith("?"), F.concat(no_query, h))
                .when(h.startswith("#"), F.concat(no_frag, h))
                .otherwise(without_dots(F.concat(base_dir, h))))

    return let(F.trim(F.coalesce(href, F.lit(""))), resolved)
