"""Catalog identity and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccat.functions.rules import CHANGE_FIELDS
from doccat.functions.text import strip_ws


def stable_id(agency: Column, title: Column, source_page_url: Column, document_url: Column) -> Column:
    """first 24 hex of sha256(agency|lower(strip(title))|lower(strip(locator)))."""
    locator = F.coalesce(F.when(source_page_url != "", source_page_url),
                         F.when(document_url != "", document_url), F.lit(""))
    key = F.concat_ws("|", agency, F.lower(strip_ws(title)), F.lower(strip_ws(locator)))
    return F.substring(F.sha2(key, 256), 1, 24)


def content_hash(cols: dict[str, Column] | None = None) -> Column:
    """F16: sha256 over the six change fields joined by '|', null -> ''."""
    parts = []
    for name in CHANGE_FIELDS:
        c = cols[name] if cols else F.col(name)
        parts.append(F.coalesce(c.cast("string"), F.lit("")))
    return F.sha2(F.concat_ws("|", *parts), 256)
