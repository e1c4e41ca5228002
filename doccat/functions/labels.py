"""Display helpers (F8, F27) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccat.functions.rules import (
    LABEL_ACRONYMS,
    LABEL_PHRASES,
    LABEL_SMALL_WORDS,
    NO_VALUES,
    NOT_AVAILABLE,
    YES_VALUES,
)
from doccat.functions.text import clean_text, normalize_whitespace


def display_value(c: Column) -> Column:
    """Null or blank -> 'Not available.', else the text as is."""
    text = c.cast("string")
    return F.when(text.isNull() | (clean_text(text) == ""), F.lit(NOT_AVAILABLE)).otherwise(text)


def _capitalize(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def humanize_label(c: Column) -> Column:
    """underscores to blanks; acronyms upper, small words lower (not first), else Capitalised."""
    text = display_value(c)
    words = F.split(clean_text(F.replace(text, F.lit("_"), F.lit(" "))), " ")
    acr = F.array(*[F.lit(a) for a in LABEL_ACRONYMS])
    small = F.array(*[F.lit(s) for s in LABEL_SMALL_WORDS])
    fmt = F.transform(words, lambda w, i: F.when(F.array_contains(acr, F.upper(w)), F.upper(w))
                      .when((i > 0) & F.array_contains(small, F.lower(w)), F.lower(w))
                      .otherwise(_capitalize(F.lower(w))))
    out = F.when(text == F.lit(NOT_AVAILABLE), text)
    for raw, phrase in LABEL_PHRASES.items():
        out = out.when(text == F.lit(raw), F.lit(phrase))
    return out.otherwise(F.array_join(fmt, " "))


def yes_no(c: Column) -> Column:
    """F8: Yes / No canonical forms, other text kept (cleaned)."""
    text = normalize_whitespace(c)
    low = F.lower(text)
    return (F.when(low.isin(*YES_VALUES), F.lit("Yes"))
            .when(low.isin(*NO_VALUES), F.lit("No"))
            .otherwise(text))
