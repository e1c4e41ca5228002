"""Date parsing chains as native expressions.

Every format is guarded by an explicit shape regex so a branch only fires on
text of its own shape (Spark's lenient year widths would otherwise accept
'99-06-18' as year 99).  Two-digit years follow the 69 pivot (69-99 -> 19xx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from doccat.functions.rules import (
    CATALOG_DATE_CHAIN,
    DATE_FORMATS,
    DAY_FIRST_CHAIN,
    LEGACY_DAY_FIRST_CHAIN,
    LEGACY_MONTH_FIRST_CHAIN,
    TWO_DIGIT_YEAR_PIVOT,
)
from doccat.functions.text import clean_text, let, normalize_whitespace

_FORMATS = {name: (pattern, shape, short) for name, pattern, shape, short in DATE_FORMATS}


#: Per format the order of its fields, as groups of ``_FIELDS``' expression: year, month, day.
_FIELDS = {
    "iso": (r"^([0-9]+)-([0-9]+)-([0-9]+)$", 1, 2, 3),
    "compact": (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", 1, 2, 3),
    **{name: (r"^([0-9]+)/([0-9]+)/([0-9]+)$", 3, 1, 2) for name in ("us_long", "us_short")},
    **{name: (r"^([0-9]+)/([0-9]+)/([0-9]+)$", 3, 2, 1) for name in ("eu_long", "eu_short")},
    **{name: (r"^([A-Za-z]+) ([0-9]+), ([0-9]+)$", 3, 1, 2) for name in ("month_day_year", "mon_day_year")},
    **{name: (r"^([0-9]+) ([A-Za-z]+) ([0-9]+)$", 3, 2, 1) for name in ("day_month_year", "day_mon_year")},
}
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _branch(x: Column, name: str) -> Column:
    """The date of a text of the format's shape: its fields put in ISO order and cast.  A formatter would raise and catch an
    error for every text that is no date, and formats come one after another."""
    _pattern, shape, short = _FORMATS[name]
    fields, y, m, d = _FIELDS[name]
    if "MMM" in _pattern:
        number = F.position(F.lower(F.substring(F.regexp_extract(x, fields, m), 1, 3)), F.lit(_MONTHS))
        month = ((number + 2) / 3).cast("int").cast("string")
        iso = F.concat(F.regexp_extract(x, fields, y), F.lit("-"), month, F.lit("-"), F.regexp_extract(x, fields, d))
    else:
        iso = F.regexp_replace(x, fields, f"${y}-${m}-${d}")
    if short:
        iso = F.concat(F.when(F.substring(x, -2, 2) >= str(TWO_DIGIT_YEAR_PIVOT), F.lit("19")).otherwise(F.lit("20")), iso)
    return F.when(x.rlike(shape), iso.try_cast("date"))


def parse_date_chain(c: Column, chain: list[str]) -> Column:
    return let(clean_text(c), lambda x: _first_branch(x, chain))


def _first_branch(x: Column, chain: list[str]) -> Column:
    return F.coalesce(*[_branch(x, name) for name in chain])


def parse_date(c: Column) -> Column:
    """catalog chain, month first on ambiguous input; '' / junk -> null."""
    return parse_date_chain(c, CATALOG_DATE_CHAIN)


def parse_date_day_first(c: Column) -> Column:
    """day-first feed dates, then the catalog chain."""
    return parse_date_chain(c, DAY_FIRST_CHAIN)


#: Orders of the formats that ``normalize_dates`` knows by name.
CHAINS = {"month_first": CATALOG_DATE_CHAIN, "day_first": DAY_FIRST_CHAIN}


def normalize_dates(df: DataFrame, spec: dict[str, str], observation: Observation | None = None) -> DataFrame:
    """``df`` with ``<column>_date`` and ``<column>_format`` for every column of ``spec`` (column: name in ``CHAINS``).

    The format is that of the first parse, 'empty' or 'rejected'.

    With an ``observation``, whatever action runs the frame also counts, per column, texts parsed and rejected
    (``<column>_parsed``, ``<column>_rejected``): no pass of its own.
    """
    for name, order in spec.items():
        # one expression that binds what it computes: a filter on the format is pushed down with all of it
        found = let(clean_text(F.col(name)), lambda x: F.coalesce(
            *[let(_branch(x, f), lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(f).alias("format")))) for f in CHAINS[order]],
            F.struct(F.lit(None).cast("date").alias("date"), F.when(x == "", F.lit("empty")).otherwise(F.lit("rejected")).alias("format"))))
        df = df.withColumn(f"{name} found", found)
        df = df.withColumn(f"{name}_date", F.col(f"{name} found.date")).withColumn(f"{name}_format", F.col(f"{name} found.format")).drop(f"{name} found")
    if observation is None:
        return df
    return df.observe(observation, *[m for name in spec for m in (
        F.count_if(F.col(f"{name}_date").isNotNull()).alias(f"{name}_parsed"),
        F.count_if(F.col(f"{name}_format") == "rejected").alias(f"{name}_rejected"))])


def format_counts(dated: DataFrame, name: str) -> DataFrame:
    """Per format of a column of ``normalize_dates``: ``format, n, first_date, last_date``."""
    return dated.groupBy(F.col(f"{name}_format").alias("format")).agg(
        F.count(F.lit(1)).alias("n"), F.min(f"{name}_date").alias("first_date"), F.max(f"{name}_date").alias("last_date"))


def quarantined(dated: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``normalize_dates`` in which some column's text was rejected."""
    return dated.filter(F.greatest(F.lit(False), *[F.col(f"{n}_format") == "rejected" for n in names]))


ISO_DATETIME_OFFSET = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:?[0-9]{2})$"


def parse_api_datetime(c: Column) -> Column:
    """ISO datetime with offset -> its own local date (no zone shift), else F3."""
    def parsed(x: Column) -> Column:
        return F.coalesce(F.when(x.rlike(ISO_DATETIME_OFFSET), _branch(F.substring(x, 1, 10), "iso")), _first_branch(x, CATALOG_DATE_CHAIN))

    return let(clean_text(c), parsed)


def legacy_iso_date(c: Column, day_first: bool = False) -> Column:
    """ISO text of the first parse, else the cleaned text as is ('' stays '')."""
    chain = LEGACY_DAY_FIRST_CHAIN if day_first else LEGACY_MONTH_FIRST_CHAIN
    return let(normalize_whitespace(c), lambda x: F.coalesce(F.date_format(_first_branch(x, chain), "yyyy-MM-dd"), x))


def range_end(c: Column) -> Column:
    """text after the last ' to ' (whole text when absent)."""
    return F.substring_index(clean_text(c), " to ", -1)


MONTH_DAY_YEAR_IN_TEXT = (
    r"\b((January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+[0-9]{1,2},\s+[0-9]{4})\b"
)


def date_in_text(c: Column) -> Column:
    """first 'Month d, yyyy' in free text (as text; '' when none)."""
    return F.regexp_extract(c, MONTH_DAY_YEAR_IN_TEXT, 1)


DEADLINE = r"(?i)Deadline for comments by\s+([^;]+)"


def deadline_in_text(c: Column) -> Column:
    """deadline phrase -> parsed date (null when absent/unparseable)."""
    return parse_date(F.regexp_extract(c, DEADLINE, 1))
