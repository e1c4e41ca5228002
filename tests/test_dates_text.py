import datetime as dt

from pyspark.sql import functions as F

from doccat.functions import dates as D
from doccat.functions.labels import humanize_label, yes_no
from doccat.functions.text import clean_text, clean_title


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


def test_catalog_date_formats(spark):
    for text in ["2026-06-18", "20260618", "06/18/2026", "06/18/26", "June 18, 2026", "Jun 18, 2026",
                 "18 June 2026", "18 Jun 2026", " 2026-06-18 "]:
        assert one(spark, D.parse_date, text) == dt.date(2026, 6, 18), text
    for text in ["", None, "not a date", "2026-13-45"]:
        assert one(spark, D.parse_date, text) is None


def test_ambiguous_dates_month_first_and_day_first(spark):
    assert one(spark, D.parse_date, "12/03/2026") == dt.date(2026, 12, 3)
    assert one(spark, D.parse_date_day_first, "12/03/2026") == dt.date(2026, 3, 12)
    assert one(spark, D.parse_date_day_first, "08/05/2026") == dt.date(2026, 5, 8)
    assert one(spark, D.parse_date_day_first, "18/12/2008") == dt.date(2008, 12, 18)


def test_two_digit_year_pivot(spark):
    assert one(spark, D.parse_date, "1/2/69") == dt.date(1969, 1, 2)
    assert one(spark, D.parse_date, "1/2/99") == dt.date(1999, 1, 2)
    assert one(spark, D.parse_date, "1/2/68") == dt.date(2068, 1, 2)


def test_legacy_iso_keeps_unparseable_text(spark):
    assert one(spark, D.legacy_iso_date, "05/20/2026") == "2026-05-20"
    assert one(spark, D.legacy_iso_date, "TBD") == "TBD"
    assert one(spark, D.legacy_iso_date, None) == ""
    assert one(spark, lambda c: D.legacy_iso_date(c, day_first=True), "11/02/2011") == "2011-02-11"


def test_api_datetime_keeps_its_own_day(spark):
    assert one(spark, D.parse_api_datetime, "2025-08-12T23:30:00-0500") == dt.date(2025, 8, 12)
    assert one(spark, D.parse_api_datetime, "2025-08-12T15:00:36+0200") == dt.date(2025, 8, 12)


def test_range_end_and_deadline(spark):
    assert one(spark, D.range_end, "01/02/2024 to 30/04/2024") == "30/04/2024"
    assert one(spark, D.deadline_in_text, "Deadline for comments by 1 December 2099; more") == dt.date(2099, 12, 1)


def test_clean_text_unicode_blanks(spark):
    assert one(spark, clean_text, "a   b\n\tc　") == "a b c"
    assert one(spark, clean_text, None) == ""


def test_clean_title(spark):
    assert one(spark, clean_title, "First-in-Human Guidance[263.18KB]") == "First-in-Human Guidance"
    assert one(spark, clean_title, "Mutagenic Impurities (Early Consideration)［399KB］") == "Mutagenic Impurities (Early Consideration)"
    assert one(spark, clean_title, "(Attachment) Annex - ") == "Annex"


def test_labels_and_yes_no(spark):
    assert one(spark, humanize_label, "CMC_quality") == "CMC Quality"
    assert one(spark, humanize_label, "open_for_comment") == "Open for comment"
    assert one(spark, humanize_label, "safety_and_pharmacovigilance") == "Safety and Pharmacovigilance"
    assert one(spark, humanize_label, None) == "Not available."
    assert one(spark, yes_no, " YES ") == "Yes"
    assert one(spark, yes_no, "0") == "No"
    assert one(spark, yes_no, "Maybe") == "Maybe"


def test_normalize_dates_counts_formats_in_the_same_pass(spark):
    from pyspark.sql import Observation
    texts = ["2026-06-18", "06/18/26", "18/06/2026", "June 18, 2026", "", None, "soon", "31/31/2020", " 2026-06-19 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, raw string")
    seen = Observation()
    dated = D.normalize_dates(df, {"raw": "month_first"}, seen)
    got = {r["format"]: (r["n"], r["first_date"]) for r in D.format_counts(D.normalize_dates(df, {"raw": "month_first"}), "raw").collect()}
    day = dt.date(2026, 6, 18)
    assert got == {"iso": (2, day), "us_short": (1, day), "eu_long": (1, day), "month_day_year": (1, day), "empty": (2, None), "rejected": (2, None)}
    assert sorted(r["k"] for r in D.quarantined(dated, ["raw"]).collect()) == [6, 7]
    assert seen.get == {"raw_parsed": 5, "raw_rejected": 2}


def test_a_filter_on_the_format_does_not_multiply_the_parses(spark):
    """The filter is pushed below the projections with what it reads: every format stands there once, and once in the output."""
    from doccat.functions import dates as D
    df = spark.range(3).selectExpr("id", "concat('2024-0', cast(id as string), '-01') AS raw")
    left = D.quarantined(D.normalize_dates(df, {"raw": "month_first"}), ["raw"])
    assert left._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 20
    assert [r["id"] for r in left.collect()] == [0]


def test_only_odd_whitespace_is_replaced(spark):
    """Single blanks, most of a text, are no matches; every other run becomes one blank."""
    import re

    from doccat.functions.text import WS_RUN, clean_text
    runs = [" ", "  ", "\t", " \t", "\n ", "\u00a0", " \u2003 ", "\x1c\x85", "\u2028", "\x0b\x0c\r\n"]
    texts = [a + "x" + b + "y" + a for a in ["", *runs] for b in runs] + runs + [""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", clean_text("t").alias("c")).collect()}
    assert got == {t: " ".join(re.split(r"\s+", t)).strip() for t in texts}
    assert spark.createDataFrame([("a b c d",)], "t string").filter(F.col("t").rlike(WS_RUN)).count() == 0
