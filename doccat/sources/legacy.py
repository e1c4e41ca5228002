"""Legacy 12-field records (all strings, '' = missing) derived from ``orders``.

Stands in for the paged FDA list: one record per order, fields built by fixed
rules that the DuckDB oracle repeats.  ``ord`` is the feed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.functions.dates import legacy_iso_date
from doccat.functions.labels import yes_no
from doccat.functions.rules import LEGACY_RECORD_FIELDS, MONTH_NAMES
from doccat.sources.adapter import PHRASES, pick

LEGACY_FIELDS = [f for f, _h in LEGACY_RECORD_FIELDS]
ORGS = ["CDER", "CBER", "CDRH", "OC"]
ANSWERS = ["Yes", "no", "", "TRUE", "0"]


def raw_date_text(key: Column, ts: Column) -> Column:
    """Date text in one of twelve shapes chosen by ``key % 12`` (two are junk/empty)."""
    y = F.year(ts).cast("string")
    m = F.month(ts)
    d = F.dayofmonth(ts)
    ms, ds = m.cast("string"), d.cast("string")
    mm, dd = F.lpad(ms, 2, "0"), F.lpad(ds, 2, "0")
    name = pick(MONTH_NAMES, m - 1)
    abbr = F.substring(name, 1, 3)
    yy = F.lpad((F.year(ts) % 100).cast("string"), 2, "0")
    k = key % 12
    return (F.when(k == 0, F.concat(y, F.lit("-"), mm, F.lit("-"), dd))
            .when(k == 1, F.concat(y, mm, dd))
            .when(k == 2, F.concat(ms, F.lit("/"), ds, F.lit("/"), y))
            .when(k == 3, F.concat(ms, F.lit("/"), ds, F.lit("/"), yy))
            .when(k == 4, F.concat(ds, F.lit("/"), ms, F.lit("/"), y))
            .when(k == 5, F.concat(name, F.lit(" "), ds, F.lit(", "), y))
            .when(k == 6, F.concat(abbr, F.lit(" "), ds, F.lit(", "), y))
            .when(k == 7, F.concat(ds, F.lit(" "), name, F.lit(" "), y))
            .when(k == 8, F.concat(ds, F.lit(" "), abbr, F.lit(" "), y))
            .when(k == 9, F.lit("n/a"))
            .when(k == 10, F.lit(""))
            .otherwise(F.concat(F.lit("  "), y, F.lit("-"), ms, F.lit("-"), ds, F.lit(" "))))


def legacy_records_from_orders(orders: DataFrame) -> DataFrame:
    """The legacy record frame: ``ord`` + the 12 string fields."""
    k = F.col("o_orderkey")
    ks = k.cast("string")
    name = F.concat(pick(PHRASES, F.col("o_custkey") % 23), F.lit(" guidance "), ks)
    status = (F.when(F.col("o_orderstatus") == "F", F.lit("Final"))
              .when(F.col("o_orderstatus") == "O", F.lit("Draft")).otherwise(F.lit("")))
    closing = F.when(F.col("o_orderstatus") == "O",
                     raw_date_text(k + 5, F.date_add(F.to_date("o_orderdate"), 60))).otherwise(F.lit(""))
    pdf = F.when(k % 4 != 0, F.concat(F.lit("https://www.fda.gov/media/"), ks, F.lit("/download"))).otherwise(F.lit(""))
    return orders.select(
        k.alias("ord"),
        F.lit("FDA").alias("health_authority"),
        name.alias("guidance_name"),
        name.alias("summary"),
        legacy_iso_date(raw_date_text(k, F.col("o_orderdate"))).alias("issue_date"),
        pick(ORGS, F.col("o_custkey") % 4).alias("fda_organization"),
        F.coalesce(F.col("o_orderpriority"), F.lit("")).alias("topic"),
        status.alias("guidance_status"),
        yes_no(pick(ANSWERS, k % 5)).alias("open_for_comment"),
        legacy_iso_date(closing).alias("comment_closing_date_on_draft"),
        pdf.alias("guidance_pdf_link"),
        F.concat(F.lit("https://www.fda.gov/regulatory-information/guidance/"), ks).alias("guidance_page_link"),
        F.concat(F.lit("FDA-"), F.year("o_orderdate").cast("string"), F.lit("-D-"),
                 F.lpad((k % 10000).cast("string"), 4, "0")).alias("docket_number"),
    )
