"""Inline demo rows (S12): normalised like crawled rows, filtered by agency set (empty = all)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.functions.classify import status_columns, topic_column
from doccat.functions.dates import parse_date

SEED_COLUMNS = ["title", "agency", "jurisdiction", "status_raw", "published_date", "comment_end_date",
                "topic_raw", "summary", "language", "source_page_url"]

# FIXED VALUES: the nine demo rows, in order (title, agency, jurisdiction, status_raw, published_date,
# comment_end_date, topic_raw, summary, language, source_page_url).
SEED_ROWS = [
    ("Adaptive Designs for Clinical Trials of Drugs and Biologics", "FDA", "US", "Final", "2019-11-01", None,
     "Clinical Trials", "[Seed/demo data] FDA guidance example for adaptive clinical trial design.", None,
     "https://www.fda.gov/regulatory-information/search-fda-guidance-documents"),
    ("E9(R1) Statistical Principles for Clinical Trials: Addendum on Estimands and Sensitivity Analysis", "ICH",
     "International", "Step 4", "2019-11-20", None, "Biostatistics",
     "[Seed/demo data] ICH estimand and missing data guidance relevant to trial objectives.", None,
     "https://www.ich.org/page/efficacy-guidelines"),
    ("ICH E20 Adaptive Clinical Trials - Public Consultation", "ICH", "International", "Step 2b public consultation",
     "2025-05-15", "2025-08-15", "Adaptive Design",
     "[Seed/demo data] Public consultation example for adaptive clinical trials.", None,
     "https://www.ich.org/page/public-consultations"),
    ("Guideline on clinical evaluation of vaccines", "EMA", "EU", "Scientific guideline adopted", "2023-02-10", None,
     "Vaccines", "[Seed/demo data] EMA vaccine clinical development guidance example.", None,
     "https://www.ema.europa.eu/en/human-regulatory-overview/research-development/scientific-guidelines"),
    ("Open consultation on real-world evidence for medicines development", "EMA", "EU", "Consultation open",
     "2026-01-10", "2026-09-30", "Real World Evidence",
     "[Seed/demo data] EMA open consultation example for RWE/RWD.", None,
     "https://www.ema.europa.eu/en/news-events/open-consultations"),
    ("关于公开征求疫苗临床试验技术指导原则意见的通知", "CDE", "China", "公开征求意见", "2026-03-01", "2026-07-01",
     "疫苗 临床试验", "[Seed/demo data] CDE vaccine clinical trial consultation example.", "ZH",
     "https://www.cde.org.cn/"),
    ("关于发布药物临床试验统计学指导原则的通告", "CDE", "China", "发布 通告", "2024-10-20", None, "统计 临床试验",
     "[Seed/demo data] CDE biostatistics guidance example.", "ZH", "https://www.cde.org.cn/"),
    ("Pediatric Development of Vaccines", "FDA", "US", "Draft", "2026-02-01", "2026-10-01", "Vaccines",
     "[Seed/demo data] Draft vaccine pediatric development guidance example.", None,
     "https://www.fda.gov/regulatory-information/search-fda-guidance-documents"),
    ("Use of Bayesian Methods in Medical Product Development", "FDA", "US", "Final", "2022-12-01", None,
     "Biostatistics", "[Seed/demo data] Bayesian methods example for statistical review.", None,
     "https://www.fda.gov/regulatory-information/search-fda-guidance-documents"),
]


def seed_documents(spark: SparkSession, agencies: list[str] | None, as_of: str) -> DataFrame:
    """Normalised demo rows of the wanted agencies (None or empty = all)."""
    raw = spark.createDataFrame(SEED_ROWS, SEED_COLUMNS).withColumn("ord", F.monotonically_increasing_id())
    if agencies:
        raw = raw.filter(F.upper("agency").isin([a.upper() for a in agencies]))
    x = raw.select(
        "ord", "title", "agency", "jurisdiction", "status_raw", "topic_raw", "summary", "source_page_url",
        F.coalesce("language", F.lit("EN")).alias("language"),
        parse_date(F.col("published_date")).alias("published_date"),
        parse_date(F.col("comment_end_date")).alias("comment_end_date"))
    st, sub = status_columns(F.col("title"), F.col("status_raw"), F.col("agency"), F.col("comment_end_date"), as_of)
    return x.select("*", st.alias("status_normalized"), sub.alias("sub_status"),
                    topic_column(F.col("title"), F.col("topic_raw"), F.col("summary")).alias("topic_normalized"),
                    F.lit(True).alias("needs_manual_review"))
