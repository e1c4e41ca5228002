"""Fixed values the catalog semantics depend on.

Everything in this module is data, not logic: keyword lists, ordered rule
tables, header names and literal texts whose exact values decide results.
They are stated plainly, in their natural order, so the classifiers and the
exports built on them give the same answers as the catalog they mirror.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: agencies, jurisdictions and statuses
# ---------------------------------------------------------------------------
AGENCIES = ["FDA", "EMA", "ICH", "CDE", "PMDA"]

JURISDICTION = {
    "FDA": "US",
    "EMA": "EU",
    "ICH": "International",
    "CDE": "China",
    "PMDA": "Japan",
}

STATUSES = [
    "draft",
    "final",
    "open_for_comment",
    "implemented",
    "effective",
    "withdrawn",
    "superseded",
    "unknown",
]

CHANGE_TYPES = ["unknown", "new", "updated", "unchanged"]

NOT_AVAILABLE = "Not available."

# ---------------------------------------------------------------------------
# FIXED VALUES: status rules, first match wins, text = lower(title || ' ' || status_raw)
# Each rule: (agency or None for any, keywords (any of), extra condition, status, sub_status)
# extra condition: None, "end_on_or_after_as_of" (end date present and >= as_of),
# "end_missing_or_on_or_after_as_of".
# ---------------------------------------------------------------------------
STATUS_RULES = [
    (None, ["superseded"], None, "superseded", None),
    (None, ["withdrawn", "废止"], None, "withdrawn", None),
    ("FDA", ["draft"], "end_on_or_after_as_of", "open_for_comment", None),
    ("FDA", ["draft"], None, "draft", None),
    ("FDA", ["final"], None, "final", None),
    ("EMA", ["consultation open", "open consultation"], None, "open_for_comment", None),
    ("EMA", ["draft"], None, "draft", None),
    ("EMA", ["adopted"], None, "effective", None),
    ("EMA", ["final", "scientific guideline"], None, "final", None),
    ("ICH", ["public consultation", "step 2b"], "end_missing_or_on_or_after_as_of", "open_for_comment", None),
    ("ICH", ["step 3"], None, "draft", None),
    ("ICH", ["step 4"], None, "final", None),
    ("ICH", ["step 5"], None, "implemented", None),
    ("CDE", ["公开征求", "征求意见"], None, "open_for_comment", None),
    ("CDE", ["试行"], None, "final", "trial"),
    ("CDE", ["发布", "通告", "颁布"], None, "final", None),
    ("PMDA", ["guidance", "guideline", "notification", "regulatory information"], None, "final", None),
    (None, ["open for comment", "consultation"], None, "open_for_comment", None),
    (None, ["draft"], None, "draft", None),
    (None, ["final"], None, "final", None),
]
STATUS_DEFAULT = "unknown"

# PMDA post-rule: unknown becomes final; titles with this phrase get a sub status.
PMDA_EARLY_CONSIDERATION = "early consideration"
PMDA_EARLY_CONSIDERATION_SUB_STATUS = "early_consideration"

# ---------------------------------------------------------------------------
# FIXED VALUES: topic rules, most specific first, first match wins,
# text = lower(title || ' ' || topic_raw || ' ' || summary)
# ---------------------------------------------------------------------------
TOPIC_RULES = [
    ("estimand_and_missing_data", ["estimand", "intercurrent event", "missing data"]),
    ("adaptive_design", ["adaptive design"]),
    ("bayesian_methods", ["bayesian"]),
    ("master_protocol", ["master protocol", "platform trial", "basket trial", "umbrella trial"]),
    ("external_control", ["external control", "externally controlled"]),
    ("real_world_evidence", ["real-world", "real world", "rwe", "rwd"]),
    ("vaccine_development", ["vaccine", "vaccines", "疫苗"]),
    ("immunogenicity", ["immunogenicity", "免疫原性"]),
    ("safety_pharmacovigilance", ["safety", "pharmacovigilance", "安全性"]),
    ("pediatric_development", ["pediatric", "paediatric", "儿童", "儿科"]),
    ("rare_disease", ["rare disease", "orphan", "罕见病"]),
    ("oncology", ["oncology", "cancer", "tumor", "tumour", "肿瘤"]),
    ("bioequivalence", ["bioequivalence", "生物等效"]),
    ("clinical_pharmacology", ["clinical pharmacology", "pharmacokinetic", "pharmacodynamic"]),
    ("CMC_quality", ["cmc", "quality", "manufacturing", "质量"]),
    ("nonclinical", ["nonclinical", "non-clinical", "toxicology"]),
    ("data_standards", ["data standard", "sdtm", "adam", "define.xml"]),
    ("ICH_implementation", ["ich", "step 5", "implementation"]),
    ("regulatory_procedure", ["submission", "application", "regulatory procedure", "申报"]),
    ("biostatistics", ["biostatistics", "statistical", "statistics", "统计"]),
    ("clinical_trial_design", ["clinical trial", "trial design", "study design", "临床试验"]),
]
TOPIC_DEFAULT = "other"

HIGH_PRIORITY_TOPICS = [
    "biostatistics",
    "clinical_trial_design",
    "estimand_and_missing_data",
    "adaptive_design",
    "bayesian_methods",
    "master_protocol",
    "external_control",
    "real_world_evidence",
    "vaccine_development",
    "immunogenicity",
    "safety_pharmacovigilance",
]

WHY_IT_MATTERS = {
    "biostatistics": "Directly relevant to statistical design, analysis, or review.",
    "clinical_trial_design": "May affect endpoint, population, comparator, or study design decisions.",
    "estimand_and_missing_data": "Important for estimand strategy, intercurrent events, and sensitivity analyses.",
    "adaptive_design": "May affect interim decision rules and operating characteristics.",
    "bayesian_methods": "Relevant to Bayesian borrowing, priors, and decision criteria.",
    "master_protocol": "Relevant to platform, basket, umbrella, or other complex trial structures.",
    "external_control": "Important for externally controlled trial evidence planning.",
    "real_world_evidence": "Relevant to RWE/RWD evidence generation and regulatory acceptability.",
    "vaccine_development": "Directly relevant to vaccine clinical development.",
    "immunogenicity": "Relevant to immune response endpoints and assay interpretation.",
    "safety_pharmacovigilance": "Relevant to safety monitoring and risk management.",
}
WHY_IT_MATTERS_DEFAULT = "Potentially relevant to clinical development review."

# ---------------------------------------------------------------------------
# FIXED VALUES: label humanising
# ---------------------------------------------------------------------------
LABEL_PHRASES = {"open_for_comment": "Open for comment"}
LABEL_ACRONYMS = ["CMC", "FDA", "EMA", "ICH", "CDE", "NMPA", "PMDA", "RWE", "RWD", "MIDD"]
LABEL_SMALL_WORDS = ["and", "for", "in", "of", "on", "or", "the", "to", "with"]

# ---------------------------------------------------------------------------
# FIXED VALUES: dates. Catalog chain (month first), in order; day-first chain
# is tried before the catalog chain for day-first feeds.
# Each entry: (name, Spark pattern, shape regex, two-digit year?)
# ---------------------------------------------------------------------------
MONTHS_FULL = "january|february|march|april|may|june|july|august|september|october|november|december"
MONTHS_ABBR = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"

DATE_FORMATS = [
    ("iso", "yyyy-M-d", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", False),
    ("compact", "yyyyMMdd", r"^[0-9]{8}$", False),
    ("us_long", "M/d/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", False),
    ("us_short", "M/d/yy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", True),
    ("eu_long", "d/M/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", False),
    ("eu_short", "d/M/yy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", True),
    ("month_day_year", "MMMM d, yyyy", r"(?i)^(" + MONTHS_FULL + r") [0-9]{1,2}, [0-9]{4}$", False),
    ("mon_day_year", "MMM d, yyyy", r"(?i)^(" + MONTHS_ABBR + r") [0-9]{1,2}, [0-9]{4}$", False),
    ("day_month_year", "d MMMM yyyy", r"(?i)^[0-9]{1,2} (" + MONTHS_FULL + r") [0-9]{4}$", False),
    ("day_mon_year", "d MMM yyyy", r"(?i)^[0-9]{1,2} (" + MONTHS_ABBR + r") [0-9]{4}$", False),
]
CATALOG_DATE_CHAIN = [f[0] for f in DATE_FORMATS]
DAY_FIRST_CHAIN = ["eu_long", "eu_short"] + CATALOG_DATE_CHAIN
# Legacy record dates: ISO text out, unparseable text kept as is.
LEGACY_MONTH_FIRST_CHAIN = ["us_long", "us_short", "iso"]
LEGACY_DAY_FIRST_CHAIN = ["eu_long", "iso"]
# Python's two-digit year pivot: 69-99 -> 19xx, 00-68 -> 20xx.
TWO_DIGIT_YEAR_PIVOT = 69

MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: yes/no canonicalisation
# ---------------------------------------------------------------------------
YES_VALUES = ["yes", "y", "true", "1"]
NO_VALUES = ["no", "n", "false", "0"]

# ---------------------------------------------------------------------------
# FIXED VALUES: title suffixes carrying a status
# ---------------------------------------------------------------------------
TITLE_STATUS_SUFFIXES = [
    (" - Scientific guideline", "Scientific guideline"),
    (" - Regulatory and procedural guideline", "Regulatory and procedural guideline"),
]
LEGACY_TITLE_STATUS_SUFFIXES = [(" - Scientific guideline", "Scientific guideline")]
TITLE_STATUS_DEFAULT = "Guidance"

# ---------------------------------------------------------------------------
# FIXED VALUES: HTML paragraph boilerplate markers (lower case) and minimum length
# ---------------------------------------------------------------------------
SUMMARY_MIN_CHARS = 80
BOILERPLATE_MARKERS = [
    ".gov means it’s official",
    ".gov means it's official",
    "federal government websites often end in .gov",
    "before sharing sensitive information",
    "guidance document",
    "not for implementation",
    "contains non-binding recommendations",
    "search for fda guidance documents",
    "you can submit online",
    "although you can comment on any guidance at any time",
    "if unable to submit comments online",
    "dockets management",
    "all written comments",
    "omb control number",
    "was this page helpful",
]

# Protection-page markers looked for in the first 5,000 characters.
PROTECTION_PAGE_MARKERS = ["9DhefwqGPrzGxEp9hPaoag", "$_ts"]

# Allowed product areas of the Chinese list feed.
CDE_ALLOWED_PRODUCT_AREAS = ["化学药", "生物制品"]

# ---------------------------------------------------------------------------
# FIXED VALUES: export headers
# ---------------------------------------------------------------------------
CATALOG_EXPORT_COLUMNS = [
    "id", "title", "agency", "jurisdiction", "source_page_url", "document_url",
    "document_format", "published_date", "updated_date", "comment_start_date",
    "comment_end_date", "status_raw", "status_normalized", "sub_status", "topic_raw",
    "topic_normalized", "product_area", "summary", "language", "reference_number",
    "content_hash", "first_seen_at", "last_seen_at", "change_type", "needs_manual_review",
]

# Legacy 12-field record: (field name, export header).
LEGACY_RECORD_FIELDS = [
    ("health_authority", "Health Authority"),
    ("guidance_name", "Guidance Name"),
    ("summary", "Summary"),
    ("issue_date", "Issue Date"),
    ("fda_organization", "FDA Organization"),
    ("topic", "Topic"),
    ("guidance_status", "Guidance Status"),
    ("open_for_comment", "Open for Comment"),
    ("comment_closing_date_on_draft", "Comment Closing Date on Draft"),
    ("guidance_pdf_link", "Guidance PDF Link"),
    ("guidance_page_link", "Guidance Page Link"),
    ("docket_number", "Docket Number"),
]

REPORT_COLUMNS = [
    "Health Authority",
    "Guidance Name",
    "Summary",
    "Issue Date",
    "Organization / Committee",
    "Topic",
    "Guidance Status",
    "Open for Comment",
    "Comment Closing Date on Draft",
    "Document Link",
]
# Report column -> fallback source columns, first non-empty wins.
REPORT_FALLBACKS = {
    "Health Authority": ["Authority"],
    "Organization / Committee": ["FDA Organization", "Authority Organization"],
    "Document Link": ["Guidance PDF Link", "Guidance Page Link"],
}

SELECTED_EXPORT_COLUMNS = [
    "title", "agency", "jurisdiction", "status_normalized", "published_date",
    "updated_date", "comment_end_date", "topic_normalized", "summary",
    "source_page_url", "document_url",
]

DASHBOARD_COLUMNS = [
    "title", "agency", "jurisdiction", "status_normalized", "published_date",
    "updated_date", "comment_end_date", "topic_normalized", "summary", "document_url",
    "source_page_url", "change_type", "needs_manual_review", "last_seen_at",
]

# Fields whose change marks a catalog row as updated.
CHANGE_FIELDS = ["title", "status_normalized", "published_date", "updated_date", "document_url", "summary"]

# Markdown report texts.
REPORT_TITLE = "# Regulatory Guidance Update Report"
REPORT_SECTIONS = [
    ("new", "## New Guidance", "| Agency | Title | Status | Date | Topic | Link |", "|---|---|---|---|---|---|"),
    ("open", "## Open for Comment", "| Agency | Title | Comment End Date | Topic | Link |", "|---|---|---|---|---|"),
    ("priority", "## High Priority for Biostatistics / Vaccine Clinical Development",
     "| Agency | Title | Status | Topic | Why it matters |", "|---|---|---|---|---|"),
]

# Legacy feed constants.
EMA_ORGANIZATION = "European Medicines Agency"
