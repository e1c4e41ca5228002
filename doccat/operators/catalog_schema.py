"""The canonical catalog schema; stamps are UTC wall-clock ``timestamp_ntz``."""

from pyspark.sql.types import (
    BooleanType,
    DateType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_S, _D = StringType(), DateType()

CATALOG_SCHEMA = StructType([
    StructField("id", _S, False),
    StructField("title", _S, False),
    StructField("agency", _S, False),
    StructField("jurisdiction", _S, False),
    StructField("source_page_url", _S), StructField("document_url", _S), StructField("document_format", _S),
    StructField("published_date", _D), StructField("updated_date", _D), StructField("comment_start_date", _D),
    StructField("comment_end_date", _D),
    StructField("status_raw", _S), StructField("status_normalized", _S, False), StructField("sub_status", _S),
    StructField("topic_raw", _S), StructField("topic_normalized", _S), StructField("product_area", _S),
    StructField("summary", _S), StructField("language", _S), StructField("reference_number", _S),
    StructField("content_hash", _S),
    StructField("first_seen_at", TimestampNTZType(), False), StructField("last_seen_at", TimestampNTZType(), False),
    StructField("change_type", _S, False),
    StructField("needs_manual_review", BooleanType(), False),
])
