"""Exports (K1-K6, S10, S13): CSV, JSON lines, Markdown lines, dashboard payload, selections.

Every export is first a DataFrame projection (what the driver compares), then
an optional distributed write; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doccat.functions.rules import (
    CATALOG_EXPORT_COLUMNS,
    HIGH_PRIORITY_TOPICS,
    LEGACY_RECORD_FIELDS,
    REPORT_COLUMNS,
    REPORT_SECTIONS,
    REPORT_TITLE,
    SELECTED_EXPORT_COLUMNS,
    WHY_IT_MATTERS,
    WHY_IT_MATTERS_DEFAULT,
)
from doccat.functions.text import md_escape
from doccat.sources.csv_lines import read_large_csv


def falsy_to_text(c: Column, dtype: T.DataType) -> Column:
    """Python ``str(value or '')``: null/False/'' -> '', True -> 'True', dates ISO, stamps 'Y-m-d H:M:S[.f]'."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit(""))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        frac = F.date_format(c, "SSSSSS")
        txt = F.when(frac != "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(
            F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
        return F.coalesce(txt, F.lit(""))
    if isinstance(dtype, (T.IntegralType, T.FractionalType)):
        return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


def catalog_csv_rows(catalog: DataFrame) -> DataFrame:
    """K1: the 25 export columns as text, falsy values empty."""
    types = {f.name: f.dataType for f in catalog.schema.fields}
    return catalog.select(*[falsy_to_text(F.col(c), types[c]).alias(c) for c in CATALOG_EXPORT_COLUMNS])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Distributed CSV write with a header line and '\\n' line ends (K1, K2); blanks stay, empty cells are empty."""
    (df.write.mode(mode).option("header", True).option("lineSep", "\n").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "")
     .option("quoteAll", False).csv(path))


def legacy_csv_rows(records: DataFrame) -> DataFrame:
    """K2: the 12 legacy fields under their export headers, in order."""
    return records.select(*[F.col(f).alias(h) for f, h in LEGACY_RECORD_FIELDS])


def json_lines(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """K3: one JSON object per record, snake_case keys, non-ASCII kept (JSON lines, not one array)."""
    obj = F.to_json(F.struct(*[F.col(f) for f, _h in LEGACY_RECORD_FIELDS]), {"ignoreNullFields": "false"})
    return records.select(*(keep or []), obj.alias("json"))


def _link(doc_url: Column, page_url: Column) -> Column:
    url = F.coalesce(F.when(doc_url != "", doc_url), F.when(page_url != "", page_url), F.lit(""))
    return F.when(url != "", F.concat(F.lit("[Link]("), url, F.lit(")"))).otherwise(F.lit(""))


def _txt(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def markdown_lines(spark: SparkSession, catalog: DataFrame, generated_at: str) -> DataFrame:
    """K4: report lines as (section, ord, line); ``ord`` orders lines inside a section.

    Section rows come straight from the catalog (new / open / high priority);
    headings and the five counters are a handful of extra rows.  Writing
    ``orderBy(section, ord)`` as text gives the report file.
    """
    a, t = F.col("agency"), md_escape(F.col("title"))
    link = _link(F.col("document_url"), F.col("source_page_url"))
    why = F.coalesce(F.element_at(F.create_map(*[x for k, v in WHY_IT_MATTERS.items() for x in (F.lit(k), F.lit(v))]),
                                  F.coalesce(F.col("topic_normalized"), F.lit(""))), F.lit(WHY_IT_MATTERS_DEFAULT))
    new_line = F.concat_ws(" | ", F.concat(F.lit("| "), a), t, F.col("status_normalized"), _txt(F.col("published_date")),
                           _txt(F.col("topic_normalized")), F.concat(link, F.lit(" |")))
    open_line = F.concat_ws(" | ", F.concat(F.lit("| "), a), t, _txt(F.col("comment_end_date")),
                            _txt(F.col("topic_normalized")), F.concat(link, F.lit(" |")))
    pri_line = F.concat_ws(" | ", F.concat(F.lit("| "), a), t, F.col("status_normalized"), _txt(F.col("topic_normalized")),
                           F.concat(md_escape(why), F.lit(" |")))
    # one pass over the catalog: each row yields its (at most three) section lines
    per_row = F.filter(F.array(
        F.when(F.col("change_type") == "new", F.struct(F.lit(1).alias("section"), new_line.alias("line"))),
        F.when(F.col("status_normalized") == "open_for_comment", F.struct(F.lit(2).alias("section"), open_line.alias("line"))),
        F.when(F.col("topic_normalized").isin(HIGH_PRIORITY_TOPICS), F.struct(F.lit(3).alias("section"), pri_line.alias("line")))),
        lambda x: x.isNotNull())
    rows = catalog.select(F.col("ord"), F.explode(per_row).alias("x")).select(
        F.col("x.section").alias("section"), "ord", F.col("x.line").alias("line"))
    counts = catalog.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("change_type") == "new").alias("new"),
        F.count_if(F.col("change_type") == "updated").alias("updated"),
        F.count_if(F.col("status_normalized") == "open_for_comment").alias("open"),
        F.count_if(F.col("topic_normalized").isin(HIGH_PRIORITY_TOPICS)).alias("hp"))
    labels = [("total", "Total documents"), ("new", "New documents"), ("updated", "Updated documents"),
              ("open", "Open for comment"), ("hp", "High-priority documents")]
    summary = counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.concat(F.lit(f"- {label}: "), F.col(k).cast("string")).alias("line"))
        for i, (k, label) in enumerate(labels, start=4)])).alias("x")).select(
        F.lit(0).alias("section"), F.col("x.ord").cast("long").alias("ord"), F.col("x.line").alias("line"))
    fixed = [(0, 0, REPORT_TITLE), (0, 1, f"Generated at: {generated_at}"), (0, 2, ""), (0, 3, "## Executive Summary")]
    for i, (_k, heading, cols, sep) in enumerate(REPORT_SECTIONS, start=1):
        fixed += [(i, -4, ""), (i, -3, heading), (i, -2, cols), (i, -1, sep)]
    fixed.append((len(REPORT_SECTIONS) + 1, 0, ""))
    fixed_df = spark.createDataFrame(fixed, "section int, ord long, line string")
    return fixed_df.unionByName(summary.select(F.col("section").cast("int"), "ord", "line")).unionByName(rows)


def html_payload_rows(report_rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """K5: each report row as a JSON object safe inside a <script> tag ('</' -> '<\\/')."""
    obj = F.to_json(F.struct(*[F.col(f"`{c}`") for c in REPORT_COLUMNS]), {"ignoreNullFields": "false"})
    return report_rows.select(*(keep or []), F.replace(obj, F.lit("</"), F.lit("<\\/")).alias("row_json"))


def selected_rows(indexed: DataFrame, selection: DataFrame, broadcast_limit: int = 100_000) -> DataFrame:
    """K6: rows at the selected positions (``row_idx``), in selection order, duplicates kept.

    ``selection`` (pick, value) holds raw user picks; non-integers and out-of-range
    positions drop out through the inner join.  Only the export columns present
    are kept.  A selection of up to ``broadcast_limit`` rows is broadcast, a larger one shuffled.
    """
    sel = selection.select("pick", F.expr("try_cast(value AS BIGINT)").alias("row_idx")).filter(
        F.col("row_idx").isNotNull())
    cols = [c for c in SELECTED_EXPORT_COLUMNS if c in indexed.columns]
    sel = F.broadcast(sel) if selection.count() <= broadcast_limit else sel
    return indexed.join(sel, "row_idx").select("pick", *cols)


def with_row_index(df: DataFrame, order_col: str, name: str = "row_idx") -> DataFrame:
    """Dense 0-based position by ``order_col`` without a single-partition window.

    Global sort (range partitioned), then per-partition counts turned into
    offsets on a frame of one row per partition (bounded by the partition
    count, so broadcasting it is safe).  The sorted frame is checkpointed to
    the shared checkpoint folder so both uses see the same partitioning.
    """
    from doccat.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    s = df.orderBy(order_col).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id())
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    from pyspark.sql import Window
    offsets = counts.select("_pid", (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_off"))
    j = s.join(F.broadcast(offsets), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return j.withColumn(name, F.col("_off") + local).drop("_pid", "_mid", "_off")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file at ``path`` (a file or a folder of files)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return max((s.getLen() for s in listed), default=0)


def read_csv_exports(spark: SparkSession, paths: list[str], split_bytes: int = 64 << 20) -> tuple[DataFrame | None, list[str]]:
    """S10 + U4: read the CSV exports that exist (header, line breaks in quotes, UTF-8 BOM tolerated), union by name.

    Inputs with a file of more than ``split_bytes`` are read by many tasks a file (``sources.csv_lines``).

    Returns the union (None when no input exists) and the missing paths.
    """
    frames, missing = [], []
    for p in paths:
        if not path_exists(spark, p):
            missing.append(p)
            continue
        if largest_file(spark, p) > split_bytes:
            df = read_large_csv(spark, p)
        else:  # one task reads the file either way
            df = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(p)
            df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
        df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
        frames.append(df)
    if not frames:
        return None, missing
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out, missing


def bootstrap_from_snapshot(spark: SparkSession, target: str, snapshot: str) -> bool:
    """Copy the snapshot table to ``target`` only when the target is absent and the snapshot exists."""
    if path_exists(spark, target) or not path_exists(spark, snapshot):
        return False
    spark.read.parquet(snapshot).write.mode("errorifexists").parquet(target)
    return True
