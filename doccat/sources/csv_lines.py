"""S10 for large files: quoted CSV with line breaks inside fields, read by many tasks.

A reader that honours line breaks in quotes must take a file from its start, so Spark gives it whole to one
task.  Here files are read as lines, in as many splits as they have.  Whether a line begins a record depends
only on how many quotes stand before it in its file, and that is an associative sum: every split counts its
quotes, a prefix sum over the splits says how each begins, and a running sum inside a split does the rest.
Records of one line (almost all) go to ``from_csv`` as they are; only those broken over lines are gathered, by
record.

Fields follow RFC 4180 (a quote in a quoted field is doubled; unquoted fields hold none).  Lines end with LF
or CRLF; in a file whose header ends with CRLF, a CRLF inside a field is read as LF, as the multi-line reader
has it, and line breaks inside fields stay as they are otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_OPTIONS = {"escape": '"', "multiLine": "true"}


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of the file(s) at ``path``, from their first line."""
    names = spark.read.options(header=True, escape='"').csv(path).columns
    return [c.lstrip("\ufeff") for c in names]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, n`` (its place in the split), ``line`` and ``quotes`` of every line."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    return raw.withColumn("quotes", F.length("line") - F.length(F.translate("line", '"', "")))


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, n, record``: the text of every record but the header, placed by its first line."""
    lines = _lines(spark, path)
    # how every split begins: inside quotes or not, and which line of an earlier split the open record began with
    totals = lines.groupBy("file", "split").agg(F.sum("quotes").alias("q"), F.min_by(F.endswith("line", F.lit("\r")), "n").alias("cr"))
    files = Window.partitionBy("file").orderBy("split")
    begins = totals.select("file", "split", ((F.sum("q").over(files) - F.col("q")) % 2).alias("odd"), F.first("cr").over(files).alias("crlf"))
    inside = Window.partitionBy("file", "split").orderBy("n")
    placed = lines.join(begins, ["file", "split"]).withColumn("before", F.sum("quotes").over(inside) - F.col("quotes") + F.col("odd"))
    starts = F.col("before") % 2 == 0
    here = F.struct("split", "n")
    placed = placed.withColumn("start", F.last(F.when(starts, here), ignorenulls=True).over(inside)).withColumn(
        "whole", starts & (F.col("quotes") % 2 == 0))
    last = placed.groupBy("file", "split").agg(F.max(F.when(starts, here)).alias("last"))
    carried = last.select("file", "split", F.last("last", ignorenulls=True).over(files.rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    first = (F.col("split") == 0) & (F.col("n") == F.min("n").over(inside))
    placed = placed.withColumn("head", first)
    whole = placed.filter("whole").select("file", "split", "n", F.col("line").alias("record"), "head")
    broken = placed.filter("NOT whole").join(carried, ["file", "split"]).withColumn("start", F.coalesce("start", "open"))
    line = F.when(F.col("crlf"), F.regexp_replace("line", "\r$", "")).otherwise(F.col("line"))
    joined = broken.groupBy("file", "start").agg(
        F.sort_array(F.collect_list(F.struct("split", "n", line.alias("line")))).alias("parts"), F.max("head").alias("head"))
    joined = joined.select("file", "start.split", "start.n", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"), "head")
    both = whole.unionByName(joined).filter("NOT head")
    record = F.regexp_replace("record", "\r$", "")
    return both.select("file", "split", "n", record.alias("record")).filter(F.trim("record") != "")


def read_large_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of the CSV file(s) at ``path`` as text columns; what ``multiLine`` reads, by any number of tasks.

    Every file starts with a header line; all have the columns of the first.  Missing fields are null.
    """
    names = columns or header_of(spark, path)
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    parsed: Column = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), _OPTIONS)
    return record_texts(spark, path).select(parsed.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
