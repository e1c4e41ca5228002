"""Completeness and coverage audits (A7, A9, A10, A11, U2) and metrics kept from the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def completeness(parsed_counts: DataFrame, declared: DataFrame, external: DataFrame) -> DataFrame:
    """Per source, declared total vs parsed rows vs an external count.

    ``declared`` (source, declared_total) may hold nulls: the parsed count then
    stands in.  No external count -> 'unverified'; any difference -> 'mismatch'.
    All three inputs are per-source aggregates, so the joins are on tiny frames.
    """
    j = parsed_counts.join(declared, "source", "full_outer").join(external, "source", "left")
    declared_or_parsed = F.coalesce(F.col("declared_total"), F.col("parsed"))
    verdict = (F.when(F.col("external_count").isNull(), F.lit("unverified"))
               .when((declared_or_parsed != F.col("external_count")) | (F.col("parsed") != F.col("external_count")),
                     F.lit("mismatch"))
               .otherwise(F.lit("ok")))
    return j.select("source", F.coalesce("parsed", F.lit(0)).alias("parsed"), "declared_total", "external_count",
                    verdict.alias("verdict"))


def link_coverage(catalog: DataFrame) -> DataFrame:
    """Per agency rows with a document URL and all rows."""
    has = F.coalesce(F.col("document_url"), F.lit("")) != ""
    return catalog.groupBy("agency").agg(F.count_if(has).alias("with_document_url"), F.count(F.lit(1)).alias("rows"))


def future_dates(catalog: DataFrame, as_of: str) -> DataFrame:
    """A10: rows per agency whose published date lies after ``as_of``."""
    return catalog.groupBy("agency").agg(
        F.count_if(F.col("published_date") > F.lit(as_of).cast("date")).alias("future_rows"),
        F.count(F.lit(1)).alias("rows"))


def overlap_report(a_keys: DataFrame, b_keys: DataFrame) -> DataFrame:
    """|A|, |B|, |A n B| and unique = |A| + |B| - |A n B| over distinct keys (one row)."""
    a = a_keys.select(F.col("key")).distinct().withColumn("_a", F.lit(1))
    b = b_keys.select(F.col("key")).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, "key", "full_outer")
    return j.agg(F.count("_a").alias("list_a"), F.count("_b").alias("list_b"),
                 F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("overlap"),
                 F.count(F.lit(1)).alias("unique_keys"))


def facet_cube(catalog: DataFrame, facets: list[str]) -> DataFrame:
    """A11 with A4: rows for every combination of the facets and every roll-up of it; ``level`` is the grouping id
    (a bit is set where a facet is rolled up), which tells a roll-up's null from a row's own."""
    return catalog.cube(*facets).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level")).select(*facets, "level", "n")


def metrics_from_log(log: DataFrame) -> DataFrame:
    """A2, A9 and A12 per version and agency, from the change log (rows with ``version``) alone.

    Every logged row adds itself and takes back the row of its id that it replaces; the signed sums are
    accumulated over the versions.  Only the log's rows are shuffled, by id, and an id's rows are one per run it
    appeared in; what follows has one row per version and agency.  The latest stamp of an agency is the version's
    own, as every row of a run carries it, or the last before.
    """
    versions = Window.partitionBy("id").orderBy("version")
    facts = F.struct("agency", F.when(F.coalesce("document_url", F.lit("")) != "", 1).otherwise(0).alias("linked"), "change_type")
    pairs = log.select("id", "version", "last_seen_at", facts.alias("now")).withColumn("was", F.lag("now").over(versions))
    signed = pairs.select("version", "last_seen_at", F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), F.col("now").alias("x")), F.struct(F.lit(-1).alias("sign"), F.col("was").alias("x")))).alias("d"))
    signed = signed.filter("d.x IS NOT NULL").select("version", "last_seen_at", "d.sign", "d.x.*")
    def of(kind: str):
        return F.sum(F.when(F.col("change_type") == kind, F.col("sign")).otherwise(0))
    deltas = signed.groupBy("version", "agency").agg(
        F.sum("sign").alias("rows"), F.sum(F.col("sign") * F.col("linked")).alias("with_document_url"), of("new").alias("new_rows"),
        of("updated").alias("updated_rows"), of("unchanged").alias("unchanged_rows"),
        F.max(F.when(F.col("sign") == 1, F.col("last_seen_at"))).alias("last_seen_at"))
    known = log.select("version").distinct().join(log.groupBy("agency").agg(F.min("version").alias("since")), F.col("version") >= F.col("since"))
    all_rows = known.select("version", "agency").join(deltas, ["version", "agency"], "left")
    so_far = Window.partitionBy("agency").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in ("rows", "with_document_url", "new_rows", "updated_rows", "unchanged_rows")]
    return all_rows.select("version", "agency", *sums, F.max("last_seen_at").over(so_far).alias("last_seen_at")).filter("rows > 0")
