"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Texts are content-addressed by SHA-256.  The ledger, a folder of Parquet runs, says which rule
versions each blob was scanned with and what they found; a run scans one copy of each blob, and
only with the (rule, version) pairs that the ledger lacks for it, appends its results, and joins
the findings back to every row (path, version) that holds the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccat.llm.common import materialize, shared_path, text_or_empty


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` is matched leftmost and non-overlapping; a match counts if group ``group`` has
    ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order of ties; then the kinds that the method adds.
BASE_RULES = (
    SecretRule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    SecretRule("access", r"AKIA[A-Z0-9]+", 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    SecretRule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
#: What redaction puts in a secret's place.
MARK = "[SECRET]"
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def spans_of(text: Column, rule: SecretRule, kind_no: int) -> Column:
    """Spans of one rule in code points, end exclusive: the gaps between matches and the matches
    themselves, laid end to end; ``kind`` holds the rule's key.  Texts without a match skip it all."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(hits, F.length).alias("hit"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length).alias("part"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), (start + x["hit"]).alias("end"), F.lit(rule.key).alias("kind"))
        out = F.when(x["part"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((start + F.coalesce(x["hit"], F.lit(0))).alias("at"), out.alias("out"))

    found = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPAN))


def update_ledger(blobs: DataFrame, ledger: str, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Scan ``blobs`` (blob, text; rows may repeat) for the pairs that ``ledger`` lacks, append the
    run, and return the ledger's findings: blob, spans.

    One copy of a blob is kept per map task before the shuffle, so groups of copies stay small.
    """
    spark = blobs.sparkSession
    keys = [r.key for r in rules]
    one = Window.partitionBy("blob").orderBy("blob")
    todo = blobs.select("blob", "text", F.row_number().over(one).alias("_n")).filter("_n = 1").drop("_n")
    known = _read(spark, ledger)
    if known is None:
        todo = todo.withColumn("rules", F.array(*[F.lit(k) for k in keys]))
    else:
        seen = known.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn(
            "rules", F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("rules") > 0)
    spans = F.concat(*[F.when(F.array_contains("rules", r.key), spans_of(F.col("text"), r, i + 1)).otherwise(F.array().cast(SPAN))
                       for i, r in enumerate(rules)])
    todo.select("blob", "rules", spans.alias("spans")).write.parquet(f"{ledger.rstrip('/')}/run={uuid.uuid4().hex[:12]}")
    found = _read(spark, ledger).filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).filter(F.col("s.kind").isin(keys))
    # the ledger names the rule and its version; what another version found is not reported
    span = F.struct(F.col("s.start").alias("start"), F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("s.kind")).cast("int").alias("kind_no"),
                    F.col("s.end").alias("end"), F.substring_index("s.kind", "@", 1).alias("kind"))
    return found.select("blob", span.alias("s")).groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def _read(spark, ledger: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(f"blob binary, rules array<string>, spans {SPAN}").parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows with ``blob`` (SHA-256 of the text, null as empty) and ``spans``, ordered by start and
    then kind; an empty array where nothing is found.

    ``ledger``: the folder of earlier runs; a fresh shared folder if none is named.  Input columns
    named blob or spans are replaced.  Copies share one scan; repeated rows all return; an empty
    table gives no rows.
    """
    rows = _joined(docs.drop("blob", "spans"), ledger, rules, text_col)
    return rows.withColumnsRenamed({"_blob": "blob", "_spans": "spans"})


def _joined(docs: DataFrame, ledger: str | None, rules: tuple[SecretRule, ...], text_col: str) -> DataFrame:
    """The rows with ``_blob`` and ``_spans``."""
    ledger = ledger or shared_path(docs.sparkSession, "ledger")
    blob = F.unhex(F.sha2(text_or_empty(text_col), 256))
    found = update_ledger(docs.select(blob.alias("blob"), text_or_empty(text_col).alias("text")), ledger, rules)
    # A written table of the few findings: where its size allows, the texts stay where they are.
    found = materialize(found.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans")), "findings")
    return docs.withColumn("_blob", blob).join(found, "_blob", "left").withColumn("_spans", F.coalesce("_spans", F.array().cast(SPAN)))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = MARK, ledger: str | None = None) -> DataFrame:
    """The rows with every found span of the text replaced by ``mark`` (overlapping spans by one).

    Null texts stay null; other columns stay as they are.
    """
    found = _joined(docs, ledger, RULES, text_col)
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    cut = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                      lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("_spans") > 0, cut).otherwise(text)).select(docs.columns)
