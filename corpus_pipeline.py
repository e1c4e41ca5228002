"""Corpus pipeline over ``documents``: language ID, quality rules, near duplicates, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them back for the next.  All but the last
return the columns of ``documents``; further columns pass through under any name, as the operators see
only ``doc_id`` and ``text`` by theirs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doccat.llm import langid, packing, parity_join, quality, secret_scan
from doccat.llm.common import materialize, read_table


def _guarded(docs: DataFrame) -> DataFrame:
    """``docs`` with every column but ``doc_id`` and ``text`` under a name that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"input {i}") for i, c in enumerate(docs.columns)])


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of what an operator made of ``_guarded(docs)``."""
    return rows.select(*[F.col(c if c in ("doc_id", "text") else f"`input {i}`").alias(c) for i, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier is sure of.  It is fitted on a bounded sample of
    the labelled documents at hand; texts that are null or have no letter are rejected with the rest.
    Without any label there is no classifier, and every document stays."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    if not model.dictionaries:
        return docs
    return _restored(langid.identify(_guarded(docs), model).filter("NOT lang_rejected"), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base conditions and every rule of the cascade."""
    return _restored(quality.quality_cascade(_guarded(docs)).filter("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest id; repeated rows count as copies,
    and documents without words stay.  A document with a null id cannot be named: it stays."""
    found = parity_join.near_duplicates(docs.select("doc_id", "text"))
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    rows = _guarded(docs)
    same = Window.partitionBy("doc_id", "text").orderBy("doc_id")
    kept = rows.join(first, "doc_id", "left_semi").withColumn("copy", F.row_number().over(same)).filter("copy = 1").drop("copy")
    return _restored(kept.unionByName(rows.filter("doc_id IS NULL")), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret replaced by a mark, and ``n_chars`` counted anew where one was."""
    cleaned = _restored(secret_scan.redact(_guarded(docs)), docs)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.when(F.col("text").contains(secret_scan.MARK), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens: one row per piece, with its token ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("packing", pack),
]

#: SQL has no zstandard dictionaries and no tokenizer; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
