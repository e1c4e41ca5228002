"""Named queries of the operators: thin digests of their real outputs, over whole tables."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.llm import (ann, chat, filter_audit, langid, packing, parity_join, pieces, quality, runs, secret_scan, sharding, sql,
                        warc, wavelet)
from doccat.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wavelet.token_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_cascade(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(read_table(spark, sf_dir, "conversations"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secret_scan.BASE_RULES]

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"),
                        secret_scan.span_list(F.col("spans")).alias("spans"))


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    got = sharding.shard_by_bytes(rows, "size", ["doc_id"], 8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(docs.filter(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pieces.encode_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), "round_trip")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(read_table(spark, sf_dir, "documents"), rewrite=runs.plant_period)
    return found.drop("runs")


def op12_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(read_table(spark, sf_dir, "pages"), "page_id", "html", "url", least_bytes=0)
    return records.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``corpus_pipeline.run``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_SHIPPED: set[str] = set()


def _shipped(query: Query) -> Query:
    """The query with this package sent to the executors once per application (``addPyFile``), so that
    its tasks can import it wherever they run."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        if context.applicationId not in _SHIPPED:
            top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
            archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "doccat"), "zip", top, "doccat")
            context.addPyFile(archive)
            _SHIPPED.add(context.applicationId)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "op1_pack": op1_pack,
        "op2_wavelet_shards": op2_wavelet_shards,
        "op3_quality": op3_quality,
        "op4_chat": op4_chat,
        "op5_secrets": op5_secrets,
        "op6_parity_join": op6_parity_join,
        "op7_shard": op7_shard,
        "op8_language": op8_language,
        "op9_neighbours": op9_neighbours,
        "op10_pieces": op10_pieces,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_warc_chunks": op12_warc_chunks,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": pipeline,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
