"""The pipeline's stages: what they keep, and that their decisions take effect."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from doccat.llm import quality, secret_scan


def test_stages_on_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == columns
        got = spark.createDataFrame(out.collect(), docs.schema)
        assert got.count() == got.select("doc_id").distinct().count() <= docs.count(), name
        docs = got
    last = {r.doc_id: r for r in docs.collect()}
    assert 0 < len(last) < len(rows)
    texts = [r.text for r in last.values()]
    assert len(set(texts)) == len(texts)
    changed = [r for i, r in last.items() if r.text != rows[i].text]
    assert all(secret_scan.MARK in r.text and r.n_chars == len(r.text) for r in changed)
    assert quality.quality_cascade(spark.createDataFrame([rows[i] for i in last])).filter("NOT kept").count() == 0
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    for i, r in last.items():
        ids = [x for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start) for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert ids == tok.encode(r.text, add_special_tokens=False).ids + [0]


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = " ".join(f"alpha{chr(97 + i % 26)}{chr(97 + i // 26)} beta" for i in range(60))
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (3, clean, "en", "s", len(clean)), (3, clean, "en", "s", len(clean)),
            (None, clean, None, "s", None), (4, "x" * 50000, "en", "s", 50000), (5, "password=abcdefgh " + clean, "en", "s", None)]
    for table in (rows, rows[:0]):
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, "").collect(), schema)
        ids = [r.doc_id for r in docs.collect()]
        assert ids.count(3) == (1 if table else 0)
        corpus_pipeline.pack(spark, docs, "").collect()


CLASHES = ["words", "_at", "_lines", "_windows", "_pairs", "kept", "n_words", "_copy", "copy", "lang_pred", "lang_rejected", "_blob", "blob", "spans", "_spans",
           "rejected_by", "cls", "component_id", "a.b"]


def test_stages_pass_clashing_columns_through(spark):
    clean = [" ".join(f"alpha{chr(97 + (i * k) % 26)}{chr(97 + i // 26)} beta" for i in range(60)) for k in (1, 3, 5)]
    rows = [(i, t, "en", "s", len(t), *[f"{c}-{i}" for c in CLASHES]) for i, t in enumerate(clean + ["password=abcdefgh " + clean[0][::-1]])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), schema)
        got = docs.collect()
        assert got and docs.columns[5:] == CLASHES, name
        for r in got:
            assert [r[c] for c in CLASHES] == [f"{c}-{r.doc_id}" for c in CLASHES], name
