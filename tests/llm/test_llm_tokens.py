"""Packing, wavelet shards, SentencePiece codec: round trips and library parity on small rows."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from doccat.llm import packing, pieces, tokens, wavelet

ODD = ["a  b\n\nc.", " lead", "trail ", "x\ty", "Don't stop. it's 12,5 e.g. (ok)!, ÉÀ×ñ ﬁ İstanbul é ñ日本 語 😀.", "...", "a.\n b",
       "<|endoftext|> x <|startoftext|>", "  ", "\n", " x  ", "word.,", "A,b", "ΑΣ ΟΔΟΣ.", "", "\x1fx y", "tab\t\tend", "nbsp  x",
       "long " * 3000, "x" * 5000]
ROWS = [(1, "Hello there, world."), (2, None), (3, ""), (4, "Hello there, world."), (4, "Hello there, world."), (None, "no id"),
        (5, "word " * 2500), (6, "tail " * 600)] + [(10 + i, "some text of length " * (i % 37)) for i in range(120)]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_chunked_ids_equal_whole_text_ids(name, kind):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    got = tokens.ChunkEncoder(path, kind).encode(ODD)
    assert [list(x) for x in got] == [e.ids for e in whole.encode_batch(ODD, add_special_tokens=False)]


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_returning_chunks_are_not_learnt_again(name, kind, monkeypatch):
    """A full cache keeps what returns: one generation is dropped at a time, and only if none of its chunks came back."""
    path = public_tokenizers.path(name)
    whole, enc, learnt = Tokenizer.from_file(path), tokens.ChunkEncoder(path, kind), []
    whole.encode_special_tokens = True
    plain = tokens.ChunkEncoder._word
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 8)
    monkeypatch.setattr(tokens.ChunkEncoder, "_word", lambda self, w: learnt.append(w.strip()) or plain(self, w))
    for i in range(12):  # new words every time, and two that return
        texts = [" ".join(["always", *(f"w{'abcdefghijkl'[i]}{c}" for c in "qrstu"), "again."]), *ODD[:3]]
        got = enc.encode(texts)
        assert [list(x) for x in got] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert len(enc.cache) <= 8 + 20 and len(enc.older) <= 8 + 20
    assert learnt.count("always") == 1 and learnt.count("again") == 1 and learnt.count("waq") == 1


def test_letters_are_lowered_before_words_are_told_apart(monkeypatch):
    """Words that differ in case alone are learnt once; a letter with a mark composes as the library has it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, enc, learnt = Tokenizer.from_file(path), tokens.ChunkEncoder(path, "word"), []
    whole.encode_special_tokens = True
    plain = tokens.ChunkEncoder._word
    monkeypatch.setattr(tokens.ChunkEncoder, "_word", lambda self, w: learnt.append(w) or plain(self, w))
    for texts in (["Trial TRIAL trial tRIAL"], ["H\u0331 h\u0331 A\u030angstrom I\u0307 K\u0327\u0301 DON'T"], ["\u0130X <|STARTOFTEXT|> \u212a \u00c5B"]):
        assert [list(x) for x in enc.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [w.lower() for w in learnt].count("trial") == 1


def test_an_encoder_outlives_its_task(spark):
    """The second of two tasks of one worker finds the chunks of the first."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string")

    def known(batches):
        enc = tokens.encoder(path, "byte")
        list(batches)
        import pyarrow as pa
        yield pa.record_batch([pa.array([len(enc.cache)], pa.int64())], names=["n"])

    packing.pack_documents(docs.coalesce(1), path).collect()
    found = [r[0] for r in spark.range(64).repartition(16).mapInArrow(known, "n long").collect()]
    assert max(found) > 1


def test_best_fill_is_exhaustive_optimum():
    rng = np.random.default_rng(5)
    for _ in range(60):
        items = rng.integers(1, 20, size=rng.integers(1, 9)).tolist()
        target = int(rng.integers(1, 40))
        counts = {x: items.count(x) for x in items}
        used = packing.best_fill(counts, target)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= target}
        assert sum(k * v for k, v in used.items()) == max(sums)
        assert all(v <= counts[k] for k, v in used.items())


def _docs(spark, rows=ROWS):
    # clashing and extra columns must not matter
    return spark.createDataFrame([(i, t, "x", 1, 7) for i, t in rows], "doc_id long, text string, start string, length int, offset long")


def test_packing_covers_every_id_once_without_padding(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ROWS]
    got = packing.pack_documents(_docs(spark).coalesce(2), path, block_items=16).collect()
    by_doc, sequences = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4
    for i, ids in {(i, tuple(x)) for i, x in want}:
        n = sum(1 for j, x in want if (j, tuple(x)) == (i, ids))
        same = sorted(by_doc[i, len(ids)])
        at = [s for s, _ in same]
        assert sum(len(x) for _, x in same) == n * len(ids)
        for s, x in same:
            assert list(ids[s:s + len(x)]) == x
        assert at.count(0) == n
    padding = 0
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    assert padding == 0
    assert packing.pack_documents(_docs(spark, ROWS[:0]), path).collect() == []


def test_wavelet_matrix_access_count_occurrence():
    rng = np.random.default_rng(3)
    for n, bits in ((0, 4), (1, 1), (700, 3), (5000, 16)):
        ids = rng.integers(0, 1 << bits, size=n).astype(np.uint16)
        wm, _ = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, np.array([n]), bits).to_bytes({"keys": [1]}))
        assert (wm.decode() == ids).all()
        for i in range(0, n, 97):
            assert wm.access(i) == ids[i]
            value = int(ids[i])
            at = np.flatnonzero(ids == value)
            assert wm.count(value) == len(at)
            assert wm.count(value, i, n) == int((at >= i).sum())
            k = int((at < i).sum())
            assert wm.occurrence(value, k) == i
        with pytest.raises(IndexError):
            wm.occurrence(0, n + 1)


def test_wavelet_shards_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = wavelet.token_shards(_docs(spark), path, shard_ids=300).collect()
    want = sorted(((i is not None, i or 0), tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ROWS)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    keyed = sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert keyed == want
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert wavelet.token_shards(_docs(spark, ROWS[:0]), path).collect() == []


def test_pieces_equal_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in ODD if "\x1f" not in t] + ["a" + " " * n + "b" for n in range(1, 40)] + [";\r\n x", "日本語\n\n▁ mark", "<s> </s> <unk>"]
    codec = pieces.PieceCodec(path)
    got = codec.encode(texts)
    assert [list(x) for x in got] == sp.encode(texts)
    assert [codec.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]
    assert [codec.decode(x) for x in got] == [sp.decode(x.tolist()) for x in got]
    plain = "Plain words, nothing else."
    assert codec.tokenizer.decode(codec.encode([plain])[0].tolist()) == plain
    rows = pieces.encode_pieces(_docs(spark), path)
    back = pieces.decode_pieces(rows, path)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in ROWS)
    assert all(r.round_trip and zlib.crc32(r.ids) >= 0 for r in rows.collect())
    assert pieces.encode_pieces(_docs(spark, ROWS[:0]), path).collect() == []


def _unigram_model(tmp_path, byte_fallback):
    """A hand-written unigram model file: no training."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type = pieces.UNIGRAM
    m.trainer_spec.byte_fallback = byte_fallback
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = False
    listed = [("<unk>", 0, pieces.UNKNOWN), ("<s>", 0, pieces.CONTROL), ("</s>", 0, pieces.CONTROL)]
    listed += [(f"<0x{b:02X}>", 0, pieces.BYTE) for b in range(256)] if byte_fallback else []
    listed += [(p, s, pieces.NORMAL) for p, s in (("▁", -2), ("a", -3), ("b", -3.2), ("c", -3.4), ("ab", -4), ("▁ab", -4.5), ("bc", -4.1), ("▁a", -4.2), ("cab", -5))]
    for p, s, k in listed:
        x = m.pieces.add()
        x.piece, x.score, x.type = p, s, k
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_models(tmp_path, byte_fallback):
    import sentencepiece

    path = _unigram_model(tmp_path, byte_fallback)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = pieces.PieceCodec(path)
    texts = ["abc cab", "aabbcc ab", "x é ab", "", " a", "cabcab  b"]
    assert [list(x) for x in codec.encode(texts)] == sp.encode(texts)


def test_runs_of_one_character_need_no_repair():
    """The rebuilt merges give SentencePiece's own ids where a piece comes of several merges."""
    codec = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    made = [head + ch * n + tail for ch in " =-.*_#ao0\t\n~/" for n in range(1, 90) for head, tail in (("", ""), (" ", ""), ("", "word"), (" x", "y"))]
    got = [e.ids for e in codec.tokenizer.encode_batch_fast(made, add_special_tokens=False)]
    assert got == codec.verifier.encode(made)


def test_a_difference_from_sentencepiece_is_an_error(monkeypatch):
    codec = pieces.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))

    class Other:
        def encode(self, texts, num_threads=1):
            return [[0] for _ in texts]

    monkeypatch.setattr(codec, "verifier", Other())
    with pytest.raises(ValueError):
        codec.encode(["one text"])
