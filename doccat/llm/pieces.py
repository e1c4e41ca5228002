"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model protobuf is parsed and rebuilt: normaliser (precompiled map, white-space rules), the
metaspace marker, unigram scores or the merges that BPE scores imply, and byte fallback.  Chunks that
no piece can span are encoded once per worker, in multithreaded batches; each new chunk is verified
against SentencePiece itself, and any difference is an error.

One piece may come of several merges (runs of one character); SentencePiece takes the leftmost, the library
the one listed first.  Listing those with the longer left part first gives the same pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm import tokens
from doccat.llm.common import text_or_empty

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
_CUT = "\x1f"
_BEFORE_SPACE = re.compile(r"(?<=[^ ])(?= )")


def parse_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def build_tokenizer(model):
    """A ``tokenizers`` tokenizer of the model.  It adds no leading marker: callers put the dummy
    prefix, a space, before a text themselves."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces, spec = model.pieces, model.trainer_spec
    kinds = {p.type for p in pieces}
    if USER in kinds or spec.treat_whitespace_as_suffix:
        raise ValueError("models with user-defined pieces or markers behind words are not supported")
    unknown = next((i for i, p in enumerate(pieces) if p.type == UNKNOWN), None)
    if spec.model_type == UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in pieces], unk_id=unknown, byte_fallback=spec.byte_fallback)
    elif spec.model_type == BPE:
        ids = {p.piece: i for i, p in enumerate(pieces)}
        rank = {p.piece: -p.score for p in pieces if p.type == NORMAL}
        merges = []
        for whole in rank:
            for cut in range(1, len(whole)):
                left, right = whole[:cut], whole[cut:]
                if left in rank and right in rank:
                    merges.append((rank[whole], -cut, left, right))
        core = models.BPE(ids, [m[2:] for m in sorted(merges)], unk_token=None if unknown is None else pieces[unknown].piece,
                          fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type}")
    made, steps = Tokenizer(core), []
    norm = model.normalizer_spec
    if norm.precompiled_charsmap:
        steps.append(normalizers.Precompiled(norm.precompiled_charsmap))
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", MARK))
    made.normalizer = normalizers.Sequence(steps)
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    return made


class PieceCodec:
    """Encoder, decoder and verifier of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = parse_model(path)
        self.tokenizer = build_tokenizer(self.model)
        self.norm = self.model.normalizer_spec
        pieces = [p.piece for p in self.model.pieces if p.type == NORMAL]
        # Cuts before spaces are exact if no piece has a marker behind another character and the
        # normaliser changes nothing else; line feeds stand alone if no piece holds one.
        self.cuttable = (not self.norm.precompiled_charsmap and not self.norm.remove_extra_whitespaces
                         and not any(MARK in p.lstrip(MARK) for p in pieces))
        self.lone_newline = not any("\n" in p for p in pieces)
        self.texts = [self._bytes(p) for p in self.model.pieces]
        bare = parse_model(path)
        bare.normalizer_spec.add_dummy_prefix = False
        self.verifier = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self.dtype = np.uint16 if len(self.texts) <= 1 << 16 else np.uint32
        self.cache: dict[str, bytes] = {"": b""}

    @staticmethod
    def _bytes(piece) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == CONTROL:
            return b""
        return " ⁇ ".encode() if piece.type == UNKNOWN else piece.piece.replace(MARK, " ").encode()

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self.norm.remove_extra_whitespaces:
            text = text.strip(" ")
        if self.norm.add_dummy_prefix:
            text = " " + text
        if not self.cuttable:
            return [text]
        text = text.replace(MARK, " ")
        if "  " in text or _CUT in text:
            return _BEFORE_SPACE.split(text)
        text = text.replace(" ", _CUT + " ")
        return (text.replace("\n", _CUT + "\n" + _CUT) if self.lone_newline else text).split(_CUT)

    def _learn(self, missing: list[str]) -> None:
        for lo in range(0, len(missing), 20_000):
            part = missing[lo:lo + 20_000]
            sure = self.verifier.encode(part, num_threads=2)
            for chunk, enc, ids in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), sure):
                if enc.ids != ids:
                    raise ValueError(f"the rebuilt tokenizer differs from SentencePiece on {chunk[:80]!r}")
                self.cache[chunk] = np.array(enc.ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self._chunks(t) for t in texts]
        distinct = set().union(*cut)
        if len(self.cache) + len(distinct) > CACHE_ENTRIES:
            self.cache = {k: v for k, v in self.cache.items() if k in distinct}
            self.cache[""] = b""
        self._learn(list(distinct.difference(self.cache)))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), dtype=self.dtype) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.norm.add_dummy_prefix and text[:1] == " " else text


#: Chunks kept per Python worker.
CACHE_ENTRIES = 500_000
_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, ids`` (little-endian unsigned 32-bit integers), ``n_tokens`` and ``round_trip``
    (decoding the ids gives the text back).

    Null and empty texts have no ids and round-trip; repeated rows are encoded each for itself; an
    empty table gives no rows; only the id and text columns are read.  Characters the normaliser
    folds (a literal metaspace marker, say) make ``round_trip`` false.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        c = codec(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for part in tokens.char_batches(texts):
                got = c.encode(texts[part])
                yield pa.record_batch([b.column(0).slice(part.start, part.stop - part.start),
                                       pa.array([x.astype("<u4").tobytes() for x in got], pa.binary()),
                                       pa.array([len(x) for x in got], pa.int64()),
                                       pa.array([c.decode(x) == t for x, t in zip(got, texts[part])], pa.bool_())],
                                      names=["doc_id", "ids", "n_tokens", "round_trip"])

    lean = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    return lean.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, round_trip boolean")


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``text``, decoded from their ids; null ids give null.  An input column ``text`` is
    replaced."""
    from pyspark.sql import types as T

    keep = encoded.drop("text")
    at = keep.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            texts = [None if x is None else c.decode(np.frombuffer(x, "<u4")) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return keep.mapInArrow(run, T.StructType([*keep.schema.fields, T.StructField("text", T.StringType())]))
