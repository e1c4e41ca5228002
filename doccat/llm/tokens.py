"""Tokenizer access inside tasks: whole texts are cut where no merge can reach across, and every
distinct chunk is encoded once per Python worker by the ``tokenizers`` library.

Cut points are exact for the two public vocabularies, whose pre-tokenizers always break there:

* byte-level BPE: before a single space between two non-space characters, and around a single line
  feed between two such (texts with runs of white space take a slower, equally exact path);
* word BPE: at spaces, line feeds and tabs (white space is dropped and separates words).

A new chunk that is one word of Latin letters goes to the library's model directly, mapped to byte
characters; a stop or comma behind it is a pre-token, and chunk, of its own.  Other chunks of printable
ASCII are cut by the vocabulary's own pre-token pattern, whose pieces are short and mostly known; they are
kept for their batch only, as such strings seldom return.  Any other chunk goes through the whole tokenizer.
The cache is bounded and lives as long as its Python worker, so tasks learn from those before them: of two generations
the older one is dropped when the younger is full, and chunks that return move to the younger.  It never changes results.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of a generation of the cache (some 150 bytes each; two per Python worker and encoder), characters encoded at a
#: time, chunks per library call.
CACHE_ENTRIES = 500_000
BATCH_CHARS = 2_000_000
CALL = 2000
_MARK = "\x1f"
_RUN = re.compile(r"\s\s")
#: The same and the mark itself, for Arrow: all of Python's white space.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}|\x1f"
#: An upper-case letter before a mark, which may compose with the lower-case letter alone.
_MARKED = r"[A-Z]\p{M}"
_SAFE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?")
_ASCII = re.compile(r" ?[!-;=-~]+")  # no '<', which may begin a special token
#: FIXED VALUE: the pre-token pattern of byte-level BPE, for ASCII.
_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+"
_ENCODERS: dict[tuple[str, str], "ChunkEncoder"] = {}
#: Byte-level BPE writes bytes as characters: printable Latin-1 stands for itself, the rest follows
#: from 256 on, in order.
_ITSELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _ITSELF)}


def _byte_chunks(text: str) -> list[str]:
    if _MARK in text or _RUN.search(text):
        return [c for c in _SAFE_SPACE.split(text) if c]
    return text.replace(" ", _MARK + " ").replace("\n", _MARK + "\n" + _MARK).split(_MARK)


def _word_chunks(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").split(" ")


CHUNKERS = {"byte": _byte_chunks, "word": _word_chunks}


class ChunkEncoder:
    """``encode(texts)``: the ids of each text, as the library gives them for the whole text."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.lower = kind == "word"
        self.pieces = re.compile(self._word_pieces(path) if self.lower else _BYTE_PIECES).findall
        self.chunks = CHUNKERS[kind]
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        size = np.dtype(self.dtype).itemsize
        self.id_bytes = [i.to_bytes(size, sys.byteorder) for i in range(self.tokenizer.get_vocab_size())]
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _word_pieces(path: str) -> str:
        """The pre-token pattern that the vocabulary file holds, with its letter and number classes for lower-case ASCII."""
        with open(path, encoding="utf-8") as f:
            cutter = json.load(f)["pre_tokenizer"]["pretokenizers"][0]
        return cutter["pattern"]["Regex"].replace("\\p{L}", "a-z").replace("\\p{N}", "0-9")

    def forget(self) -> None:
        self.cache, self.older = {"": b""}, {}

    def _age(self) -> None:
        """A full generation becomes the older one, whose chunks are dropped unless they return."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache, self.older = {"": b""}, self.cache

    def _taken_over(self, missing: list[str]) -> list[str]:
        """Chunks of the older generation move to the younger; returns those in neither."""
        if not self.older:
            return missing
        known = list(map(self.older.get, missing))
        self.cache.update((c, x) for c, x in zip(missing, known) if x is not None)
        return [c for c, x in zip(missing, known) if x is None]

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token of Latin letters, with or without a space before it."""
        text = word.lower() if self.lower else word
        text = text.replace(" ", "\u0120") if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_CHARS)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(text)])

    def _learn(self, missing: list[str]) -> list[str]:
        """Add the chunks to the cache; returns those to drop after the batch."""
        cache, older, word, ascii_, others, brief = self.cache, self.older, _WORD.fullmatch, _ASCII.fullmatch, [], []
        for chunk in missing:
            if word(chunk):
                if chunk[-1] not in ".,":
                    if chunk not in cache:  # it may have been the part of another
                        cache[chunk] = self._word(chunk)
                    continue
                parts = [chunk[:-1], chunk[-1]]
            elif ascii_(chunk):
                parts = self.pieces(chunk.lower() if self.lower else chunk)
                brief.append(chunk)
            else:
                others.append(chunk)
                continue
            for part in parts:
                if part not in cache:
                    cache[part] = older.get(part) or self._word(part)
            if chunk not in cache:
                cache[chunk] = b"".join([cache[part] for part in parts])
        for lo in range(0, len(others), CALL):
            part = others[lo:lo + CALL]
            for chunk, enc in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                cache[chunk] = np.array(enc.ids, dtype=self.dtype).tobytes()
        return brief + others

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All chunks of the texts in order, and where each text's chunks begin and end among them."""
        arr = pa.array(texts, pa.large_string())
        if self.lower:
            arr = pc.replace_substring(pc.replace_substring(arr, "\n", " "), "\t", " ")
            if not pc.any(pc.match_substring_regex(arr, _MARKED)).as_py():
                arr = pc.ascii_lower(arr)  # fewer distinct chunks
            cut = pc.split_pattern(arr, " ")
        elif pc.any(pc.match_substring_regex(arr, _ODD)).as_py():
            cut = pa.array([self.chunks(t) for t in texts], pa.large_list(pa.large_string()))
        else:
            arr = pc.replace_substring(pc.replace_substring(arr, " ", _MARK + " "), "\n", _MARK + "\n" + _MARK)
            cut = pc.split_pattern(arr, _MARK)
        offsets = cut.offsets.to_numpy()
        return cut.flatten(), offsets - offsets[0]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Chunks are cut and numbered in Arrow; ids are looked up once per distinct chunk and gathered by offsets."""
        if not texts:
            return []
        chunks, bounds = self._cut(texts)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._age()
        found, brief = list(map(self.cache.get, distinct)), []
        missing = [c for c, x in zip(distinct, found) if x is None]
        if missing:
            brief, cache = self._learn(self._taken_over(missing)), self.cache
            found = [cache[c] if x is None else x for c, x in zip(distinct, found)]
        # a chunk's ids are bytes, so Arrow gathers them
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids).to_numpy())]) // np.dtype(self.dtype).itemsize
        ids = np.frombuffer(ids.buffers()[2] or b"", self.dtype, count=ends[-1])
        for chunk in brief:
            self.cache.pop(chunk, None)
        self.cache[""] = b""
        return [ids[lo:hi] for lo, hi in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist())]


def encoder(path: str, kind: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = ChunkEncoder(path, kind)
    return _ENCODERS[path, kind]


def char_batches(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[slice]:
    """Slices of ``texts`` of about ``limit`` characters (one text at least)."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))
