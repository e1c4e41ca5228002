"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled texts.  A text is lower-cased,
freed of ASCII symbols and digits, and cut into pieces; every piece is compressed with every
dictionary, and the language whose dictionary gives the smallest total wins.  A narrow margin over
the runner-up rejects the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The training sample: distinct texts per language, taken by hash, and characters used of each.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 4096
#: Bytes compressed at a time, and the compression level.
PIECE_BYTES = 4096
LEVEL = 9
#: Texts whose best language saves less than this share over the second are rejected.
MIN_MARGIN = 0.002
UNKNOWN = "und"
#: ASCII bytes that tell no language: all but lower-case letters, space and line feed.
_DROPPED = bytes(b for b in range(128) if not (97 <= b <= 122 or b in (10, 32)))
_LETTER = re.compile(r"[^\W\d_]")


def _raw(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(None, _DROPPED)


@dataclass
class CompressionModel:
    """Dictionaries by language, in language order; compressors are built once per process."""

    dictionaries: dict[str, bytes]
    min_margin: float = MIN_MARGIN
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "min_margin": self.min_margin, "_made": {}}

    def compressors(self):
        import zstandard

        if not self._made:
            for lang, content in self.dictionaries.items():
                how = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=PIECE_BYTES, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                self._made[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=how)
        return self._made

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, margin as a share of the second smallest size, rejected).  Ties go to the first
        language by name; texts without a letter are 'und' and rejected."""
        if not text or not self.dictionaries or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = _raw(text)
        pieces = [raw[i:i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        sizes = []
        for lang, c in self.compressors().items():
            sizes.append((sum(len(c.compress(p)) for p in pieces), lang))
        sizes.sort()
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], margin, margin < self.min_margin


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", min_margin: float = MIN_MARGIN) -> CompressionModel:
    """Dictionaries from a bounded sample of the labelled rows: per language the ``SAMPLE_TEXTS`` distinct
    texts of smallest hash, ``SAMPLE_CHARS`` characters of each.  Null or empty texts and null labels
    take no part; copies count once."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text <> ''")
    rows = rows.withColumn("h", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE_TEXTS)
    picked = rows.join(F.broadcast(chosen.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(
        F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text")).collect()
    by_lang: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in picked:
        by_lang[r["lang"]].append((r["h"], r["text"]))
    return CompressionModel({lang: _raw("\n".join(t for _, t in sorted(by_lang[lang]))) for lang in sorted(by_lang)}, min_margin)


def identify(docs: DataFrame, model: CompressionModel, text_col: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` ('und' for null texts and texts without a letter), ``lang_score`` (0 to
    1) and ``lang_rejected``.  Only the text decides.  Input columns with these names are replaced;
    repeated rows are judged each for itself; an empty table gives no rows."""
    keep = docs.drop("lang_pred", "lang_score", "lang_rejected")
    at = keep.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t) for t in b.column(at).to_pylist()]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[*b.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    return keep.mapInArrow(run, schema)
