"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a SQL condition for rejection over the text and its base measures.  On a bounded
sample each rule is evaluated for itself: the share of rows that it rejects is its selectivity, the
time beyond that of an empty pass its cost.  Rules then run in falling order of rejection per cost
as branches of one CASE, which stops at the first that rejects.  The verdict does not depend on the
order; ``rejected_by`` names the first rejecting rule in the order chosen.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import materialize, words_of

#: Rows, about, of the sample that costs and selectivities are estimated on, and its seed.
SAMPLE_ROWS = 2000
SAMPLE_SEED = 20_240_501
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over ``text``, ``words`` and the measures; null counts as not rejected."""

    name: str
    rejects: str


#: The base conditions; they hold before the cascade.
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * (1 + regexp_count(text, '\\n'))"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("upper_case", "2 * regexp_count(text, '\\\\p{Lu}') > length(regexp_replace(text, '\\\\P{L}+', ''))"),
    Rule("letterless_words", "2 * regexp_count(text, '(?<![^\\\\x20\\\\x09-\\\\x0D])[^\\\\p{L}\\\\x20\\\\x09-\\\\x0D]+(?![^\\\\x20\\\\x09-\\\\x0D])') > n_words"),
    Rule("exclamations", "3 * regexp_count(text, '!!') > n_words"),
    Rule("ellipsis_lines", "10 * regexp_count(text || '\n', '(?:\\\\.\\\\.\\\\.|\u2026)\n') > 4 * (1 + regexp_count(text, '\n'))"),
    Rule("bullet_lines", "10 * regexp_count('\n' || text, '\n[-*\u2022] ') > 9 * (1 + regexp_count(text, '\n'))"),
)


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``words`` and the five base measures (null text: no words, all zero).

    ``n_repeat_words`` counts the words that lie in a 3-word window found twice or more in the
    text.  Windows are compared by 64-bit hashes.  Sorted (hash, place) pairs put equal windows side
    by side; their places, sorted again, give the words covered.  Texts whose windows are all
    distinct skip that.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("words", words_of(F.col(text_col))).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.expr("CASE WHEN size(words) > 3 THEN transform(sequence(0, size(words) - 3), "
                           "i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"),
    })
    out = out.withColumn("_pairs", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN "
        "sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END"))
    out = out.withColumn("_at", F.expr(
        "sort_array(transform(filter(_pairs, (x, j) -> (j > 0 AND x.h = _pairs[greatest(j - 1, 0)].h) OR "
        "(j < size(_pairs) - 1 AND x.h = _pairs[least(j + 1, size(_pairs) - 1)].h)), x -> x.i))"))
    covered = ("aggregate(_at, struct(-3 AS last, 0 AS n), (a, x) -> struct(x AS last, a.n + least(3, x - a.last) AS n), a -> a.n)")
    out = out.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long"))
    # A generator of one row: conditions on the measures stay above it, instead of being pushed
    # down with all these expressions written out inside them, many times over.
    kept = [c for c in docs.columns if c not in ("words", "_lines", "_windows", "_pairs", "_at", *MEASURES)]
    return out.select(*kept, F.inline(F.array(F.struct("words", *MEASURES))))


def rank_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds per sample) in cascade order; ties keep the order given."""
    texts = docs.select(F.col(text_col).alias("text"))
    share = min(1.0, sample_rows / max(texts.count(), 1))
    # Rows from all over the table, whole texts, as a written table of their own.
    sample = with_measures(materialize(texts.sample(share, SAMPLE_SEED).repartition(8), "rule-sample")).persist()
    rows = sample.count()

    def timed(cond: Column) -> tuple[int, float]:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            hits = sample.select(F.count_if(cond)).first()[0]
            took.append(time.perf_counter() - began)
        return hits, min(took)

    timed(F.lit(False))
    _, empty = timed(F.lit(False))
    found = []
    for rule in rules:
        hits, took = timed(F.expr(f"NOT ({BASE}) AND ({rule.rejects})"))
        found.append((rule, hits / max(rows, 1), max(took - empty, 1e-3)))
    sample.unpersist()
    return sorted(found, key=lambda x: -x[1] / x[2])


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows with the measures, ``base_failed``, ``kept`` and ``rejected_by`` ('base', a rule, or null).

    Input columns with one of those names (or ``words``, ``_lines``, ``_windows``, ``_pairs``, ``_at``)
    are replaced or dropped.  Null and empty texts have no words and fail the base; repeated rows
    are judged each for itself; an empty table gives no rows.
    """
    order = rank_rules(docs, rules, text_col, sample_rows)
    out = with_measures(docs, text_col)
    if text_col != "text":
        out = out.withColumn("text", F.col(text_col))
    verdict = F.when(F.expr(BASE), F.lit("base"))
    for rule, _, _ in order:
        verdict = verdict.when(F.expr(rule.rejects), F.lit(rule.name))
    out = out.withColumn("base_failed", F.expr(BASE)).withColumn("rejected_by", verdict)
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop("words")
