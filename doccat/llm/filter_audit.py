"""Filter interaction audit with wide packed counters.

Filters are applied in every order.  Which filter removes a document in which order depends on its mask
(the set of filters it fails) alone, so each mask has one big integer: a field per (order, step), one
where that step removes the document.  The integers of a part's documents are added up; a field is wider
than the part's number of documents, so no sum reaches its neighbour.  Everything reported is unpacked
from three such sums: over all documents, over those labelled good, and over those labelled toxic.

Spark reduces documents to counts by (part, mask, labels) first, inside each map task: equal masks have
equal integers, and ``count * integer`` is their sum.  A part brings at most 4 * 2**filters rows to the
addition, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import words_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text without nulls."""
    words = words_of(text)
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": (F.length(text) - F.length(F.translate(text, UPPER, ""))) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


@lru_cache(maxsize=None)
def mask_integer(mask: int, filters: str, width: int) -> int:
    """The packed outcomes of a mask: field ``len(filters) * order + step`` (both from 0) is one if that step removes."""
    packed = 0
    for o, order in enumerate(permutations(range(len(filters)))):
        step = next((s for s, f in enumerate(order) if mask >> f & 1), None)
        if step is not None:
            packed |= 1 << width * (len(filters) * o + step)
    return packed


def unpack(packed: int, fields: int, width: int) -> list[int]:
    low = (1 << width) - 1
    return [packed >> width * i & low for i in range(fields)]


def outcomes(counts: pd.DataFrame, filters: str) -> Iterator[dict]:
    """All rows of one part from its counts (``mask, good, toxic, n``)."""
    total = int(counts["n"].sum())
    width = total.bit_length() + 1
    sums = [0, 0, 0]
    for mask, good, toxic, n in zip(counts["mask"].tolist(), counts["good"].tolist(), counts["toxic"].tolist(), counts["n"].tolist()):
        add = n * mask_integer(mask, filters, width)
        sums = [sums[0] + add, sums[1] + add * bool(good), sums[2] + add * bool(toxic)]
    k, orders = len(filters), list(permutations(range(len(filters))))
    removed, good_lost, toxic_lost = (unpack(s, k * len(orders), width) for s in sums)
    fails, alone, shapley = [0] * k, [0] * k, [0] * k
    for o, order in enumerate(orders):
        fails[order[0]] = removed[k * o]  # the first filter removes all that fail it
        alone[order[-1]] = removed[k * o + k - 1]  # the last one only what fails it alone
        for s, f in enumerate(order):
            shapley[f] += removed[k * o + s]
    for o, order in enumerate(orders):
        kept = total
        for s, f in enumerate(order):
            at = k * o + s
            kept -= removed[at]
            yield {"filter_order": "".join(filters[x] for x in order), "step": s + 1, "kept": kept, "removed": removed[at],
                   "redundant": fails[f] - removed[at], "unique_fails": alone[f], "good_lost": good_lost[at],
                   "toxic_lost": toxic_lost[at], "shapley": shapley[f]}


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by the filters A to E that they fail (bit 0 is A).

    E fails where a smaller ``doc_id`` anywhere has the same text.  Groups of copies are never gathered:
    documents are counted by (text digest, id), and the smallest id of a digest is a minimum, combined
    before the shuffle.  Of the copies only those of the smallest id do not fail.
    """
    text = F.coalesce("text", F.lit(""))
    conditions = text_filters(F.col("text"))
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(conditions.values())), F.lit(0))
    lean = base.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = lean.join(marks, "doc_id", "left").select(
        "doc_id", "digest", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    cell = ["part", "mask", "good", "toxic"]
    groups = marked.groupBy("doc_id", "digest", *cell).agg(F.count("*").alias("n"))
    # one source without filters for both, so that Spark computes and shuffles it once
    everyone = groups.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    named = groups.groupBy("doc_id", "digest").agg(F.collect_list(F.struct(*cell, "n")).alias("cells"))
    least = named.groupBy("digest").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "cells"))).alias("least"))
    first = least.select(F.inline("least.cells")).groupBy(*cell).agg(F.sum("n").alias("first"))
    late = 1 << len(conditions)
    split = everyone.join(first, cell, "left").withColumn("on_time", F.coalesce("first", F.lit(0)) + F.col("unnamed"))
    return split.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask"), F.col("on_time").alias("n")),
        F.struct((F.col("mask") + late).alias("mask"), (F.col("n") - F.col("on_time")).alias("n"))))).filter("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """Per part (language; null and empty are one), order of the filters and step: what is kept, removed,
    removed though an earlier step would have done (``redundant``: fails this filter, removed earlier), what
    fails this filter only, good and toxic documents lost here, and the filter's removals over all orders.

    Null texts are empty texts.  Repeated rows count each for themselves and are no copies of one another;
    a null ``doc_id`` is smaller than none and never fails E; a document with several labels is good (toxic)
    if any says so.  An empty table gives no rows.  Other columns are not read.
    """

    def run(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"part": key[0], **row} for row in outcomes(counts, filters)])

    return mask_counts(docs, labels).groupBy("part").applyInPandas(
        run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
             "good_lost long, toxic_lost long, shapley long")
