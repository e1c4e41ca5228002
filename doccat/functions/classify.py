"""Ordered keyword classification (F11-F14, J8) as generated CASE expressions.

The rule tables are tiny and fixed, so each classifier is one short-circuit,
code-generated CASE over a once-lower-cased text; no join, no Python.
"""

from __future__ import annotations

import datetime as _dt

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.functions.rules import (
    LEGACY_TITLE_STATUS_SUFFIXES,
    PMDA_EARLY_CONSIDERATION,
    PMDA_EARLY_CONSIDERATION_SUB_STATUS,
    STATUS_DEFAULT,
    STATUS_RULES,
    TITLE_STATUS_DEFAULT,
    TITLE_STATUS_SUFFIXES,
    TOPIC_DEFAULT,
    TOPIC_RULES,
)
from doccat.functions.text import strip_ws


def _any_contains(text: Column, keywords: list[str]) -> Column:
    cond = None
    for kw in keywords:
        term = text.contains(kw.lower())
        cond = term if cond is None else (cond | term)
    return cond


def _as_date(as_of: str | _dt.date | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def status_rule_index(title: Column, status_raw: Column, agency: Column,
                      comment_end_date: Column, as_of: str | _dt.date | Column) -> Column:
    """Index (1-based) of the first status rule that fires, 0 when none."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(status_raw, F.lit(""))))
    agency_key = F.upper(F.coalesce(agency, F.lit("")))
    as_of_d = _as_date(as_of)
    expr = None
    for i, (rule_agency, keywords, extra, _status, _sub) in enumerate(STATUS_RULES, start=1):
        cond = _any_contains(text, keywords)
        if rule_agency is not None:
            cond = (agency_key == F.lit(rule_agency)) & cond
        if extra == "end_on_or_after_as_of":
            cond = cond & comment_end_date.isNotNull() & (comment_end_date >= as_of_d)
        elif extra == "end_missing_or_on_or_after_as_of":
            cond = cond & (comment_end_date.isNull() | (comment_end_date >= as_of_d))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(0))


def status_columns(title: Column, status_raw: Column, agency: Column,
                   comment_end_date: Column, as_of: str | _dt.date | Column) -> tuple[Column, Column]:
    """(status_normalized, sub_status); ``as_of`` replaces 'today'."""
    idx = status_rule_index(title, status_raw, agency, comment_end_date, as_of)
    statuses = F.array(F.lit(STATUS_DEFAULT), *[F.lit(r[3]) for r in STATUS_RULES])
    subs = F.array(F.lit(None).cast("string"), *[F.lit(r[4]).cast("string") for r in STATUS_RULES])
    return F.element_at(statuses, idx + 1), F.element_at(subs, idx + 1)


def pmda_adjust(status: Column, sub_status: Column, title: Column, agency: Column) -> tuple[Column, Column]:
    """PMDA rows: unknown -> final; 'early consideration' titles get that sub status."""
    is_pmda = F.upper(agency) == F.lit("PMDA")
    st = F.when(is_pmda & (status == F.lit(STATUS_DEFAULT)), F.lit("final")).otherwise(status)
    sub = F.when(is_pmda & F.lower(title).contains(PMDA_EARLY_CONSIDERATION),
                 F.lit(PMDA_EARLY_CONSIDERATION_SUB_STATUS)).otherwise(sub_status)
    return st, sub


def topic_column(title: Column, topic_raw: Column, summary: Column) -> Column:
    """First topic rule whose keyword is a substring; default 'other'."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(topic_raw, F.lit("")),
                               F.coalesce(summary, F.lit(""))))
    expr = None
    for topic, keywords in TOPIC_RULES:
        cond = _any_contains(text, keywords)
        expr = F.when(cond, F.lit(topic)) if expr is None else expr.when(cond, F.lit(topic))
    return expr.otherwise(F.lit(TOPIC_DEFAULT))


def split_title_status(title: Column, legacy: bool = False) -> tuple[Column, Column]:
    """cut a known status suffix from the title -> (name, status)."""
    suffixes = LEGACY_TITLE_STATUS_SUFFIXES if legacy else TITLE_STATUS_SUFFIXES
    name = None
    status = None
    for marker, label in suffixes:
        cond = title.endswith(marker)
        cut = strip_ws(F.left(title, F.length(title) - F.lit(len(marker))))
        name = F.when(cond, cut) if name is None else name.when(cond, cut)
        status = F.when(cond, F.lit(label)) if status is None else status.when(cond, F.lit(label))
    return name.otherwise(title), status.otherwise(F.lit(TITLE_STATUS_DEFAULT))


def open_for_comment_flag(status: Column) -> Column:
    """'Yes' when the status text mentions draft or consultation, else ''."""
    low = F.lower(F.coalesce(status, F.lit("")))
    return F.when(low.contains("draft") | low.contains("consultation"), F.lit("Yes")).otherwise(F.lit(""))


# ---------------------------------------------------------------- staged forms (keep generated code small)


def _status_index_on_text(text: Column, agency_key: Column, end: Column, as_of) -> Column:
    as_of_d = _as_date(as_of)
    expr = None
    for i, (rule_agency, keywords, extra, _status, _sub) in enumerate(STATUS_RULES, start=1):
        cond = _any_contains(text, keywords)
        if rule_agency is not None:
            cond = (agency_key == F.lit(rule_agency)) & cond
        if extra == "end_on_or_after_as_of":
            cond = cond & end.isNotNull() & (end >= as_of_d)
        elif extra == "end_missing_or_on_or_after_as_of":
            cond = cond & (end.isNull() | (end >= as_of_d))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(0))


def with_status(df, title: str, status_raw: str, agency: str | Column, comment_end_date: str | Column, as_of,
                pmda: bool = False, out: tuple[str, str] = ("status_normalized", "sub_status")):
    """F12 as staged projections: lower-cased text once, then the rule index, then the outputs.

    Each stage is its own projection; the text is referenced by every rule, so
    Catalyst keeps it materialised instead of inlining it into ~30 branches
    (which would overflow the 64 KB generated-method limit and lose codegen).
    """
    ag = F.col(agency) if isinstance(agency, str) else agency
    end = F.col(comment_end_date) if isinstance(comment_end_date, str) else comment_end_date
    d = df.withColumn("_st_text", F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "),
                                                    F.coalesce(F.col(status_raw), F.lit("")))))
    d = d.withColumn("_st_agency", F.upper(F.coalesce(ag, F.lit(""))))
    d = d.withColumn("_st_idx", _status_index_on_text(F.col("_st_text"), F.col("_st_agency"), end, as_of))
    statuses = F.array(F.lit(STATUS_DEFAULT), *[F.lit(r[3]) for r in STATUS_RULES])
    subs = F.array(F.lit(None).cast("string"), *[F.lit(r[4]).cast("string") for r in STATUS_RULES])
    d = d.withColumn(out[0], F.element_at(statuses, F.col("_st_idx") + 1)).withColumn(
        out[1], F.element_at(subs, F.col("_st_idx") + 1))
    if pmda:
        st, sub = pmda_adjust(F.col(out[0]), F.col(out[1]), F.col(title), F.col("_st_agency"))
        d = d.withColumn(out[1], sub).withColumn(out[0], st)
    return d.drop("_st_text", "_st_agency", "_st_idx")


def with_topic(df, title: str | Column, topic_raw: str | Column, summary: str | Column, out: str = "topic_normalized"):
    """F13 as staged projections (text once, then the CASE)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    d = df.withColumn("_tp_text", F.lower(F.concat_ws(" ", F.coalesce(c(title), F.lit("")),
                                                      F.coalesce(c(topic_raw), F.lit("")),
                                                      F.coalesce(c(summary), F.lit("")))))
    expr = None
    for topic, keywords in TOPIC_RULES:
        cond = _any_contains(F.col("_tp_text"), keywords)
        expr = F.when(cond, F.lit(topic)) if expr is None else expr.when(cond, F.lit(topic))
    return d.withColumn(out, expr.otherwise(F.lit(TOPIC_DEFAULT))).drop("_tp_text")


# ---------------------------------------------------------------- J8 with a rule table


#: Rules up to which they are read by the driver and written into the plan; more are joined.
CASE_RULES = 5_000
#: Index entries up to which the gram index is broadcast (entries of a gram, a keyword and its rule: some 100 bytes each).
BROADCAST_GRAMS = 200_000
GRAM = 3
#: What parts the words of a text, and the longest word that is looked through by itself.
BLANK = r"\s"
LONG_WORD = 200


def usable_rules(rules):
    """One row per keyword (lower case, not empty) with its first rule: lowest priority, ties by topic."""
    return rules.select("priority", "topic", F.lower("keyword").alias("kw")).filter("kw <> ''").groupBy("kw").agg(
        F.min(F.struct("priority", "topic")).alias("rule"))


def classify_with_rules(df, rules, text: str | Column, out: str = "topic", default: str = TOPIC_DEFAULT,
                        chunk: int = 200, case_rules: int = CASE_RULES):
    """First rule (lowest ``priority``, ties by topic) of which a keyword is a substring of the lower-cased text.

    ``rules`` (priority, topic, keyword) with at most ``case_rules`` keywords become CASE expressions of at most
    ``chunk`` branches, tried in order: nothing is shuffled.  Larger tables never reach the driver: they are
    joined by ``classify_by_grams``, with the same result.  Null or empty keywords match nothing; rows without a
    hit, and null texts, get ``default``.
    """
    kept = usable_rules(rules)
    rows = kept.select("rule.priority", "rule.topic", "kw").limit(case_rules + 1).collect()  # bounded: only to tell small from large
    if len(rows) > case_rules:
        return classify_by_grams(df, rules, text, out, default)
    rows.sort(key=lambda r: (r["priority"] is not None, r["priority"], r["topic"] is not None, r["topic"], r["kw"]))
    txt = F.col(text) if isinstance(text, str) else text
    topics = [(t, [r["kw"] for r in g]) for (_, t), g in groupby(rows, key=lambda r: (r["priority"], r["topic"]))]
    staged = df.withColumn("_rt_text", F.lower(txt))
    parts = []
    for lo in range(0, len(topics), chunk):
        expr = F
        for topic, words in topics[lo:lo + chunk]:
            expr = expr.when(F.exists(F.lit(words), lambda w: F.col("_rt_text").contains(w)), F.lit(topic))
        parts.append(expr)
    return staged.withColumn(out, F.coalesce(*parts, F.lit(default))).drop("_rt_text")


def _grams(text: Column, size: int) -> Column:
    """The distinct grams of ``size`` characters: one pass of a look-ahead over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def gram_index(rules):
    """``gram, kw, rule``: each keyword under that of its 3-grams (the keyword itself, if shorter) which fewest keywords hold."""
    kept = usable_rules(rules)
    grams = kept.select("kw", F.explode(F.when(F.length("kw") < GRAM, F.array("kw")).otherwise(_grams(F.col("kw"), GRAM))).alias("gram"))
    held = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(held, "gram").groupBy("kw").agg(F.min(F.struct("n", "gram")).alias("x"))
    return kept.join(rarest, "kw").select(F.col("x.gram").alias("gram"), "kw", "rule")


def word_rules(words, index, sizes: list[int], small: bool):
    """``word, rule``: the first rule of each of the ``words`` (distinct) that holds a keyword of the ``index``."""
    held = words.select("word", F.explode(F.concat(*[_grams(F.col("word"), n) for n in sizes])).alias("gram"))
    hits = held.join(F.broadcast(index) if small else index, "gram").filter(F.col("word").contains(F.col("kw")))
    return hits.groupBy("word").agg(F.min("rule").alias("rule"))


def _rules_in_words(texts, index, sizes: list[int], small: bool, broadcast_words: int):
    """``_rt_row, rule`` by keywords without blanks: each distinct word is looked through once, whatever the texts that hold it."""
    words = texts.select("_rt_row", F.explode(F.array_distinct(F.split("_rt_text", BLANK + "+"))).alias("word")).filter(
        F.length("word") <= LONG_WORD)
    found = word_rules(words.select("word").distinct(), index, sizes, small).checkpoint(eager=True)
    few = found.limit(broadcast_words + 1).count() <= broadcast_words
    return words.join(F.broadcast(found) if few else found, "word").groupBy("_rt_row").agg(F.min("rule").alias("rule"))


def _rules_in_texts(texts, index, sizes: list[int], small: bool):
    """``_rt_row, rule`` by keywords of any kind: candidates rejoin their texts one by one."""
    held = texts.select("_rt_row", F.explode(F.concat(*[_grams(F.col("_rt_text"), n) for n in sizes])).alias("gram"))
    found = held.join(F.broadcast(index) if small else index, "gram").select("_rt_row", "kw", "rule")
    hits = texts.select("_rt_row", "_rt_text").join(found, "_rt_row").filter(F.col("_rt_text").contains(F.col("kw")))
    return hits.groupBy("_rt_row").agg(F.min("rule").alias("rule"))


def classify_by_grams(df, rules, text: str | Column, out: str = "topic", default: str = TOPIC_DEFAULT,
                      broadcast_grams: int = BROADCAST_GRAMS):
    """J8 for rule tables of any size: a text can only hold a keyword whose rarest gram it holds, so texts meet keywords
    in an equi-join on that gram; ``contains`` then decides, and the first rule of a row is a minimum.

    A keyword without blanks lies within a word, so such keywords meet the distinct words of all texts, and the texts
    take the rules of their words.  Keywords with blanks, and texts with words of more than ``LONG_WORD`` characters,
    meet whole texts; neither a text's candidates nor a gram's texts are ever gathered.  The index, and the words
    with a rule, are broadcast up to ``broadcast_grams`` entries; beyond that both sides are shuffled.  Rows are
    numbered in a checkpointed copy.
    """
    txt = F.col(text) if isinstance(text, str) else text
    numbered = df.withColumn("_rt_text", F.lower(txt)).withColumn("_rt_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    index = gram_index(rules).checkpoint(eager=True)
    kinds = index.groupBy(F.col("kw").rlike(BLANK).alias("blank"), F.length("gram").alias("size")).count().collect()  # at most 2 * GRAM rows
    if not kinds:
        return numbered.withColumn(out, F.lit(default)).drop("_rt_text", "_rt_row")
    small = sum(r["count"] for r in kinds) <= broadcast_grams
    plain, spaced = ([sorted(r["size"] for r in kinds if r["blank"] == b) for b in (False, True)])
    texts = numbered.filter("_rt_text IS NOT NULL").select("_rt_row", "_rt_text")
    found = []
    if plain:
        words = index.filter(~F.col("kw").rlike(BLANK))
        found.append(_rules_in_words(texts, words, plain, small, broadcast_grams))
        long = texts.filter(F.col("_rt_text").rlike(f"[^{BLANK}]{{{LONG_WORD + 1}}}"))
        found.append(_rules_in_texts(long, words, plain, small))
    if spaced:
        found.append(_rules_in_texts(texts, index.filter(F.col("kw").rlike(BLANK)), spaced, small))
    best = reduce(DataFrame.unionByName, found).groupBy("_rt_row").agg(F.min("rule").alias("_rt_rule"))
    return numbered.join(best, "_rt_row", "left").withColumn(
        out, F.when(F.col("_rt_rule").isNull(), F.lit(default)).otherwise(F.col("_rt_rule.topic"))).drop("_rt_text", "_rt_row", "_rt_rule")
