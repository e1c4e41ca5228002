import datetime as dt

from pyspark.sql import functions as F

from doccat.functions.classify import pmda_adjust, status_columns, topic_column
from doccat.functions.rules import TOPIC_RULES

AS_OF = "2024-06-01"


def classify(spark, cases):
    df = spark.createDataFrame(cases, "title string, raw string, agency string, end date")
    st, sub = status_columns(F.col("title"), F.col("raw"), F.col("agency"), F.col("end"), AS_OF)
    return [(r["s"], r["u"]) for r in df.select(st.alias("s"), sub.alias("u")).collect()]


def test_status_rules_in_order(spark):
    cases = [
        ("Guideline (superseded)", "Draft", "FDA", None),
        ("Old guidance", "废止", "CDE", None),
        ("X", "Draft", "FDA", dt.date(2024, 7, 1)),
        ("X", "Draft", "FDA", dt.date(2024, 5, 1)),
        ("X", "Final", "FDA", None),
        ("X", "Consultation open", "EMA", None),
        ("X", "Adopted", "EMA", None),
        ("X", "Scientific guideline", "EMA", None),
        ("X", "Step 2b", "ICH", None),
        ("X", "Public consultation", "ICH", dt.date(2024, 1, 1)),
        ("X", "Step 5", "ICH", None),
        ("关于", "公开征求意见", "CDE", None),
        ("X", "试行", "CDE", None),
        ("X", "Notification", "PMDA", None),
        ("X", None, "OTHER", None),
    ]
    assert classify(spark, cases) == [
        ("superseded", None), ("withdrawn", None), ("open_for_comment", None), ("draft", None), ("final", None),
        ("open_for_comment", None), ("effective", None), ("final", None), ("open_for_comment", None),
        # closed ICH consultation falls through to the generic 'consultation' rule
        ("open_for_comment", None), ("implemented", None), ("open_for_comment", None), ("final", "trial"),
        ("final", None), ("unknown", None),
    ]


def test_pmda_adjust(spark):
    df = spark.createDataFrame([("Mutagenic Impurities (Early Consideration)", "unknown")], "title string, s string")
    st, sub = pmda_adjust(F.col("s"), F.lit(None).cast("string"), F.col("title"), F.lit("PMDA"))
    r = df.select(st.alias("s"), sub.alias("u")).first()
    assert (r["s"], r["u"]) == ("final", "early_consideration")


def test_topic_rules_first_match_wins(spark):
    titles = [(kws[0].title(), topic) for topic, kws in TOPIC_RULES] + [("Administrative contacts", "other")]
    df = spark.createDataFrame(titles, "title string, expected string")
    out = df.select("expected", topic_column(F.col("title"), F.lit(None), F.lit(None)).alias("t")).collect()
    assert [r["t"] for r in out] == [r["expected"] for r in out]
    # substring traps are kept: 'ich' inside 'which'
    df = spark.createDataFrame([("Guidance which applies",)], "title string")
    assert df.select(topic_column(F.col("title"), F.lit(None), F.lit(None)).alias("t")).first()["t"] == "ICH_implementation"


def test_rule_table_answer_does_not_depend_on_pieces_or_keys(spark):
    from doccat.functions.classify import classify_with_rules
    docs = spark.createDataFrame([(1, "beta x"), (1, "alpha y"), (None, "alpha z"), (2, None), (3, "BAYESIAN only"), (4, "none")],
                                 "id long, text string")
    rules = spark.createDataFrame([(2, "a", "alpha"), (1, "b", "beta"), (3, "bayes", "bayesian"), (0, "never", None), (0, "blank", "")]
                                  + [(10 + i, f"t{i}", f"word{i}") for i in range(30)], "priority int, topic string, keyword string")
    want = [("BAYESIAN only", "bayes"), ("alpha y", "a"), ("alpha z", "a"), ("beta x", "b"), ("none", "other"), (None, "other")]
    for chunk in (1, 7, 500):
        got = classify_with_rules(docs, rules, "text", chunk=chunk).select("text", "topic").collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_large_rule_table_is_joined_on_grams(spark):
    import random

    from doccat.functions.classify import classify_by_grams, classify_with_rules
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    rules = [(rng.randint(0, 50), f"t{rng.randint(0, 30)}", word(rng.choice([5, 6, 7, 8])).title()) for _ in range(100_000)]
    rules += [(60, "two", "zz"), (61, "one", "q"), (0, "never", None), (0, "blank", ""), (3, "cjk", "药"), (4, "quoted", "a'b c")]
    texts = [" ".join(word(rng.randint(1, 12)) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "xzzx", "Q", "yy", "化药", "A'B C", "ab", texts[0], texts[0]]
    docs = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "id long, text string, rule string")
    rule_df = spark.createDataFrame(rules, "priority int, topic string, keyword string")

    def first(text):
        hits = [(p, t) for p, t, k in rules if k and text is not None and k.lower() in text.lower()]
        return min(hits)[1] if hits else "other"

    want = sorted(((i % 50, t, first(t)) for i, t in enumerate(texts)), key=repr)
    for got in (classify_with_rules(docs, rule_df, "text"), classify_by_grams(docs, rule_df, "text", broadcast_grams=10)):
        assert got.columns == ["id", "text", "rule", "topic"]
        assert sorted(((r.id, r.text, r.topic) for r in got.collect()), key=repr) == want
    few = spark.createDataFrame(rules[-6:] + rules[:300], "priority int, topic string, keyword string")
    a, b = classify_with_rules(docs, few, "text"), classify_by_grams(docs, few, "text")
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    none = classify_by_grams(docs, rule_df.limit(0), "text")
    assert {r.topic for r in none.collect()} == {"other"}
    assert len(classify_with_rules(docs, rule_df, "text")._jdf.queryExecution().toString()) < 100_000


def test_each_distinct_word_is_looked_through_once(spark):
    """Keywords without blanks meet the words of all texts; those with blanks, and words of any length, still meet whole texts."""
    from doccat.functions.classify import LONG_WORD, classify_by_grams, gram_index, word_rules
    rules = spark.createDataFrame([(3, "c", "dose"), (2, "b", "dose range"), (1, "a", "stab"), (0, "tab", "x\tyz")], "priority int, topic string, keyword string")
    texts = ["overdose", "Dose\tRange", "a dose  range", "a DOSE range of", "y" * LONG_WORD + "unstable", "ab\nstab", "ax\tyzb", "do se", None] + ["overdose"] * 50
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = [r.topic for r in classify_by_grams(docs, rules, "text").orderBy("id").collect()]
    assert got == ["c", "c", "c", "b", "a", "a", "tab", "other", "other"] + ["c"] * 50
    words = spark.createDataFrame([("overdose",), ("unstable",), ("none",)], "word string")
    found = word_rules(words, gram_index(rules.filter("priority IN (1, 3)")), [3], True).collect()
    assert sorted((r.word, r.rule.topic) for r in found) == [("overdose", "c"), ("unstable", "a")]
