"""Element tree, attributes, summaries by interval, and character references against the standard library."""

import html

import pytest
from pyspark.sql import functions as F

from doccat.functions.text import fragment_text, normalize_whitespace, plain_references, unescape_html
from doccat.operators import html as H

SUMMARY = "This guidance describes the design and analysis of adaptive clinical trials for drugs and biologics sponsors."


def tree(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return H.element_tree(df).orderBy("page_id", "pos").collect()


def test_nested_intervals_and_paths(spark):
    got = [(r.tag or r.text, r.kind, r.pos, r.end, r.depth, r.parent, r.ordinal, r.path)
           for r in tree(spark, "<div><p>a<br>b</p><p>c</div>d")]
    assert got == [("div", "open", 0, 8, 0, -1, 1, "1"), ("p", "open", 1, 5, 1, 0, 1, "1/1"), ("a", "text", 2, 2, 2, 1, 0, None),
                   ("br", "open", 3, 3, 2, 1, 1, "1/1/1"), ("b", "text", 4, 4, 2, 1, 0, None), ("p", "close", 5, 5, 1, 1, 0, None),
                   ("p", "open", 6, 7, 1, 0, 2, "1/2"), ("c", "text", 7, 7, 2, 6, 0, None), ("div", "close", 8, 8, 0, 0, 0, None),
                   ("d", "text", 9, 9, 0, -1, 0, None)]


def test_implied_ends_and_stray_closing_tags(spark):
    def ends(page):
        return {(r.tag, r.pos): r.end for r in tree(spark, page) if r.kind == "open"}

    assert ends("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == {
        ("ul", 0): 11, ("li", 1): 2, ("li", 3): 8, ("ul", 5): 8, ("li", 6): 7, ("li", 9): 10}
    assert ends("<p><b>x<p>y</b></i>z") == {("p", 0): 2, ("b", 1): 2, ("p", 3): 7}
    rows = tree(spark, "<table><tr><td>1<td>2<tr><td>3</table>")
    assert [(r.tag, r.end, r.parent) for r in rows if r.kind == "open"] == [
        ("table", 9, -1), ("tr", 5, 0), ("td", 3, 1), ("td", 5, 1), ("tr", 8, 0), ("td", 8, 6)]
    assert tree(spark, None, "") == []


def test_attributes_with_odd_quoting(spark):
    page = """<a title="a>b" data-href="/no" HREF='/q.pdf' hidden class=x>t</a><a href=/bare>u</a><img alt='it"s' src="s&amp;t"/><b data-x="href='/no'">"""
    attrs = [r.attrs for r in tree(spark, page) if r.kind == "open"]
    assert attrs == [{"title": "a>b", "data-href": "/no", "href": "/q.pdf", "hidden": "", "class": "x"}, {"href": "/bare"},
                     {"alt": 'it"s', "src": "s&t"}, {"data-x": "href='/no'"}]
    df = spark.createDataFrame([(1, page, "http://h/")], "page_id long, html string, url string")
    assert [r.href for r in H.element_table(df).filter("tag = 'a' AND kind = 'open'").orderBy("pos").collect()] == ["/q.pdf", "/bare"]
    assert [r.text for r in H.element_table(df).filter("kind = 'text'").orderBy("pos").collect()] == ["t", "u"]


def test_table_of_odd_tags_against_sql_values(spark):
    df = spark.sql("""SELECT * FROM VALUES (1L, '<p title=">">x'), (2L, '<p title=''>''>x'), (3L, '<p a="1" a="2">x'), (4L, '<!doctype html><p>x'),
                      (5L, '<p class=it''s>x'), (6L, 'a < b'), (7L, '<P\\n ID = "k" >x') AS t(page_id, html)""")
    got = {(r.page_id, r.pos): (r.tag, r.text, r.attrs) for r in H.element_tree(df).collect()}
    assert got[1, 0] == ("p", "", {"title": ">"}) and got[1, 1][1] == "x" and got[2, 0][2] == {"title": ">"} and got[2, 1][1] == "x"
    assert got[3, 0][2] == {"a": "1"} and got[4, 0][0] == "" and got[4, 1][0] == "p" and got[5, 0][0] == "p" and got[5, 1][1] == "x"
    assert " ".join(got[6, i][1] for i in range(3)) == "a < b" and got[7, 0][2] == {"id": "k"}


def summary(spark, page):
    return spark.createDataFrame([(page,)], "html string").select(H.page_summary(F.col("html")).alias("s")).first()["s"]


def test_summary_reads_container_intervals(spark):
    assert summary(spark, f"<p>{SUMMARY} out<article><p>{SUMMARY} art</article><main><p>{SUMMARY} main</main>") == SUMMARY + " art"
    assert summary(spark, f"<div role='main'><div>x</div><p>short</div><p>{SUMMARY} after") == SUMMARY + " after"
    assert summary(spark, f"<div title='>' role=main><div></div><p>{SUMMARY} in<i>ner</i></div><p>{SUMMARY}") == SUMMARY + " in ner"
    assert summary(spark, f"<article><article><p>no</article><p>{SUMMARY} outer</article>") == SUMMARY + " outer"
    assert summary(spark, f"<main><p>{SUMMARY[:60]}</main>{SUMMARY}") == SUMMARY[:60].strip() + " " + SUMMARY
    assert summary(spark, "<p>short") == "" and summary(spark, None) == "" and summary(spark, "") == ""


def test_summary_is_linear_in_tags(spark):
    deep = "<div role=\"main\">" + "<div>" * 20_000 + f"<p>{SUMMARY}" + "</div>" * 20_001
    assert summary(spark, deep) == SUMMARY


REFERENCES = ["&copy; 2020", "&copy 2020", "AT&ampT", "AT&T", "&amp;copy;", "&amp;lt;", "&amplt;", "&lt5", "&LT;b&GT", "&quot;q&quot", "&#169;", "&#169", "&#xA9;",
              "&#XA9z", "&#128;", "&#0;", "&#1114112;", "&#xD800;", "&notit;", "&notin;", "&not in", "&nosuch;", "&nosuch", "&", "&&amp;&", "&;", "&#;", "&#x;",
              "&hellip;&mdash;", "&NotEqualTilde;", "&eacute;t&eacute", "&Eacute;", "&AElig", "&frac12;", "&frac123", "&para;graph", "&sect12", "&timesbar;", "&times2",
              "&yen=1", "&reg2;", "&deg C", "&micro;m", "&uuml;ber", "&szlig", "a &middot; b", "&#39;&apos;", "&lsquo;x&rsquo;", "&euro;5", "&bull;&nbsp;x", "&zwnj;",
              "&CounterClockwiseContourIntegral;"]


def test_references_equal_the_standard_library(spark):
    assert len(REFERENCES) >= 50
    df = spark.createDataFrame([(i, r, f"<i>{r}</i>") for i, r in enumerate(REFERENCES + [None])], "i int, r string, m string")
    got = df.select("i", unescape_html("r").alias("t"), normalize_whitespace("r").alias("n"), fragment_text(plain_references("m")).alias("f")).collect()
    for row in got:
        r = (REFERENCES + [None])[row.i]
        want = None if r is None else html.unescape(r)
        assert (row.t or "").replace("\xa0", " ") == (want or "").replace("\xa0", " "), r
        if r is not None:
            assert row.n == " ".join(want.split()) and row.f == " ".join(want.split()), r


def test_references_in_attributes_need_a_semicolon(spark):
    page = '<a href="/x?a=1&copy=2&lt=3&eacute;=4">&copy 5</a>'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    row = H.element_tree(df).filter("kind = 'open'").first()
    assert row.attrs["href"] == "/x?a=1&copy=2&lt=3é=4"
    assert H.element_tree(df).filter("kind = 'text'").first().text == "© 5"


@pytest.mark.parametrize("name", ["page_tree", "page_elements", "page_summary"])
def test_plans_stay_small(spark, name):
    from doccat.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert len(plan) < 100_000


def test_python_sees_references_and_tag_names_only(spark):
    """Runs of text stay in the JVM (null pieces); the stack pass gets a page's tag names as one text."""
    import pandas as pd

    from doccat.functions.text import _plain_pieces_udf
    from doccat.operators import html_tree as T
    got = _plain_pieces_udf().func(pd.Series([[None, "&copy;", '<a href="?a=1&copy=2&eacute;">', None, "&"], None]))
    assert got[0] == [None, "©", '<a href="?a=1&copy=2é">', None, "&"] and got[1] is None
    ends = T._tree_udf(ends_only=True).func(pd.Series(["", "ul li  li  /ul  ", " "]))
    assert [list(e) for e in ends] == [[], [5, 2, 2, 4, 4, 5, 6], [0]]
