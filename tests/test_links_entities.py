"""Anchors in every quoting, character references and dot segments: expected values from the standard library."""

import html
from urllib.parse import urljoin

from pyspark.sql import functions as F

from doccat.functions.text import unescape_html
from doccat.functions.urls import absolute_url, absolute_url_col
from doccat.operators import html as H
from doccat.sources import feeds

PAGE = """<a data-href="/no" href='/q.pdf'>one</a> <A class=x HREF=/plain/x.pdf>two</A>
<a title="a > b" href="/d?a=1&amp;b=2.pdf">three &#8217;s caf&eacute;</a> <a name="top">none</a> <a href="">empty</a>
<a href='../up/./documents/f.pdf' target=_blank>four</a> <abbr href="/abbr">no anchor</abbr>"""


def test_anchors(spark):
    df = spark.createDataFrame([(PAGE, "https://x.org/a/b/c.html")], "h string, u string")
    got = [(r.href, r.text) for r in df.select(F.explode(H.links(F.col("h"), F.col("u"))).alias("l")).select("l.*").collect()]
    assert got == [("https://x.org/q.pdf", "one"), ("https://x.org/plain/x.pdf", "two"), ("https://x.org/d?a=1&b=2.pdf", "three ’s café"),
                   ("https://x.org/a/b/c.html", "empty"), ("https://x.org/a/up/documents/f.pdf", "four")]
    assert df.select(H.first_pdf_link(F.col("h"), F.col("u"))).first()[0] == "https://x.org/a/up/documents/f.pdf"
    assert df.select(feeds.cell_links(F.col("h"), "https://x.org/")).first()[0] == [
        "https://x.org/q.pdf", "https://x.org/plain/x.pdf", "https://x.org/d?a=1&b=2.pdf", "https://x.org/up/documents/f.pdf"]
    assert df.select(F.regexp_extract("h", feeds.FIRST_HREF, 1)).first()[0] == "'/q.pdf'"


def test_character_references(spark):
    texts = ["&#8217; &rsquo; caf&eacute;", "&amp;eacute; &amp;amp;", "&#x1F600;&#150;&#0;&#xD800;", "&nosuch; & &; &#; &lt;b&gt;", "plain", "",
             "&#39;a&#39; &quot;", "&hellip;&NotEqualTilde;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(unescape_html("t")).collect()]
    assert [g.replace("\xa0", " ") for g in got] == [html.unescape(t).replace("\xa0", " ") for t in texts]


def test_dot_segments(spark):
    base = "https://x.org/a/b/c.html"
    refs = ["../z.pdf", "./z.pdf", "../../../z", "/a/../b/./c", "d/../..", "..", ".", "../?q=../x", "x..y/.z", "/a/b/..", "/..", "../a/../b#f/../g", "p/q/"]
    df = spark.createDataFrame([(r, base) for r in refs], "r string, b string")
    want = [urljoin(base, r) for r in refs]
    assert [x[0] for x in df.select(absolute_url(F.col("r"), base)).collect()] == want
    assert [x[0] for x in df.select(absolute_url_col(F.col("r"), F.col("b"))).collect()] == want


def test_urls_are_computed_once(spark):
    """A link is read by every case of its resolution, but computed once."""
    from pyspark.sql import functions as F

    from doccat.functions.urls import absolute_url, absolute_url_col
    df = spark.createDataFrame([("mark../b/./c?x", "https://h.example/a/d/e"), ("mark", "https://h.example/a")], "t string, base string")
    href = F.regexp_extract("t", "mark(.*)", 1)
    for got, want in ((absolute_url(href, "https://h.example/a/d/e"), ["https://h.example/a/b/c?x", "https://h.example/a/d/e"]),
                      (absolute_url_col(href, F.col("base")), ["https://h.example/a/b/c?x", "https://h.example/a"])):
        out = df.repartition(1).select(got.alias("u"))
        assert out._jdf.queryExecution().optimizedPlan().toString().count("mark(") == 1
        assert sorted(r["u"] for r in out.collect()) == sorted(want)
