from pyspark.sql import functions as F

from doccat.operators import html as H
from tests.conftest import rows

BOILER = "<p>Search for FDA Guidance Documents and contains non-binding recommendations for industry readers here.</p>"
SUMMARY = "This guidance describes the design and analysis of adaptive clinical trials for drugs and biologics sponsors."


def page(spark, html, url="https://www.fda.gov/regulatory-information/x"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_paragraph_rule_and_script_strings(spark):
    html = '<script>var t="</p>";</script><p>One <b>two<br><p>Three &amp; four</p><article><p>Five</article>'
    df = page(spark, html).select(H.paragraphs(F.col("html")).alias("p"))
    assert df.first()["p"] == ["One two", "Three & four", "Five"]


def test_summary_skips_boilerplate_and_prefers_containers(spark):
    html = f"<body><p>{SUMMARY} outside</p><main>{BOILER}<p>short</p><p>{SUMMARY}</p></main></body>"
    assert page(spark, html).select(H.page_summary(F.col("html")).alias("s")).first()["s"] == SUMMARY
    nested = f'<div role="main"><div><p>{SUMMARY} A</p></div><p>{SUMMARY} B</p></div><article><p>{SUMMARY} C</p></article>'
    assert page(spark, nested).select(H.page_summary(F.col("html")).alias("s")).first()["s"] == SUMMARY + " A"


def test_pdf_attachment_and_result_count(spark):
    html = ('<a href="/en/documents/other.html">x</a><a href="/en/documents/scientific-guideline/g_en.pdf">PDF</a>'
            '<a href="/main/att/download/downloadAtt?id=1">附件.pdf</a>'
            '<a class="facet is-active" data-drupal-facet-item-value="004_ema_guidance_and_info" '
            'data-drupal-facet-item-count="2,069">G</a>')
    df = page(spark, html, "https://www.ema.europa.eu/en/x").select(
        H.first_pdf_link(F.col("html"), F.col("url")).alias("pdf"),
        H.first_attachment(F.col("html"), F.lit("https://www.cde.org.cn")).alias("att"),
        H.result_count(F.col("html")).alias("n"))
    r = df.first()
    assert r["pdf"] == "https://www.ema.europa.eu/en/documents/scientific-guideline/g_en.pdf"
    assert r["att"]["url"] == "https://www.cde.org.cn/main/att/download/downloadAtt?id=1"
    assert r["att"]["format"] == "PDF"
    assert r["n"] == 2069
    heading = page(spark, "<h1>Search results (2,069)</h1>").select(H.result_count(F.col("html")).alias("n"))
    assert heading.first()["n"] == 2069


def test_protection_page(spark):
    df = spark.createDataFrame([("<html>$_ts=1</html>",), ("x" * 6000 + "$_ts",), ("<html>plain</html>",)], "html string")
    assert [r[0] for r in df.select(H.looks_like_protection_page(F.col("html"))).collect()] == [True, True, False]


def test_current_version_status(spark):
    html = ('<div class="paragraph--type--ema-documents"><h3>Document history</h3><div class="file-metadata">'
            '<div class="file-metadata-row"><span class="value">Draft</span></div></div></div>'
            '<div class="paragraph--type--ema-documents"><h2>Current version</h2><div class="file-metadata">'
            '<div class="file-metadata-row"><span class="label">Status</span><span class="value">x</span></div>'
            '<div class="file-metadata-row"><span class="value">Adopted</span></div></div></div>')
    assert page(spark, html).select(H.current_version_status(F.col("html")).alias("s")).first()["s"] == "Adopted"


OUTLINE = """<body><h2>Part one</h2><a href="/1">first</a><h4>Deep</h4><a href="/2">second</a><h3>Middle</h3>
<ol><li><a href="/3">third</a></li></ol><h4>Deeper</h4><a href="/4">fourth</a><h2>Part two</h2><p><a href="/5">fifth</a></p></body>"""


def test_heading_carry_forward_resets_lower_levels(spark):
    el = H.element_table(page(spark, OUTLINE, "https://x.example/outline.html"))
    ev = H.heading_events(el, "page_id", ["h2", "h3", "h4"], "a")
    out = H.carry_forward(ev, "page_id", ["h2", "h3", "h4"], "a")
    got = [(r["href"], r["h2_text"], r["h3_text"], r["h4_text"]) for r in out.orderBy("pos").collect()]
    assert got == [("/1", "Part one", "", ""), ("/2", "Part one", "", "Deep"), ("/3", "Part one", "Middle", ""),
                   ("/4", "Part one", "Middle", "Deeper"), ("/5", "Part two", "", "")]


def test_carry_forward_chunked_equals_single_pass(spark):
    import random
    rnd = random.Random(3)
    tags = ["system", "user", "assistant"]
    data = [(1 if i < 400 else 2, i, rnd.choice(tags), f"t{i}") for i in range(600)]
    ev = spark.createDataFrame(data, "conv_id long, pos long, tag string, text string")
    a = H.carry_forward(ev, "conv_id", ["system", "user"], "assistant")
    b = H.carry_forward(ev, "conv_id", ["system", "user"], "assistant", chunk_size=7)
    assert rows(a) == rows(b)
    # brute force
    want = []
    state = {}
    for cid, pos, tag, text in data:
        st = state.setdefault(cid, {"system": "", "user": ""})
        if tag == "system":
            st["system"], st["user"] = text, ""
        elif tag == "user":
            st["user"] = text
        else:
            want.append((cid, pos, text, st["system"], st["user"]))
    assert rows(a) == sorted(want, key=repr)


def test_attachment_reads_its_page_once(spark):
    """The page and its first link are bound: the expressions that read them do not repeat the search."""
    from pyspark.sql import functions as F
    from doccat.operators import html as H
    df = spark.createDataFrame([('<a href="/x">n</a><a href="downloadAtt/1">f.docx</a>', "https://h.example/a/"), ("<p>x</p>", "https://h.example/")],
                               "html string, url string").repartition(1)
    out = df.select(H.first_attachment(F.col("html"), F.col("url")).alias("a"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("downloadAtt") == 1
    got = [r["a"] and (r["a"]["url"], r["a"]["format"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([("https://h.example/a/downloadAtt/1", "DOCX"), None], key=repr)


def test_heading_events_make_elements_once(spark):
    """Texts and events come from one pass over the elements: no join, and the page's tokens stand in the plan once."""
    page = "<a href='/0'>before</a><h2>One <b>two</b> <a href='/1'>three</a></h2><p>body</p><h3></h3><a href='/2'>x</a><h2>open<h3>Last"
    df = spark.createDataFrame([(7, page), (None, "<h2>none</h2>"), (8, "text only"), (9, None)], "page_id long, html string")
    ev = H.heading_events(H.element_table(df), "page_id", ["h2", "h3"], "a")
    plan = ev._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    got = sorted(map(tuple, ev.filter("page_id = 7").select("pos", "tag", "text", "href").collect()))
    assert [g[1:] for g in got] == [("a", "", "/0"), ("h2", "One two three", ""), ("a", "", "/1"), ("h3", "", ""), ("a", "", "/2"),
                                    ("h2", "open", ""), ("h3", "Last", "")]
    assert [tuple(r) for r in ev.filter("page_id IS NULL OR page_id > 7").collect()] == [(None, 0, "h2", "", "")]
