"""Documents of configured source pages: own pages with two areas, several sections and files."""

import datetime as dt

import pytest

from doccat.operators.pmda import pmda_documents

OPEN_URL = "https://www.pmda.go.jp/english/test/open.html"
GATED_URL = "https://www.pmda.go.jp/english/test/gated.html"


def item(number, title, after=""):
    return f'<li><a href="/files/{number}.pdf">{title}</a>{after}</li>'


def section(level, name, *parts):
    return f"<{level}>{name}</{level}>" + "".join(parts)


OPEN_PAGE = "<main>" + section(
    "h2", "Regulations and Notifications",
    section("h4", "Stability", "<ul>", item("100200300", "Shelf life of tablets [12.5MB]"), "</ul><p>May 9, 2019 Division Memo No. 7</p>"),
    section("h4", "Pharmacokinetics", "<ul>", item("100200301", "Dose ranging (Early Consideration) [7KB]", "<br>July 3, 2022 Office Memo"), "</ul>"),
    section("h4", "Undated", "<ul>", item("100200302", "Storage of samples"), "</ul>"),
) + section("h2", "Archive", '<a href="/files/old.pdf">Old paper</a>') + "</main>"

GATED_PAGE = "<main>" + section(
    "h2", "Regulations and Notifications",
    section("h3", "Devices", section("h4", "Software", "<ul>", item("555", "Out of the parent"), "</ul>")),
    section("h3", "Plasma", section("h4", "Software", "<ul>", item("556", "Donor selection vaccine record"), "</ul><p>June 30, 2015 Notice A</p>"),
            section("h4", "Labels", "<ul>", item("557", "Out of the sections"), "</ul>")),
) + "</main>"


def sources(spark):
    return spark.createDataFrame([(0, OPEN_URL, "Generic drugs", None, None), (1, GATED_URL, "Plasma", ["Software"], "Plasma")],
                                 "src_ord int, url string, product_area string, allowed_sections array<string>, required_parent string")


def pages(spark, items):
    return spark.createDataFrame(items, "url string, html string")


def test_sections_dates_and_gates(spark):
    d = pmda_documents(pages(spark, [(OPEN_URL, OPEN_PAGE), (GATED_URL, GATED_PAGE)]), sources(spark))
    got = [(r["reference_number"], r["title"], r["published_date"], r["status_raw"], r["needs_manual_review"], r["topic_raw"])
           for r in d.orderBy("page_id", "pos").collect()]
    assert got == [
        ("100200300", "Shelf life of tablets", dt.date(2019, 5, 9), "Division Memo No. 7", False, "Generic drugs / Stability"),
        ("100200301", "Dose ranging (Early Consideration)", dt.date(2022, 7, 3), "Office Memo", False, "Generic drugs / Pharmacokinetics"),
        ("100200302", "Storage of samples", None, None, True, "Generic drugs / Undated"),
        ("556", "Donor selection vaccine record", dt.date(2015, 6, 30), "Notice A", False, "Plasma / Software"),
    ]
    early = d.filter("reference_number = '100200301'").first()
    assert early["sub_status"] == "early_consideration" and early["document_format"] == "PDF"
    assert early["document_url"] == "https://www.pmda.go.jp/files/100200301.pdf"


def test_dedupe_and_missing_page(spark):
    again = GATED_PAGE.replace("/files/556.pdf", "/files/100200300.pdf")
    with pytest.raises(ValueError, match="no in-scope documents"):  # its only row is a copy of the first page's
        pmda_documents(pages(spark, [(OPEN_URL, OPEN_PAGE), (GATED_URL, again)]), sources(spark))
    assert pmda_documents(pages(spark, [(OPEN_URL, OPEN_PAGE), (GATED_URL, again)]), sources(spark), strict=False).count() == 3
    with pytest.raises(ValueError, match="missing required source page"):
        pmda_documents(pages(spark, [(OPEN_URL, OPEN_PAGE)]), sources(spark))


def test_lists_match_their_own_closing_tags(spark):
    """A link between two lists has no list; a nested list does not end the list around it."""
    page = "<main></ul>" + section(
        "h2", "Regulations and Notifications",
        section("h4", "Between", "<ul>", item("600", "First of a list"), "</ul><p>May 9, 2019 Memo A</p>", '<a href="/files/601.pdf">Stands alone</a>',
                "<ul>", item("602", "Second of a list"), "</ul><p>June 1, 2020 Memo B</p>"),
        section("h4", "Nested", "<ul>", item("603", "Holds a list", "<ul>" + item("604", "Within the list") + "</ul>"), item("605", "After the inner list"),
                "</ul><p>July 2, 2021 Memo C</p>"),
    ) + "</main>"
    d = pmda_documents(pages(spark, [(OPEN_URL, page)]), sources(spark).limit(1))
    got = [(r["reference_number"], r["published_date"], r["status_raw"]) for r in d.orderBy("page_id", "pos").collect()]
    assert got == [
        ("600", dt.date(2019, 5, 9), "Memo A"), ("601", None, None), ("602", dt.date(2020, 6, 1), "Memo B"),
        ("603", dt.date(2021, 7, 2), "Memo C"), ("604", None, None), ("605", dt.date(2021, 7, 2), "Memo C"),
    ]


def test_pages_of_one_url_belong_to_their_own_sources(spark):
    """Two sources of one URL: each reads the page landed for it."""
    other = OPEN_PAGE.replace("/files/1002003", "/files/9002003").replace("Shelf life", "Second shelf life")
    landed = spark.createDataFrame([(OPEN_URL, OPEN_PAGE, 0), (OPEN_URL, other, 1)], "url string, html string, src_ord int")
    configured = spark.createDataFrame([(0, OPEN_URL, "A", None, None), (1, OPEN_URL, "B", ["Stability"], None)],
                                       "src_ord int, url string, product_area string, allowed_sections array<string>, required_parent string")
    got = [(r["page_id"], r["reference_number"], r["title"]) for r in pmda_documents(landed, configured).orderBy("page_id", "pos").collect()]
    assert got == [(0, "100200300", "Shelf life of tablets"), (0, "100200301", "Dose ranging (Early Consideration)"),
                   (0, "100200302", "Storage of samples"), (1, "900200300", "Second shelf life of tablets")]
    with pytest.raises(ValueError, match="missing required source page"):
        pmda_documents(landed.filter("src_ord = 0"), configured)
