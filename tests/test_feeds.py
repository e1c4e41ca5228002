import datetime as dt
import json

from pyspark.sql import functions as F

from doccat.sources import feeds as FD
from tests.conftest import rows

def _tree():
    """Two guidelines at different depths; the second has two file groups, the lighter one first in weight."""
    def leaf(code, title, status, groups, **details):
        return {"code": code, "title": title, "description": f"<p>About {title}.</p>", "status": status, "details": details, "fileGroups": groups}

    pdf = {"title": "Guideline", "weight": 1, "files": [{"uri": "https://files.example/S9.pdf", "mimetype": "application/pdf"}]}
    film = {"title": "Training", "weight": 5, "files": [{"uri": "https://files.example/S9.mp4", "mimetype": "video/mp4"}]}
    shallow = leaf("S9", "Oncology animal studies", "Step 5", [film, pdf], stepDate="2 March 2018", infoTitle="", info=[{"text": "no deadline"}])
    deep = leaf("M77", "Vaccine data standards", "Step 3", [], stepDate="14 February 2021", infoTitle="Public consultation",
                info=[{"text": "Deadline for comments by 30 June 2098"}])
    return {"items": [{"bundleInfo": {"updated": "2022-10-05T08:00:00+0100"}, "widgets": {"first": [shallow], "second": {"x": {"y": [{"z": [deep]}]}}}}]}


def test_tree_walk_finds_guidelines_at_every_depth(spark):
    df = spark.createDataFrame([(1, json.dumps(_tree()))], "tree_id long, payload string")
    pages = df.select("tree_id", F.try_variant_get(F.parse_json("payload"), "$.items[0]", "variant").alias("page"))
    objs = FD.walk_objects(pages, "tree_id", "page")
    got = {r["reference_number"]: r for r in FD.ich_catalog(FD.ich_documents(objs, pages, "tree_id"), "tree_id", "2024-06-01").collect()}
    assert set(got) == {"S9", "M77"}
    assert got["S9"]["document_url"] == "https://files.example/S9.pdf" and got["S9"]["comment_end_date"] is None
    assert got["S9"]["title"] == "ICH S9 - Oncology animal studies" and got["S9"]["published_date"] == dt.date(2018, 3, 2)
    assert got["M77"]["comment_end_date"] == dt.date(2098, 6, 30) and got["M77"]["status_normalized"] == "open_for_comment"
    assert got["M77"]["updated_date"] == dt.date(2022, 10, 5) and got["M77"]["summary"] == "About Vaccine data standards."


def test_tree_walk_goes_down_many_levels_in_one_step(spark):
    """A payload is written once per step of many levels, not once per level pair."""
    import os
    deep = {"code": "Z1", "fileGroups": [], "none": None, "empty": {}, "list": [[], [{"a": 1}], "x"]}
    for i in range(10):
        deep = {"items": [deep]} if i % 2 else {"inner": deep, "k": i}
    pages = spark.createDataFrame([(1, json.dumps(deep), "p"), (None, "[[7, {}]]", "q")], "id long, j string, tag string").select(
        "id", F.parse_json("j").alias("page"), "tag")

    def reference(v, path=()):
        """Every object in Python: path and number of its keys."""
        found = [("/".join(path), len(v))] if isinstance(v, dict) else []
        kids = [(f"k:{k}", x) for k, x in v.items()] if isinstance(v, dict) else [(f"i:{i:010d}", x) for i, x in enumerate(v)] if isinstance(v, list) else []
        return found + [o for k, x in kids for o in reference(x, (*path, k))]

    size = F.size(F.map_keys(F.variant_get("obj", "$", "map<string,variant>")))
    base = lambda: {x for d, names, _ in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")) for x in names if x.startswith("rdd-")}
    before = base()
    objs = FD.walk_objects(pages, "id", "page", carry=["tag"])
    assert len(base() - before) == 1
    got = [(r[0], r[1], r[2], r[3]) for r in objs.select("id", "tag", F.array_join("path", "/"), size).collect()]
    want = [(1, "p", *o) for o in reference(deep)] + [(None, "q", "i:0000000000/i:0000000001", 0)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    few = FD.walk_objects(pages, "id", "page", carry=["tag"], levels=3)  # the rest is left to further steps
    assert rows(few.select("id", "tag", F.array_join("path", "/"), size)) == sorted(want, key=repr)
    kept = FD.walk_objects(pages, "id", "page", keep=FD.is_guideline).select(F.variant_get("obj", "$.code", "string"))
    assert [r[0] for r in kept.collect()] == ["Z1"]


def test_fda_list_and_object_rows(spark):
    short = ['<a class="t" href="/guidance/blood-donor-screening"><i>Blood</i> donor &amp; tissue screening</a>', "no file", "1/7/2019", "CBER / OTAT", "",
             "Draft for comment", "y"]
    named = {"title": "<a href='/guidance/inhaled-powders'>Inhaled powders</a>", "field_associated_media_2": '<a href="/files/77">x</a> <a href="/media/901">y</a>',
             "field_issue_datetime": "2017-11-30", "topics-product": "Devices", "field_comment_close_date": "12/1/18", "open-comment": "0"}
    page = json.dumps({"draw": 4, "start": 100, "recordsTotal": 3, "recordsFiltered": 0, "data": [named, None, short]})
    rows_ = FD.fda_paged_rows(spark.createDataFrame([(page,)], "payload string"))
    assert {(r["start"], r["total"]) for r in rows_.collect()} == {(100, 3)}
    first, last = FD.parse_fda_rows(rows_, ["start", "pos"]).orderBy("pos").collect()
    assert (first["guidance_name"], first["issue_date"], first["topic"], first["open_for_comment"]) == ("Inhaled powders", "2017-11-30", "Devices", "No")
    assert first["guidance_page_link"] == "https://www.fda.gov/guidance/inhaled-powders" and first["guidance_pdf_link"] == "https://www.fda.gov/media/901"
    assert first["comment_closing_date_on_draft"] == "2018-12-01" and first["guidance_status"] == "" and first["docket_number"] == ""
    assert (last["guidance_name"], last["issue_date"], last["open_for_comment"]) == ("Blood donor & tissue screening", "2019-01-07", "Yes")
    assert last["guidance_pdf_link"] == "no file" and last["comment_closing_date_on_draft"] == "" and last["fda_organization"] == "CBER / OTAT"


def test_paged_totals_and_tree_rejects(spark):
    import pytest
    page = lambda start, n, total: json.dumps({"start": start, "recordsTotal": total, "data": [["x"]] * n})
    feeds = spark.createDataFrame([("a", page(0, 2, 3)), ("a", page(2, 1, 3)), ("b", page(0, 2, 5)), ("c", page(0, 1, 2)), ("c", page(1, 1, 1)),
                                   ("d", page(0, 1, 1)), ("d", "{cut")], "source string, payload string")
    assert rows(FD.paged_totals(feeds, "source")) == [("a", 3, 2, 3, 0, "ok"), ("b", 5, 1, 2, 3, "mismatch"), ("c", 2, 2, 2, 0, "mismatch"),
                                                      ("d", 1, 2, 1, 0, "mismatch")]
    trees = spark.createDataFrame([(1, json.dumps(_tree())), (2, '{"items": []}'), (3, '{"items": [7]}'), (4, "{"), (5, None), (6, '{"items": {}}')],
                                  "tree_id long, payload string")
    assert [r["tree_id"] for r in FD.tree_pages(trees, "tree_id").collect()] == [1]
    assert rows(FD.tree_rejects(trees, file_col="tree_id"), "file", "reason") == [
        (2, "no page at $.items[0]"), (3, "no page at $.items[0]"), (4, "unreadable JSON"), (5, "unreadable JSON"), (6, "no page at $.items[0]")]
    with pytest.raises(Exception, match="tree payload: no page"):
        FD.tree_pages(trees.filter("tree_id = 2"), "tree_id", strict=True).collect()


def test_ema_feed_rows(spark):
    payload = json.dumps({"meta": {"total_records": "3"}, "data": [
        {"title": "Guideline on X - Scientific guideline", "summary": "", "categories": "Human;Quality",
         "first_published_date": "18/12/2008", "general_url": "https://www.ema.europa.eu/en/x"},
        {"title": "", "general_url": "https://www.ema.europa.eu/en/y"},
        "not an object"]})
    df = spark.createDataFrame([(payload,)], "payload string")
    out = FD.ema_documents(FD.ema_feed_rows(df)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["title"], r["status_raw"], r["status_normalized"]) == ("Guideline on X", "Scientific guideline", "final")
    assert r["published_date"] == dt.date(2008, 12, 18) and r["summary"] == "Not available."


def test_cde_items_area_filter_and_aliases(spark):
    items = [
        {"title": "化学药指导原则", "drugType": "化学药", "publishDate": "20260601", "zdyzIdCODE": "abc"},
        {"Title": "生物制品指导原则", "fclass": "生物制品", "issueDate": "2026-06-02"},
        {"title": "中药指导原则", "drugType": "中药"},
    ]
    df = spark.createDataFrame([(json.dumps(i, ensure_ascii=False),) for i in items], "j string").select(
        F.from_json("j", "map<string,string>").alias("item"))
    out = FD.cde_items(df).orderBy("title").collect()
    assert [r["title"] for r in out] == ["化学药指导原则", "生物制品指导原则"]
    a = [r for r in out if r["title"] == "化学药指导原则"][0]
    assert a["published_date"] == dt.date(2026, 6, 1)
    assert a["source_page_url"] == "https://www.cde.org.cn/zdyz/domesticinfopage?zdyzIdCODE=abc"


def test_unusable_payloads_leave_a_trace_or_raise(spark):
    import pytest

    good = json.dumps({"meta": {}, "data": [{"title": "T", "general_url": "u"}]})
    df = spark.createDataFrame([("a", good), ("b", good[:-2]), ("c", '{"data": {"x": 1}}'), ("d", None)], "file string, payload string")
    got = rows(FD.feed_rejects(df, "$.data"), "file", "reason", "length")
    assert got == [("b", "unreadable JSON", len(good) - 2), ("c", "no list at $.data", 18), ("d", "unreadable JSON", 0)]
    assert FD.ema_feed_rows(df).count() == 1
    for read in (FD.ema_feed_rows, FD.fda_paged_rows):
        with pytest.raises(Exception, match="feed payload: "):
            read(df, strict=True).collect()
        assert len(read(df.filter("file = 'a'"), strict=True).collect()) == 1
    with pytest.raises(Exception, match="no list"):
        FD.fda_static_rows(df.filter("file = 'a'"), strict=True).collect()
