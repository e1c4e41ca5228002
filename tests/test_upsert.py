import datetime as dt

from pyspark.sql import functions as F

from doccat.operators.upsert import delete_by_agency, empty_catalog, to_catalog_batch, upsert
from tests.conftest import rows

COLS = "ord long, title string, agency string, jurisdiction string, source_page_url string, document_url string, " \
       "document_format string, published_date date, updated_date date, comment_start_date date, comment_end_date date, " \
       "status_raw string, status_normalized string, sub_status string, topic_raw string, topic_normalized string, " \
       "product_area string, summary string, language string, reference_number string"


def doc(ord_, title="Guidance A", agency="EMA", summary="s1", url="https://x/a"):
    return (ord_, title, agency, "EU", url, None, None, dt.date(2024, 1, 1), None, None, None, "Final", "final", None,
            None, "other", None, summary, "EN", None)


def batch(spark, docs):
    return to_catalog_batch(spark.createDataFrame(docs, COLS))


def test_new_unchanged_updated(spark):
    c1 = upsert(empty_catalog(spark), batch(spark, [doc(1)]), "2024-06-01 00:00:00")
    assert rows(c1, "change_type") == [("new",)]
    c2 = upsert(c1, batch(spark, [doc(1)]), "2024-06-02 00:00:00")
    r = c2.first()
    assert r["change_type"] == "unchanged"
    assert r["first_seen_at"] == dt.datetime(2024, 6, 1) and r["last_seen_at"] == dt.datetime(2024, 6, 2)
    c3 = upsert(c2, batch(spark, [doc(1, summary="s2")]), "2024-06-03 00:00:00")
    assert rows(c3, "change_type", "summary") == [("updated", "s2")]
    assert len(c3.first()["id"]) == 24


def test_rows_not_in_batch_are_kept(spark):
    c1 = upsert(empty_catalog(spark), batch(spark, [doc(1), doc(2, title="Guidance B")]), "2024-06-01 00:00:00")
    c2 = upsert(c1, batch(spark, [doc(1, summary="s2")]), "2024-06-02 00:00:00")
    assert rows(c2, "title", "change_type") == [("Guidance A", "updated"), ("Guidance B", "new")]


def test_duplicates_in_one_batch_last_write_wins(spark):
    # not in the catalog: first occurrence is new, the second is compared with it
    c = upsert(empty_catalog(spark), batch(spark, [doc(2, summary="late"), doc(1, summary="early")]), "2024-06-01 00:00:00")
    assert rows(c, "summary", "change_type") == [("late", "updated")]
    c = upsert(empty_catalog(spark), batch(spark, [doc(1), doc(2)]), "2024-06-01 00:00:00")
    assert rows(c, "change_type") == [("unchanged",)]


def test_upsert_twice_all_unchanged_and_partition_order_free(spark):
    docs = [doc(i, title=f"T{i}", summary=f"s{i % 7}") for i in range(60)]
    b = batch(spark, docs)
    c1 = upsert(empty_catalog(spark), b, "2024-06-01 00:00:00")
    c2 = upsert(c1, b.repartition(5), "2024-06-02 00:00:00")
    c2b = upsert(c1, b.repartition(3, "title").orderBy(F.rand(7)), "2024-06-02 00:00:00")
    assert set(r[0] for r in c2.select("change_type").collect()) <= {"unchanged", "updated"}
    assert rows(c2.drop("first_seen_at", "last_seen_at")) == rows(c2b.drop("first_seen_at", "last_seen_at"))
    c3 = upsert(c2, b, "2024-06-03 00:00:00")
    assert set(r[0] for r in c3.select("change_type").collect()) == {"unchanged"}


def test_delete_by_agency_upper_cases(spark):
    c = upsert(empty_catalog(spark), batch(spark, [doc(1), doc(2, title="B", agency="FDA")]), "2024-06-01 00:00:00")
    remaining, deleted = delete_by_agency(c, "ema")
    assert rows(remaining, "agency") == [("FDA",)]
    assert deleted.first()["deleted"] == 1


def test_broadcast_id_path_equals_full_outer_path(spark):
    docs1 = [doc(i, title=f"T{i}", summary=f"s{i % 3}") for i in range(40)]
    docs2 = [doc(i, title=f"T{i}", summary=f"s{i % 4}") for i in range(20, 50)] + [doc(100, title="T21", summary="late")]
    c1 = upsert(empty_catalog(spark), batch(spark, docs1), "2024-06-01 00:00:00")
    a = upsert(c1, batch(spark, docs2), "2024-06-02 00:00:00", broadcast_ids_limit=2_000_000)
    b = upsert(c1, batch(spark, docs2), "2024-06-02 00:00:00")
    assert rows(a) == rows(b)
    assert a.count() == 50
