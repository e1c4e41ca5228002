import datetime as dt
import tempfile
import uuid

from pyspark.sql import functions as F

from doccat.operators import export as EX
from doccat.operators import search as OP
from doccat.operators.store import read_current, versions
from tests.conftest import rows


def test_csv_projection_falsy_values(spark):
    df = spark.createDataFrame([(True, None, dt.date(2024, 1, 2)), (False, "x", None)], "b boolean, s string, d date")
    types = {f.name: f.dataType for f in df.schema.fields}
    out = df.select(*[EX.falsy_to_text(F.col(c), types[c]).alias(c) for c in df.columns])
    assert rows(out) == [("", "x", ""), ("True", "", "2024-01-02")]


def test_csv_round_trip_with_missing_input(spark):
    base = tempfile.mkdtemp(prefix="doccat-csv-")
    df = spark.createDataFrame([("FDA", "A, with comma", ""), ("EMA", 'quote "q"', "x")], "`Health Authority` string, `Guidance Name` string, `Topic` string")
    EX.write_csv(df, f"{base}/a.csv")
    back, missing = EX.read_csv_exports(spark, [f"{base}/a.csv", f"{base}/missing.csv"])
    assert missing == [f"{base}/missing.csv"]
    assert rows(back) == rows(df)
    none, missing = EX.read_csv_exports(spark, [f"{base}/nothing.csv"])
    assert none is None and missing == [f"{base}/nothing.csv"]


def test_snapshot_bootstrap(spark):
    base = tempfile.mkdtemp(prefix="doccat-snap-")
    spark.range(3).write.parquet(f"{base}/snapshot")
    assert EX.bootstrap_from_snapshot(spark, f"{base}/db", f"{base}/snapshot") is True
    assert EX.bootstrap_from_snapshot(spark, f"{base}/db", f"{base}/snapshot") is False
    assert EX.bootstrap_from_snapshot(spark, f"{base}/db2", f"{base}/absent") is False
    assert spark.read.parquet(f"{base}/db").count() == 3


def test_selection_keeps_valid_positions(spark):
    df = spark.createDataFrame([("A", "EMA"), ("B", "FDA")], "title string, agency string").withColumn("k", F.col("title"))
    idx = EX.with_row_index(df, "k")
    sel = spark.createDataFrame([(0, 1), (1, 99), (2, None)], "pick int, value long")
    out = EX.selected_rows(idx, sel)
    assert rows(out, "pick", "title") == [(0, "B")]
    assert "last_seen_at" not in out.columns


def test_refresh_status(spark):
    df = spark.createDataFrame([("EMA", "2026-06-24T09:15:00Z"), ("FDA", "2026-06-25T03:30:00"),
                                ("FDA", "bad"), (None, "2026-01-01T00:00:00")], "agency string, last_seen_at string")
    st = OP.refresh_status(df)
    assert rows(st) == [("EMA", 1, "2026-06-24 09:15 UTC"), ("FDA", 2, "2026-06-25 03:30 UTC")]
    assert OP.refresh_status_text(st).first()[0] == "Last crawled by agency: EMA 2026-06-24 09:15 UTC | FDA 2026-06-25 03:30 UTC"


def test_text_search_spans_columns(spark):
    df = spark.createDataFrame([("Adaptive designs", "about trials"), ("Other", None)], "title string, summary string")
    assert rows(OP.text_filter(df, ["title"], "ADAPTIVE"), "title") == [("Adaptive designs",)]
    assert rows(OP.text_filter(df, ["title", "summary"], "designs about"), "title") == [("Adaptive designs",)]


def test_stream_upsert_batches_and_replay(spark):
    from doccat.plans.q_stream import land_runs
    from doccat.plans.q_upsert import catalog_after_v2
    from doccat.streaming.upsert_stream import stream_upsert
    sf = "/root/testdata/sf0.001"
    base = tempfile.mkdtemp(prefix="doccat-stream-")
    land_runs(spark, sf, f"{base}/landing", which=(1,))
    schema = spark.read.parquet(f"{base}/landing").schema
    stream_upsert(spark, f"{base}/landing", schema, f"{base}/catalog", f"{base}/ckpt")
    assert len(versions(spark, f"{base}/catalog")) == 1
    land_runs(spark, sf, f"{base}/landing", which=(2,))
    stream_upsert(spark, f"{base}/landing", schema, f"{base}/catalog", f"{base}/ckpt")
    n_versions = len(versions(spark, f"{base}/catalog"))
    assert n_versions == 2
    # replay with the same checkpoint: nothing new is committed
    stream_upsert(spark, f"{base}/landing", schema, f"{base}/catalog", f"{base}/ckpt")
    assert len(versions(spark, f"{base}/catalog")) == n_versions
    got = read_current(spark, f"{base}/catalog").select("id", "change_type", "summary")
    want = catalog_after_v2(spark, sf).select("id", "change_type", "summary")
    assert rows(got) == rows(want)


ODD_CSV = ('\ufeffname,text,n\r\n"a ""q"", b","line one\nline two\r\nthree",1\r\nplain,,2\r\n\r\n"","x, ""y""\n\n"" z",\r\nshort\r\n"é","\n",3\r\n'
           + "".join(f'r{i},"{"long " * (i % 7)}{chr(10) * (i % 3)}end ""{i}""",{i}\r\n' for i in range(400)) + 'last,"no end"" of line",9')


def test_large_csv_equals_multi_line_reader(spark):
    from doccat.sources.csv_lines import read_large_csv
    base = tempfile.mkdtemp(prefix="doccat-csv-")
    with open(f"{base}/a.csv", "w", encoding="utf-8", newline="") as f:
        f.write(ODD_CSV)
    want = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{base}/a.csv")
    want = want.toDF(*[c.lstrip("\ufeff") for c in want.columns])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("200", "1000", "128MB"):  # splits that cut inside records, and one split
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = read_large_csv(spark, f"{base}/a.csv")
            assert got.columns == want.columns == ["name", "text", "n"]
            if size != "128MB":
                assert spark.read.option("lineSep", "\n").text(f"{base}/a.csv").rdd.getNumPartitions() > 8
            assert rows(got) == rows(want) and len(rows(want)) == 406
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_run_rewrites_only_the_buckets_it_touches(spark):
    import glob

    from doccat.operators import store
    from doccat.operators.catalog_schema import CATALOG_SCHEMA
    from doccat.operators.upsert import empty_catalog, to_catalog_batch, upsert
    from doccat.streaming.upsert_stream import apply_runs
    base = tempfile.mkdtemp(prefix="doccat-buckets-")

    def run(ids, ts, mark):
        made = spark.createDataFrame([(f"id{i}", f"T{i}", "FDA", "US", "unknown", f"{mark}{i % 5}") for i in ids],
                                     "id string, title string, agency string, jurisdiction string, status_normalized string, summary string")
        for f in CATALOG_SCHEMA.fields:
            if f.name not in made.columns and f.name not in ("content_hash", "first_seen_at", "last_seen_at", "change_type"):
                made = made.withColumn(f.name, F.lit(False if f.name == "needs_manual_review" else None).cast(f.dataType))
        return to_catalog_batch(made.withColumn("ord", F.lit(1))).withColumn("run_ts", F.lit(ts).cast("timestamp_ntz"))

    of = {r[0]: r[1] for r in spark.range(2000).select("id", store.bucket_of(F.concat(F.lit("id"), F.col("id").cast("string")), 100)).collect()}
    hit = [i for i, b in of.items() if b == of[7]]
    steps = [(range(2000), "2024-01-01 00:00:00", "a"), (hit[:5], "2024-01-02 00:00:00", "b"), (hit[:2], "2024-01-03 00:00:00", "b"),
             ([3000], "2024-01-04 00:00:00", "c"), (range(0, 2000, 2), "2024-01-05 00:00:00", "a")]
    want = empty_catalog(spark)
    for n, (ids, ts, mark) in enumerate(steps):
        apply_runs(spark, run(ids, ts, mark), f"{base}/c", "s", n, buckets=100)
        want = spark.createDataFrame(upsert(want, run(ids, ts, mark).drop("run_ts"), F.lit(ts).cast("timestamp_ntz")).collect(), CATALOG_SCHEMA)
        apply_runs(spark, run(ids, ts, mark), f"{base}/c", "s", n, buckets=100)  # a replay commits nothing
    assert store.versions(spark, f"{base}/c") == [1, 2, 3, 4, 5]

    def files(version):
        return len(glob.glob(f"{base}/c/data/{version}-*/*/*.parquet"))

    assert files(1) == 100 and files(2) == files(3) == files(4) == 1 and files(5) == 100
    assert rows(store.read_current(spark, f"{base}/c", CATALOG_SCHEMA)) == rows(want)
    log = store.change_log(spark, f"{base}/c", CATALOG_SCHEMA)
    assert rows(store.fold_log(log), *want.columns) == rows(want)
    assert {(r.version, r.change_type): r.n for r in log.groupBy("version", "change_type").agg(F.count("*").alias("n")).collect()} == {
        (1, "new"): 2000, (2, "updated"): 5, (3, "unchanged"): 2, (4, "new"): 1,
        (5, "updated"): sum(i % 2 == 0 for i in hit[:5]), (5, "unchanged"): 1000 - sum(i % 2 == 0 for i in hit[:5])}


def test_unfinished_commit_does_not_count(spark):
    import os

    from doccat.operators import store
    base = tempfile.mkdtemp(prefix="doccat-commit-")
    store.write_version(spark.range(3).withColumn("agency", F.lit("X")), base, 1)
    with open(f"{base}/commits/2.json", "w") as f:
        f.write('{"folder": "data/2')
    assert store.versions(spark, base) == [1] and read_current(spark, base).count() == 3
    os.remove(f"{base}/commits/.2.json.crc") if os.path.exists(f"{base}/commits/.2.json.crc") else None
    store.write_version(spark.range(4).withColumn("agency", F.lit("X")), base, 2)
    assert store.versions(spark, base) == [1, 2] and read_current(spark, base).count() == 4


def _catalog_rows(spark, made):
    """Batch rows (id, ord, summary) with every catalog column."""
    from doccat.operators.catalog_schema import CATALOG_SCHEMA
    from doccat.operators.upsert import to_catalog_batch
    df = spark.createDataFrame(made, "id string, ord long, summary string").withColumns(
        {"agency": F.lit("FDA"), **{c: F.lit("T") for c in ("title", "jurisdiction", "status_normalized")}})
    for f in CATALOG_SCHEMA.fields:
        if f.name not in df.columns and f.name not in ("content_hash", "first_seen_at", "last_seen_at", "change_type"):
            df = df.withColumn(f.name, F.lit(False if f.name == "needs_manual_review" else None).cast(f.dataType))
    return to_catalog_batch(df)


def test_merge_in_buckets_equals_the_upsert(spark):
    from doccat.operators import store
    from doccat.operators.catalog_schema import CATALOG_SCHEMA
    from doccat.operators.upsert import CATALOG_COLUMNS, empty_catalog, last_two_per_id, prepare_batch, upsert, upsert_in_buckets
    one = _catalog_rows(spark, [("a", 1, "x"), ("b", 1, None), ("b", 2, "y"), ("c", 1, "z"), ("d", 1, "q")])
    two = _catalog_rows(spark, [("a", 5, "x"), ("b", 4, "n"), ("b", 3, "y"), ("b", 5, "n"), ("c", 9, "w"), ("e", 1, None), ("f", 1, "1"), ("f", 2, "2")])
    want, got, bucket = empty_catalog(spark), empty_catalog(spark), store.bucket_of(F.col("id"), 3)
    for batch, ts in ((one, "2024-01-01 00:00:00"), (two, "2024-01-02 00:00:00")):
        assert rows(upsert(None, batch, ts)) == rows(upsert(empty_catalog(spark), batch, ts))
        want = spark.createDataFrame(upsert(want, batch, ts).collect(), CATALOG_SCHEMA)
        merged = upsert_in_buckets(got, prepare_batch(batch), ts, bucket, 3, "_bucket")
        cut = upsert_in_buckets(got, last_two_per_id(prepare_batch(batch)), ts, bucket, 3, "_bucket")
        assert rows(merged, *CATALOG_COLUMNS) == rows(cut, *CATALOG_COLUMNS) == rows(want)
        got = spark.createDataFrame(merged.select(*CATALOG_COLUMNS).collect(), CATALOG_SCHEMA)
    assert {r.id: r.change_type for r in want.collect()} == {"a": "unchanged", "b": "unchanged", "c": "updated", "d": "new", "e": "new", "f": "updated"}


def test_rows_of_a_run_are_written_and_shuffled_once(spark):
    import os

    from doccat.operators import store
    from doccat.operators.catalog_schema import CATALOG_SCHEMA
    from doccat.operators.upsert import prepare_batch, upsert, upsert_in_buckets
    from doccat.streaming.upsert_stream import apply_runs
    root = f"{tempfile.mkdtemp(prefix='doccat-once-')}/c"
    for n, made in enumerate(([(f"k{i}", 1, "x") for i in range(50)], [("k1", 1, "y"), ("n", 1, "x")])):
        batch = _catalog_rows(spark, made).withColumn("run_ts", F.lit(f"2024-01-0{n + 1} 00:00:00").cast("timestamp_ntz"))
        apply_runs(spark, batch, root, "s", n, buckets=2)
    assert sorted(os.listdir(root)) == ["commits", "data"]  # the log names the data files
    log = store.change_log(spark, root, CATALOG_SCHEMA)
    assert rows(log.groupBy("version", "change_type").count()) == [(1, "new", 50), (2, "new", 1), (2, "updated", 1)]
    assert rows(store.fold_log(log)) == rows(store.read_current(spark, root).select(*CATALOG_SCHEMA.names))
    current, batch = store.read_current(spark, root, CATALOG_SCHEMA), _catalog_rows(spark, [("k1", 1, "z")])

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    bucket = store.bucket_of(F.col("id"), 2)
    assert exchanges(upsert_in_buckets(current, prepare_batch(batch), "2024-01-03 00:00:00", bucket, 2, "_bucket")) == 1
    assert exchanges(upsert(upsert(None, batch, "2024-01-01 00:00:00"), batch, "2024-01-02 00:00:00")) == 2  # one per batch
