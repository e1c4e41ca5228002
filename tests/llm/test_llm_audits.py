"""Periodic runs, WARC archives and the filter audit: plain versions, round trips and edge cases."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from doccat.llm import filter_audit, queries, runs, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every period by itself: maximal stretches of words equal to the word a period on."""
    found = set()
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and not any((i, j + q) == (s, s + n) for s, n, _ in found):
                found.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(key, text):
    words = WORD.findall(text or "")
    if key is not None and words:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    top = [r for r in found if all(r[1] * x[2] >= x[1] * r[2] for x in found)][:1]
    return (key, len(found), *([*top[0], 1000 * top[0][1] // top[0][2]] if top else [None] * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def _made(rng):
    words = []
    while rng.random() < 0.85 and len(words) < 400:
        if rng.random() < 0.4:
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        elif rng.random() < 0.7:
            unit = [rng.choice("ab" if rng.random() < 0.5 else "abcdefghijklm") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 20, 33]))]
            k = rng.randint(1, 60 // len(unit) + 4)
            words += (unit * (k + 1))[:len(unit) * k + rng.randint(0, len(unit))]
        else:
            at = rng.randint(0, len(words))
            words += words[at:at + rng.randint(0, 100)] * rng.randint(1, 4)
    return words


def test_runs_equal_brute_force():
    rng = random.Random(11)
    batches = [[_made(rng) for _ in range(rng.randint(1, 6))] for _ in range(150)]
    assert sum(len(plain_runs(d)) for b in batches for d in b) > 500
    for docs in batches:
        assert runs.runs_of([[w.encode() for w in d] for d in docs]) == [plain_runs(d) for d in docs]
    nested = (list("abcde") * 12 + ["x"]) * 5
    assert runs.runs_of([[w.encode() for w in nested]])[0] == plain_runs(nested)
    assert runs.runs_of([[b"a"] * 50_000, []]) == [[(0, 50_000, 1)], []]


def test_grammar_has_no_repeated_pair_left():
    import numpy as np

    rng = random.Random(3)
    words = [rng.choice("abc") for _ in range(3000)]
    sym = np.array([ord(w) for w in words])
    rule, start, mid, end, left = runs.repair(sym, np.zeros(len(sym), dtype=np.int64))
    spans = list(zip(left.tolist(), [*left.tolist()[1:], len(words)]))
    pairs = ["".join(words[a:b]) + "|" + "".join(words[b:c]) for (a, b), (_, c) in zip(spans, spans[1:])]
    assert len(set(pairs)) >= len(pairs) - 2  # places that overlap themselves may remain
    for r in set(rule.tolist()):
        assert len({"".join(words[a:b]) for k, a, b in zip(rule.tolist(), start.tolist(), end.tolist()) if k == r}) == 1


def test_run_rows_of_documents(spark):
    texts = [None, "", " \n\t ", "one two three", "a " * 23, "a " * 24, "x y " * 12 + "z " * 30, "é\x0bü\x85 \r" * 30, "w" * 9000 + " v" * 40,
             " ".join(str(i % 40) for i in range(121)), " ".join(str(i % 40) for i in range(119))] + [" ".join(str(i) for i in range(200))] * 2
    rows = [(i, t, "s", 7) for i, t in enumerate(texts * 3)] + [(None, texts[5], "s", 7), (4, texts[4], "s", 7), (4, texts[4], "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = runs.find_runs(docs, rewrite=runs.plant_period).drop("runs")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_row(r[0], r[1]) for r in rows), key=repr)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[1])
    assert runs.find_runs(docs.limit(0)).collect() == []


def test_op11_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.queries()["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 12_000}
    assert len(got) == len(docs) and len(short) > 150
    assert sorted(tuple(r) for r in got if r.doc_id in short) == sorted(plain_row(k, t) for k, t in short.items())


def _base32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [(1, "http://a/1", "<p>same"), (2, "http://a/2 b\n", "<p>same"), (3, None, "<p>same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 5000),
         (6, "u", "é" * 5000), (7, "u", "é" * 5000), (8, "u", "one\r\n\r\ntwo"), (None, "u", "<p>same"), (None, "u", "none"), (9, "u", "WARC/1.1\r\n")]


@pytest.mark.parametrize("least", [0, 100])
def test_warc_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, refers_to string, chunk_no int").repartition(3)
    folder = str(tmp_path / "archives")
    manifest = warc.write_warc(df, folder, "page_id", "html", "url", least_bytes=least, chunk_bytes=100, file_bytes=300)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    chunks = warc.read_warc(manifest, folder, chunk_bytes=64).collect()
    whole = {}
    for r in sorted(chunks, key=lambda r: r.chunk_no):
        if r.record_type == "response" and r.seen_bytes == len(r.data):
            assert r.seen_digest == _base32(bytes(r.data))  # first chunk
        assert r.data is None or len(r.data) <= 64
    got = [(r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in chunks if r.last]
    want = []
    for key, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p in PAGES if (p[2] or "") == (html or "")]
        top = max((p[0] for p in same if p[0] is not None), default=None)
        again = len(data) >= least and top is not None and key != top
        want.append((None if key is None else str(key), "revisit" if again else "response", str(top) if again else None, len(data), _base32(data)))
        whole[key] = data
    assert sorted(got, key=repr) == sorted(want, key=repr)
    ends = sum(r.last for r in chunks if r.record_type == "response" and r.id == "6")
    assert ends * len(whole[6]) == sum(len(r.data) for r in chunks if r.record_type == "response" and r.id == "6")
    single = [r for r in chunks if r.id == "8"]
    assert bytes(b"".join(bytes(r.data) for r in single)) == whole[8] and single[0].target_uri == "u"
    lean = warc.read_warc(manifest, folder, with_data=False).collect()
    assert sorted((r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in lean if r.id) == sorted(x for x in got if x[0])
    assert all(r.data is None for r in lean)


def test_warc_files_are_plain_and_damage_raises(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "text " * 50 + str(i)) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    folder = tmp_path / "archives"
    manifest = warc.write_warc(df, str(folder), "page_id", "html", "url")
    (path,) = folder.glob("*.warc.gz")
    text = gzip.decompress(path.read_bytes()).decode()
    assert text.count("WARC/1.1\r\nWARC-Type: response\r\n") == 5 and "WARC-Target-URI: http://h/3\r\n" in text
    assert text.endswith("\r\n\r\n")
    path.write_bytes(gzip.compress(text.replace("text 3", "texT 3").encode()))
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read_warc(manifest, str(folder)).collect()
    path.write_bytes(gzip.compress(text.encode())[:-300])
    with pytest.raises(Exception, match="ends inside a record|incomplete|Error"):
        warc.read_warc(manifest, str(folder)).collect()
    assert warc.archive(df.limit(0), "page_id", "html").collect() == []


def _fails(text, texts_before):
    words = WORD.findall(text)
    return "".join(f for f, bad in zip("ABCDE", (
        len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        re.search(r"[#$%&*|]", text), text in texts_before)) if bad)


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [None, "", "SHOUT " * 120, "few words", "a #tag " * 3] + [" ".join(f"w{rng.randint(0, m)}" for _ in range(n)) + t for m in (90, 9000)
                                                                    for n in (50, 150) for t in ("", " $", " LOUD" * 40)]
    rows = [(i if i % 17 else None, rng.choice(pool), rng.choice(["en", "de", None, ""]), "k") for i in range(300)]
    rows += [rows[5], rows[5], (7, rows[3][1], "fr", "k"), (7, rows[3][1], "en", "k")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(6, 1, 1), (6, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask string").repartition(7)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.filter_audit(docs, marks).collect()}
    made = []
    for key, text, lang, _ in rows:
        before = {r[1] or "" for r in rows if r[0] is not None and key is not None and r[0] < key}
        good, toxic = (any(x[0] == key and key is not None and x[k] == 1 for x in labels) for k in (1, 2))
        made.append((lang or "", _fails(text or "", before), good, toxic))
    assert {f for _, fails, _, _ in made for f in fails} == set("ABCDE")
    want = {}
    for part in {m[0] for m in made}:
        mine, total = [m for m in made if m[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                redundant = sum(f in m[1] for m in mine) - len(gone)
                left = [m for m in left if f not in m[1]]
                total[f] += len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), redundant, sum(m[1] == f for m in mine),
                                                    sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in want.items():
            if p == part:
                row.append(total[order[step - 1]])
    assert got == {k: tuple(v) for k, v in want.items()}
    assert filter_audit.filter_audit(docs.limit(0), marks).collect() == []


def test_packed_fields_do_not_overflow():
    import pandas as pd

    big = 2**62 + 12345
    rows = list(filter_audit.outcomes(pd.DataFrame({"mask": [31, 0], "good": [True, False], "toxic": [False, True], "n": [big, 7]}), "ABCDE"))
    assert len(rows) == 600 and all(r["removed"] == (big if r["step"] == 1 else 0) for r in rows)
    assert all(r["redundant"] == (0 if r["step"] == 1 else big) and r["kept"] == 7 and r["toxic_lost"] == 0 for r in rows)
    assert all(r["shapley"] == 24 * big for r in rows)
