"""Parity-sketch join, components and neighbours against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doccat.llm import ann, parity_join
from doccat.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def _components(rows):
    sets = [(i, _shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least.setdefault(find(k), []).append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [x for x in least[find(k)] if x is not None]
        out.append((i, len(s), min(ids) if s and ids else i))
    return sorted(out, key=repr)


def _corpus(seed, passage_share=0.3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(80)]
    rows, base = [], []
    for i in range(160):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 7, 9, 12, 20, 60, 150, 400]))]
        if rng.random() < passage_share:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        base.append(words)
        rows.append(" ".join(words))
    for words in base[:90]:  # near copies at all distances around the threshold, in chains
        for _ in range(rng.randrange(4)):
            words = list(words)
            for _ in range(max(1, rng.randrange(1 + len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
    rows += [" ".join(passage + [rng.choice(vocab) for _ in range(k)]) for k in (0, 1, 2, 3, 5, 9, 14) for _ in range(3)]
    rows += rows[:20] + [None, "", "  \n", "one", "one", "One\tTWO"] + ["long " + " ".join(rng.choice(vocab) for _ in range(6000))]
    rng.shuffle(rows)
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [(None, rows[0]), (7, rows[7])]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = _corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, cls string")
    got = sorted((tuple(r) for r in parity_join.near_duplicates(docs).collect()), key=repr)
    assert got == _components(rows)


def test_near_duplicates_of_large_groups(spark):
    """One family of near copies and one passage in many documents, both far beyond the pair limit."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join([f"u{i}_{k}" for k in range(70)] + words[:60])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in parity_join.near_duplicates(docs).collect()), key=repr)
    assert got == _components(rows)


def _scattered(rng, words, count, name):
    own = list(words)
    for k in range(count):  # scattered, so that each takes five shingles
        own[k * (len(words) // count) + rng.randrange(len(words) // count - 5)] = f"{name}_{k}"
    return own


@pytest.mark.parametrize("size", [150, 300, 1000])
def test_near_duplicates_of_a_hub(spark, size):
    """Variants linked with their base alone, which is in no block the smallest."""
    rng = random.Random(size)
    base = [f"h{i}" for i in range(200)]
    rows = [(i, " ".join(_scattered(rng, base, 5, f"x{i}"))) for i in range(size)]
    rows.insert(size // 2, (size + 5, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in parity_join.near_duplicates(docs).collect()), key=repr)
    assert got == _components(rows)
    assert {r[2] for r in got} == {0}


def test_near_duplicates_of_a_long_chain(spark):
    """Each text is linked with the ones next to it alone."""
    rng = random.Random(5)
    chain = [[f"c{i}" for i in range(200)]]
    for i in range(199):
        chain.append(_scattered(rng, chain[-1], 4, f"y{i}"))
    rows = [(i, " ".join(words)) for i, words in enumerate(chain)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in parity_join.near_duplicates(docs).collect()), key=repr)
    assert got == _components(rows)


def test_tiles_give_all_close_pairs():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, size=int(rng.integers(60, 110))).astype(np.uint64)) for _ in range(6)]
    sets += [np.unique(np.concatenate([s[: len(s) - k], rng.integers(0, 1 << 63, size=k).astype(np.uint64)])) for s in sets[:6] for k in (1, 2, 3, 4, 5, 6)]
    n = np.array([len(s) for s in sets])
    sketches = [parity_join.parity_sketch(s) for s in sets]
    uid, root, second = np.arange(len(sets)), np.arange(len(sets)) // 2, np.arange(len(sets)) % 2 == 1
    for cross in (False, True):
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if root[i] != root[j] and (not cross or second[i] != second[j])
                and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        near = list(parity_join.near_in_tile(n, root, second, sketches, cross))
        pairs = {(min(i, j), max(i, j)) for i, to, _ in near for j in to.tolist()}
        assert want and want <= pairs and len(pairs) == sum(len(to) for _, to, _ in near)
        a, b, whole = parity_join.candidate_forest(uid, root, near)
        assert set(zip(a.tolist(), b.tolist())) <= pairs and len(a) < len(set(root.tolist())) and whole == (len(a) == len(pairs))
        links = set(zip(*parity_join.link_forest(uid, n, root, second, [s.tobytes() for s in sets], cross)))
        assert links <= want and len(links) < len(set(root.tolist()))
        assert _classes(links, root) == _classes(want, root)


def _classes(pairs, root):
    forest = parity_join.Forest(root)
    for i, j in pairs:
        forest.join(int(root[i]), int(root[j]))
    return [[forest.find(int(p)) == forest.find(int(q)) for q in root] for p in root]


def test_dense_blocks_without_links_are_settled(spark, monkeypatch):
    """Many texts whose sketches are near each other though few link: every link is found, in few rows."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(_scattered(rng, base, 5 + i % 3, f"v{i}"))) for i in range(120)]
    rows += [(200 + i, rows[i][1].replace(f"v{i}", f"u{i}", 1)) for i in range(0, 120, 3)]
    monkeypatch.setattr(parity_join, "TILE", 40)
    monkeypatch.setattr(parity_join, "FOREST_PASSES", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in parity_join.near_duplicates(docs).collect()), key=repr)
    assert got == _components(rows)


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert parity_join.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in parity_join.near_duplicates(docs).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for n in (3, 10, 70, 900):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size=n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: n - rng.integers(0, n)], rng.integers(0, 1 << 63, size=rng.integers(0, n)).astype(np.uint64)]))
            d = parity_join.sketch_distance(parity_join.parity_sketch(a), parity_join.parity_sketch(b))
            assert d <= len(np.setxor1d(a, b))


def test_bands_hold_every_partner():
    ends = parity_join.BANDS
    for n in range(3, 3000):
        band = int(np.searchsorted(ends, n, side="right")) - 1
        top = int(np.searchsorted(ends, 4 * n // 3, side="right")) - 1
        assert top - band <= 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{x: 100 for x in range(100, 140)}, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def _vectors(seed=3, n=900, dim=24):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)).astype(np.float32)
    v[50:90] = v[3]
    v[200] = 0
    rows = [(i, [float(x) for x in v[i]], 1, "s") for i in range(n)]
    rows[210] = (210, None, 1, "s")
    rows[211] = (211, [float("nan")] + [1.0] * (dim - 1), 1, "s")
    rows[212] = (212, [None] + [1.0] * (dim - 1), 1, "s")
    rows[213] = (213, [float("inf")] + [1.0] * (dim - 1), 1, "s")
    rows[214] = (None, rows[215][1], 1, "s")
    return rows + [rows[100], rows[5]]


def test_neighbours_against_brute_force(spark):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, ids string").repartition(4)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    usable = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _, _ in rows
              if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v))}
    hits = total = 0
    assert set(got) == {i for i in usable if i % 100 == 0}
    for q, found in got.items():
        want = sorted((np.sqrt(((usable[q] - v) ** 2).sum()), i) for i, v in usable.items() if i != q)[:10]
        assert sorted(found) == list(range(1, len(want) + 1))
        hits += len({i for _, i in want} & {i for i, _ in found.values()})
        total += len(want)
        for i, score in found.values():
            assert score == pytest.approx(np.sqrt(((usable[q] - usable[i]) ** 2).sum()), abs=1e-12)
    assert hits / total >= 0.99
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    few = df.filter("vec_id IN (0, 1, 2)")
    assert [(r["rank"], r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()].__len__() == 2


def test_neighbours_in_blocks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ann, "BROADCAST_BYTES", 0)
    rows = _vectors(n=400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, s string")
    blocks = ann.search(df, F.col("vec_id") % 100 == 0)
    monkeypatch.setattr(ann, "BROADCAST_BYTES", 1 << 30)
    whole = ann.search(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("copies", ["all", "one"])
def test_neighbours_of_repeated_rows(spark, copies):
    """Copies of a row take one place among the k, in a single chunk."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((300, 16)).astype(np.float32)
    v[7] = v[0] + np.float32(0.01)
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    rows += rows if copies == "all" else [rows[7]] * 20
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1), F.col("vec_id") % 100 == 0).collect()
    for q in (0, 100, 200):
        want = sorted((float(np.sqrt(((v[q].astype(float) - v[i].astype(float)) ** 2).sum())), i) for i in range(300) if i != q)[:10]
        got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[1] for g in got] == [i for _, i in want]
        assert [g[2] for g in got] == pytest.approx([d for d, _ in want], abs=1e-12)


def test_neighbours_of_every_dimension_and_of_doubles(spark):
    """Each vector meets those of its own dimension, and doubles keep their last digits."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8 if i % 3 else 5).tolist()) for i in range(320)]
    vecs = dict(rows)
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 320, 20):
        far = sorted((float(np.sqrt(sum((x - y) ** 2 for x, y in zip(vecs[q], v)))), i) for i, v in rows if i != q and len(v) == len(vecs[q]))[:10]
        got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[1] for g in got] == [i for _, i in far]
        assert np.allclose([g[2] for g in got], [d for d, _ in far], rtol=1e-14, atol=0)


def test_untried_blocks_keep_every_pair(spark):
    """Merged or not, every pair of a block's members besides its centre meets in some block, and none is dealt more often."""
    rng = np.random.default_rng(9)
    blocks = {k: sorted(rng.choice(60, size=int(rng.integers(2, 40)), replace=False).tolist()) for k in range(40)}
    blocks |= {100 + k: sorted({59, *range(200 + 10 * k, 206 + 10 * k)}) for k in range(6)}  # a leader may tie what is not alike
    rows = [(k, u, 50 + u, (50 + m[0], m[0]), len(m)) for k, m in blocks.items() for u in m]
    df = spark.createDataFrame(rows, "key long, uid long, n long, c struct<n:long,uid:long>, members long")
    lead = df.groupBy("key").agg(F.min(F.xxhash64("uid")).alias("lead"))
    got = {}
    for r in parity_join._untried(df.join(lead, "key")).collect():
        got.setdefault(r.key, []).append(r.uid)
    dealt = {(a, b) for m in got.values() for a in m for b in m if a < b}
    want = [(a, b) for m in blocks.values() for a in m[1:] for b in m[1:] if a < b]
    assert set(want) <= dealt
    assert sum(len(m) ** 2 for m in got.values()) <= sum((len(m) - 1) ** 2 for m in blocks.values())
    assert all(len(m) == len(set(m)) for m in got.values())


def test_shared_blocks_are_hashed_not_sorted(spark):
    """Centre, size, members and leader of every block of two members or more, ties and repeated sizes included."""
    rng = np.random.default_rng(11)
    rows = [(int(k), u, int(rng.integers(5, 9))) for u in range(60) for k in rng.choice(50, size=4, replace=False)]
    rows.append((99, 7, 5))
    sizes = {(k, u): n for k, u, n in rows}
    found = parity_join._shared(spark.createDataFrame(rows, "key long, uid long, n long"))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    hashes = {r.uid: r.h for r in spark.range(60).select(F.col("id").alias("uid"), F.xxhash64("id").alias("h")).collect()}
    members = {}
    for k, u, _ in rows:
        members.setdefault(k, []).append(u)
    got = {r.key: r for r in found.collect()}
    assert set(got) == {k for k, m in members.items() if len(m) > 1} and 99 not in got
    for k, r in got.items():
        low = min(sizes[k, u] for u in members[k])
        assert (r.members, r.c.n, r.lead) == (len(members[k]), low, min(hashes[u] for u in members[k]))
        assert r.c.uid in members[k] and sizes[k, r.c.uid] == low


def test_join_hands_python_small_batches(spark, monkeypatch):
    """Sets of any length reach Python in batches bounded in rows and bytes, and the session's settings come back."""
    monkeypatch.setattr(parity_join, "BATCH_ROWS", 50)
    monkeypatch.setattr(parity_join, "BATCH_BYTES", 100_000)
    sizes = {}
    real = parity_join.materialize

    def noted(df, name):
        seen = df.sparkSession.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("t")).mapInArrow(
            lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long")
        sizes[name] = [r.n for r in seen.collect()]
        return real(df, name)

    monkeypatch.setattr(parity_join, "materialize", noted)
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k, None) for k in names]
    rows = [(i, " ".join(f"w{i % 20}x{j}" for j in range(30 + i % 3))) for i in range(60)]
    got = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 20 for i, _ in rows}
    assert {"signatures", "close", "sets", "links"} <= set(sizes)
    assert all(sum(n) == 400 and max(n) <= 30 for n in sizes.values())
    assert [spark.conf.get(k, None) for k in names] == before
