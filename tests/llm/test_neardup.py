import itertools
import random
import re

import numpy as np
import pyarrow as pa

from siltworks.llm import common, neardup
from siltworks.llm import components as components_module
from siltworks.llm.components import components


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(frozenset(sets_of(t)))
    nodes = [(d, s) for d, ss in sets.items() for s in ss]
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in itertools.combinations(nodes, 2):
        if s and t and 100 * len(s & t) >= 85 * len(s | t):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: root(d) for d in sets}


def family(rng, start, size, words=150, edits=6):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for i in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((start + i, " ".join(copy)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(4)
    rows = family(rng, 0, 60) + family(rng, 100, 40, 60, 4) + family(rng, 200, 25, 400, 12)
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(300 + i, " ".join(f"q{rng.randrange(9999)}" for _ in range(50)) + " " + passage) for i in range(40)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "ONE two"), (405, "one"), (406, "A b c d e"), (407, "a B c d e"), (408, "é b c d É"), (407, "a B c d e")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, digest string, rep int").repartition(5)
    got = neardup.cluster(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    sizes = {d: len(sets_of(t)) for d, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BUCKET", 10)
    rng = random.Random(5)
    rows = family(rng, 0, 70, 80, 7)
    got = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)


def test_large_families_and_others_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BUCKET", 10)
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)
    rng = random.Random(6)
    rows = family(rng, -30, 60, 80, 9) + family(rng, 100, 40, 60, 6) + family(rng, 200, 5) + [(300 + i, f"{i} " + " ".join(f"q{rng.randrange(9999)}" for _ in range(30))) for i in range(60)]
    got = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == brute(rows)


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(False).head().totalShuffleWrite()


def test_texts_in_no_family_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(7)
    rows = family(rng, 0, 40, 80, 7) + [(100 + i, " ".join(rng.randbytes(8).hex() for _ in range(2500))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    before = shuffled(spark)
    got = {r.doc_id: r.component_id for r in neardup.cluster(docs).collect()}
    moved = shuffled(spark) - before
    docs.unpersist()
    assert got == brute(rows[:40]) | {d: d for d, _ in rows[40:]}
    assert moved < sum(len(t) for _, t in rows) / 4


def test_likely_keeps_every_row_of_the_ids(spark, monkeypatch):
    ids = spark.createDataFrame([(i,) for i in [0, -1, -(2**63), 2**63 - 1, 5, 5, None, *range(1000, 3000, 2)]], "rep long")
    rows = spark.createDataFrame([(i, "t") for i in [None, 0, 0, -1, -(2**63), 2**63 - 1, 5, 6, *range(1000, 21000)]], "doc_id long, text string").repartition(3)
    wanted = {0, -1, -(2**63), 2**63 - 1, 5, *range(1000, 3000, 2)}
    for most in (1 << 27, 1 << 15):
        monkeypatch.setattr(common, "MOST_BITS", most)
        got = common.likely(rows, "doc_id", ids)
        assert got.columns == rows.columns
        found = [r.doc_id for r in got.collect()]
        assert wanted <= set(found) and found.count(0) == 2 and len(found) < 1007 + 20000 * 0.05
    assert common.likely(rows, "doc_id", ids.where("rep = 7")).count() == 0


def test_empty(spark):
    assert neardup.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for j in (0.75, 0.85, 0.95):
        errors = []
        for _ in range(40):
            shared, own = round(600 * j), round(600 * (1 - j) / 2)
            x = rng.integers(0, 1 << 63, shared + 2 * own, np.uint64)
            s = neardup.odd_sketches(neardup.minhashes([np.sort(x[: shared + own]), np.sort(np.concatenate([x[:shared], x[shared + own :]]))]))
            errors.append(float(neardup.estimate(np.bitwise_count(s[0] ^ s[1]).sum())) - j)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 105), (103, 105), (7, 7), (200, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 103: 100, 105: 100, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_threshold_of_the_caller(spark):
    assert neardup.plan(85) == (36, 7, 0.72) and neardup.plan(80) == (46, 6, 0.66)
    import corpus_pipeline

    rng, rows = random.Random(12), []
    for i in range(60):
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        copy = list(base)
        for at in range(10, 200, 200 // (3 + i % 3)):
            copy[at] = f"x{i}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    sets = {d: sets_of(t) for d, t in rows}
    near = {d: len(sets[d] & sets[d + 1]) / len(sets[d] | sets[d + 1]) for d in range(0, 120, 2)}
    assert sum(0.8 <= j < 0.85 for j in near.values()) >= 20 and min(near.values()) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for threshold in (80, 85):
        got = {r.doc_id: r.component_id for r in neardup.cluster(docs, threshold=threshold).collect()}
        assert got == {d: d - d % 2 * (near[d - d % 2] * 100 >= threshold) for d in got} and len(got) == 120
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert left == {d for d in sets if d % 2 == 0 or near[d - 1] < 0.8}


def test_components_of_random_graphs(spark, monkeypatch):
    rng = random.Random(21)
    hub = [(10**6 + i, 5 + i % 3) for i in range(3000)] + [(9 * 10**6, 10**6 + i) for i in range(0, 3000, 7)]
    path = [(i, i + 1) for i in rng.sample(range(20000, 20400), 400)]
    sparse = [(rng.randrange(30000, 33000), rng.randrange(30000, 33000)) for _ in range(1800)]
    edges = hub + path + sparse + [(-4, -(2**63)), (2**63 - 1, -4), (7, 7)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    want = {x: root(x) for x in up}
    table = spark.createDataFrame(edges, "u long, v long").repartition(7)
    for few, at_once in ((1 << 16, 1 << 20), (0, 64)):
        monkeypatch.setattr(common, "FEW", few)
        monkeypatch.setattr(components_module, "AT_ONCE", at_once)
        got = components(table).collect()
        assert len(got) == len(want) and {r.node: r.component for r in got} == want


def test_large_families_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BUCKET", 10)
    monkeypatch.setattr(common, "FEW", 0)
    rng = random.Random(6)
    rows = family(rng, -30, 60, 80, 9) + family(rng, 100, 40, 60, 6) + family(rng, 200, 5)
    got = neardup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == brute(rows)


def test_few_jobs_settle_large_families(spark, monkeypatch):
    """Each job costs the driver memory, and time in proportion to the partitions, however few the rows."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(6)
    rows = family(rng, -30, 60, 80, 9) + family(rng, 100, 40, 60, 6) + family(rng, 200, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sc = spark.sparkContext
    sc.setJobGroup("few jobs", "near-duplicates")
    try:
        neardup.cluster(docs).collect()
    finally:
        sc._jsc.clearJobGroup()
    assert len(sc.statusTracker().getJobIdsForGroup("few jobs")) <= 50
