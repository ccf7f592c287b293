import math

import numpy as np
from pyspark.sql import functions as F

from siltworks.llm.topk import MOST_PIVOTS, _visits, _wave, build, pivots_for, scaled, search, visits


def brute(rows, every, k):
    vecs = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in dict(sorted(((i, v) for i, v in vecs if i % every == 0), reverse=True)).items():
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vecs if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, every=10, k=10):
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int").repartition(3)
    return sorted(tuple(r) for r in search(df, F.col("vec_id") % every == 0, k).collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    x = centres[rng.integers(0, 6, 600)] + 0.2 * rng.normal(size=(600, 12))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[5][1]) for i in range(80)]  # ties
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2010, [1.0, 2.0]), (2020, []), (2005, [1e3] * 12)]
    rows += [(3000, rows[7][1]), (3000, rows[7][1])]
    assert run(spark, rows) == brute(rows, 10, 10)


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (10, [-1.0, 0.5])]
    assert run(spark, rows) == brute(rows, 10, 10)
    assert run(spark, rows[:1]) == []
    assert run(spark, []) == []
    assert run(spark, [(0, [1e6, 3e5]), (1, [2e5, 1e3]), (2, [1.0, 1.0])]) == brute([(0, [1e6, 3e5]), (1, [2e5, 1e3]), (2, [1.0, 1.0])], 10, 10)


def visited_share(spark, x, every=20, k=10):
    """Share of all query-vector pairs in the annuli that the queries visit, with each query's true k-th score as the bound."""
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    _, _, bounds = build(scaled(df))
    whole = np.floor(1024 * x.astype(np.float32).astype(float))
    q = whole[::every]
    scores = q @ whole.T
    scores[np.arange(len(q)), np.arange(0, len(x), every)] = -np.inf
    least = np.sort(scores, axis=1)[:, -k]
    seen = visits(q, bounds, k) | visits(q, bounds, k, least)
    assert bounds.count.sum() == len(x)
    return float((seen * bounds.count).sum() / (len(q) * len(x)))


def test_bounds_prune_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    tight = centres[rng.integers(0, 20, 2000)] + 0.05 * rng.normal(size=(2000, 16))
    assert visited_share(spark, tight) < 0.25
    assert visited_share(spark, rng.normal(size=(1000, 16))) > 0.5  # nothing to prune by


def test_pivots_grow_with_the_rows():
    assert [pivots_for(n) for n in (0, 500, 5130, 10**6, 10**9)] == [8, 8, 23, 333, MOST_PIVOTS]


def test_no_side_of_the_search_is_broadcast(spark):
    """Vectors repeated by pivot are far larger than the sizes Spark knows of; sent to the driver whole they filled it."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(400, 8)).tolist())], "vec_id long, embedding array<double>")
    placed, blocks, bounds = build(scaled(df))
    queries = placed.where("vec_id % 10 = 0").select("vec_id", "vec", F.lit(None).cast("double").alias("least"))
    found = _visits(queries, bounds, 10, second=True)
    assert found.count() == 40 * len(bounds.held) < 40 * len(bounds.ids)  # all visit all: a vector goes to a pivot once
    plan = _wave(found, blocks, bounds, 10, 40)
    plan.collect()
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
