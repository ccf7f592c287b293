import itertools
import random

import duckdb
from pyspark.sql import functions as F

from siltworks.llm import mixing


def test_deviation_stays_under_one_block():
    rng = random.Random(1)
    for _ in range(40):
        weights = [rng.randint(1, 30) for _ in range(rng.randint(1, 8))]
        period, slots = sum(weights), mixing.pattern(weights)
        assert sorted(itertools.chain(*slots)) == list(range(period)) and [len(s) for s in slots] == weights
        for w, s in zip(weights, slots, strict=True):
            assert all(abs(sum(x < t for x in s) - t * w / period) < 1 for t in range(period + 1))


def play(counts, weights, block):
    """The schedule slot by slot: the source of each slot."""
    left = {n: -(-c // block) for n, c in counts.items() if c}
    given, tau, out = dict.fromkeys(left, 0), 0, []
    while active := sorted(n for n in left if left[n]):
        total = sum(weights.get(n, 1) for n in active)
        w = {n: weights.get(n, 1) for n in active}
        pick = min((n for n in active if given[n] * total < (tau + 1) * w[n]), key=lambda n: (-(-(given[n] + 1) * total // w[n]), n))
        out.append(pick)
        left[pick] -= 1
        given[pick] += 1
        tau += 1
        if not left[pick]:
            given, tau = dict.fromkeys(left, 0), 0
    return out


def test_plan_equals_play():
    rng = random.Random(2)
    for _ in range(30):
        counts = {f"s{i}": rng.randint(0, 90) for i in range(rng.randint(1, 6))}
        weights = {n: rng.randint(1, 9) for n in counts if rng.random() < 0.7}
        got = {}
        for p in mixing.schedule(counts, weights, 4):
            for k in range(p["used"]):
                got[p["slot"] + k // p["weight"] * p["period"] + p["pattern"][k % p["weight"]]] = p["source"]
        assert [got[i] for i in range(len(got))] == play(counts, weights, 4)


def test_frames(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, ""]), "x") for i in range(500)] + [(7, "b", "x"), (7, "b", "x"), (None, "c", "x"), (None, "c", "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n string").repartition(4)
    got = mixing.mix(df, {"a": 3}, 8).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    counts = {}
    for _, s, _ in rows:
        counts[s or ""] = counts.get(s or "", 0) + 1
    order = play(counts, {"a": 3}, 8)
    assert all(order[r.mix_slot] == (r.source or "") for r in got)
    assert [sum(s == r.source for s in order[: r.mix_slot]) for r in got if r.source == "a"] == [r.mix_block for r in got if r.source == "a"]
    ordered = mixing.in_order(df, weights={"a": 3}, block_rows=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.mix_position, (r.doc_id, r.source))
    assert [(r.doc_id, r.source or "") for r in ordered] == [(by[i][0], by[i][1] or "") for i in range(len(rows))]
    assert mixing.mix(df.limit(0)).count() == 0
    documents = df.where("doc_id is not null and doc_id <> 7").toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(mixing.oracle({"a": 3}, 8)).fetchall()
    mine = mixing.mix(df.where("doc_id is not null and doc_id <> 7"), {"a": 3}, 8).select("doc_id", F.coalesce("source", F.lit("")), "mix_block", "mix_slot", "mix_position").collect()
    assert sorted(tuple(r) for r in mine) == sorted(want)
