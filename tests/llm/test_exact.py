"""Exact duplicates against grouping in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltworks.llm import exact

SCHEMA = "doc_id long, text string, digest string, keep_id string, texts int, n int"


def brute(rows):
    """Multiset of (doc_id, keep_id, group_size, kept), by text."""
    by = {}
    for i, text in rows:
        by.setdefault(text or "", []).append(i)
    out = []
    for i, text in rows:
        own = by[text or ""]
        top = max((x for x in own if x is not None), default=None)
        out.append((i, top, len(own), i == top, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(i, t, "clash", "clash", 1, 2) for i, t in rows], SCHEMA).repartition(parts)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.sha) for r in df.collect()), key=str)


def rows_of(seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "a", "A", "a ", "é", "é", "x" * 200_000, "x" * 199_999 + "y", *(f"text {i}" for i in range(30))]
    rows = [(i, rng.choice(texts)) for i in range(400)] + [(1000 + i, "copied by a third") for i in range(200)]
    rows += [rows[0], rows[0], (None, "only null id"), (None, "only null id"), (None, "a"), (5, "two texts of one id"), (5, "another")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.pmod(F.crc32(t), F.lit(5)).cast("string").cast("binary")])
def test_groups(spark, digest):
    """A digest that many texts share gives the same groups, so content decides."""
    rows = rows_of(3)
    got = exact.groups(frame(spark, rows), digest)
    texts = spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "text string")
    if digest is exact.sha256:
        assert found(got.withColumn("sha", F.lower(F.hex("digest")))) == brute(rows)
    else:
        assert texts.count() > 5
        assert found(got.withColumn("sha", F.lit(""))) == sorted(((*r[:4], "") for r in brute(rows)), key=str)


def test_salts_and_hot_groups_do_not_matter(spark):
    rows = rows_of(4)
    df = frame(spark, rows, 13)
    a = found(exact.groups(df, salts=1).withColumn("sha", F.lower(F.hex("digest"))))
    assert a == found(exact.groups(df.repartition(3), salts=50).withColumn("sha", F.lower(F.hex("digest")))) == brute(rows)


def test_every_group_below_the_hot_share(spark):
    rows = [(i, f"t{i // 2}") for i in range(3 * exact.MOST_HOT)]
    assert found(exact.groups(frame(spark, rows)).withColumn("sha", F.lower(F.hex("digest")))) == brute(rows)


def test_empty(spark):
    assert exact.groups(frame(spark, [], 1)).collect() == []
    assert exact.keep(frame(spark, [], 1)).collect() == []


def test_keep(spark):
    rows = rows_of(6)
    kept = [(r.doc_id, r.text) for r in exact.keep(frame(spark, rows)).collect()]
    assert sorted(t or "" for _, t in kept) == sorted({t or "" for _, t in rows})
    top = {}
    for i, t in rows:
        top[t or ""] = max((x for x in (top.get(t or ""), i) if x is not None), default=None)
    assert all(top[t or ""] == i for i, t in kept)


def test_combining_compares_in_each_step(spark):
    """The plan: an aggregate with the text among its keys before the first exchange, after it, and after the second."""
    rows = frame(spark, rows_of(1)).select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    plan = exact.combine(rows)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("keys=[digest") == 4 and plan.count("text") > 4
