"""Order over the whole table, by range."""

import random

import pytest

from siltworks.operators import ranges, retrieval


@pytest.mark.parametrize("n", [0, 1, 3, 500])
def test_numbers_neighbours_and_first_rows(spark, n):
    rng = random.Random(n)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i in range(n)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "i long, s string, v long").repartition(5)
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert sorted((r.ord, r.i) for r in ranges.numbered(df, ["s", "i"]).collect()) == [(k, r[0]) for k, r in enumerate(want)]
    after = {r[0]: x[2] for r, x in zip(want, want[1:], strict=False)} | ({want[-1][0]: None} if want else {})
    assert {r.i: r.next for r in ranges.with_next(df, ["s", "i"], "v", "next").collect()} == after
    for k in (0, 1, 7, 1000):
        assert sorted(r.i for r in ranges.first_rows(df, ["s", "i"], k).collect()) == sorted(r[0] for r in want[:k])


def test_no_window_over_all_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "i")
    for plan in (ranges.numbered(df, ["i"]), ranges.with_next(df, ["i"], "i", "next")):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [_part" in text or "_place" in text


def test_fingerprint_does_not_rest_on_partitions(spark):
    """Digests of ranges in any order, joined by number, are those of a plain run."""
    import hashlib

    files = [(f"f{i:03}", 3 + i, f"text {i}") for i in range(200)]
    want = hashlib.sha256(b"/r" + b"".join(p.encode() + str(s).encode() + hashlib.sha256(t.encode()).digest() for p, s, t in files)).hexdigest()[:24]
    df = spark.createDataFrame(files, "path string, size long, content string")
    for parts in (1, 7, 30):
        assert retrieval.fingerprint(df.repartition(parts), "/r").first()[0] == want
    assert retrieval.fingerprint(df.limit(0), "/r").first()[0] == hashlib.sha256(b"/r").hexdigest()[:24]
