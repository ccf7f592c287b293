"""Keyed state with expiry against a replay in plain Python."""

import datetime as dt
import random

from siltworks.sources.buckets import BucketTable
from siltworks.streaming import expiry

SCHEMA = "key string, value string, at timestamp, tie long"
START = dt.datetime(2024, 1, 1)


def test_newest_live_entries_and_state_shrinks(spark, tmp_path):
    rng = random.Random(1)
    table = BucketTable(spark, str(tmp_path / "t"), ("key",), buckets=2)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    puts, states = [], []
    for drop, (keys, first, last) in enumerate(((30, 0, 50), (4, 200, 260), (4, 261, 262))):
        some = [(f"k{rng.randrange(keys)}", f"v{drop}-{i}", START + dt.timedelta(seconds=rng.randint(first, last)), i) for i in range(40)] + [(None, "no key", START, 0), ("k0", "tie", START + dt.timedelta(seconds=last), 99), ("k0", "tie, later", START + dt.timedelta(seconds=last), 100)]
        puts += [p for p in some if p[0]]
        spark.createDataFrame(some, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        told = expiry.run_expiring(spark, stream(), table, str(tmp_path / "state"), 100)
        states.append(told[-1]["state"])
        clock = max(p[2] for p in puts)
        newest = {}
        for key, value, at, tie in puts:
            newest[key] = max(newest.get(key, (START, -1, "")), (at, tie, value))
        want = {k: v for k, (at, _, v) in newest.items() if at + dt.timedelta(seconds=100) >= clock}
        assert {r.key: r.value for r in expiry.live(table).collect()} == want
    assert states[0] > 20 and states[-1] <= 4
    before = expiry.live(table).collect()
    assert not any(p["rows"] for p in expiry.run_expiring(spark, stream(), table, str(tmp_path / "state"), 100))
    assert expiry.live(table).collect() == before


def test_changes_are_columns(spark):
    """No Python by key; late puts, equal values and entries at the very edge."""
    at = lambda s: START + dt.timedelta(seconds=s)
    put = lambda *rows: spark.createDataFrame([(k, v, at(s), i) for i, (k, v, s) in enumerate(rows)], SCHEMA)
    first = expiry.changes(put(("a", "1", 0), ("b", "1", 100), ("c", "1", 101)), None, 100)
    assert {(r.key, r.gone) for r in first.collect()} == {("a", True), ("b", False), ("c", False)}
    second = expiry.changes(put(("b", "1", 201), ("late", "x", 100), ("d", "1", 101)), first, 100)
    assert {(r.key, r.gone) for r in second.collect()} == {("b", True), ("b", False), ("d", False)}  # b's old entry goes, its newer put is later
    plan = second._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "MapGroups" not in plan


def test_an_equal_value_put_again_lives_on(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ("key",), buckets=2)
    for second in (0, 90, 170):
        spark.createDataFrame([("k", "same", START + dt.timedelta(seconds=second), 0)], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        told = expiry.run_expiring(spark, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), table, str(tmp_path / "state"), 100)
    assert told == [{"rows": 1, "state": 1}] and expiry.live(table).first().at == START + dt.timedelta(seconds=170)
