"""Bucketed tables: merges, replays, broken-off changes, compaction, and streams into them."""

import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import cache
from siltworks.sources import buckets
from siltworks.sources.buckets import BucketTable, Files
from siltworks.streaming import reindex

SCHEMA = "k long, v string, at long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def held(table):
    return sorted((tuple(r) for r in table.read().select("k", "v", "at").collect()), key=str)


def folders(table):
    return sum(n.startswith("_bucket=") for v in table.files.names("data") for n in table.files.names(f"data/{v}"))


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "t"), ("k",), buckets=4)


def test_upsert_against_a_dictionary(spark, table):
    rng = random.Random(1)
    want = {}
    assert table.read() is None
    for batch in range(4):
        some = [(rng.choice([*range(30), None]), rng.choice(["a", "b", None]), rng.randint(0, 9)) for _ in range(25)]
        table.upsert(rows(spark, some), ("at",), ("s", batch))
        best = {}
        for k, v, at in some:
            best.setdefault(k, []).append((at, v))
        for k, found in best.items():
            top = max(at for at, _ in found)
            ties = {v for at, v in found if at == top}
            if k not in want or (top > want[k][0] and ties != {want[k][1]}):
                got = {r.v for r in table.read().where(F.col("k").eqNullSafe(F.lit(k))).collect()}
                assert len(got) == 1 and got <= ties | ({want[k][1]} if k in want else set())
                v = got.pop()
                if k not in want or v != want[k][1]:
                    want[k] = (top, v)
        assert held(table) == sorted(((k, v, at) for k, (at, v) in want.items()), key=str)


def test_replay_same_rows_and_late_rows_change_nothing(spark, table):
    first = rows(spark, [(i, f"v{i}", 1) for i in range(40)])
    assert table.upsert(first, ("at",), ("s", 0)) == {"arrived": 40, "changed": 40, "buckets": 4}
    before, files = held(table), folders(table)
    assert table.upsert(rows(spark, [(1, "other", 9)]), ("at",), ("s", 0)) == {"arrived": 0, "changed": 0, "buckets": 0}
    assert table.upsert(first.withColumn("at", F.lit(7).cast("long")), ("at",), ("s", 1))["buckets"] == 0
    assert table.upsert(rows(spark, [(3, "late", 0)]), ("at",), ("s", 2))["changed"] == 0
    assert held(table) == before and folders(table) == files
    assert table.upsert(rows(spark, [(3, "new", 2)]), ("at",), ("other", 0)) == {"arrived": 1, "changed": 1, "buckets": 1}
    assert dict((k, v) for k, v, _ in held(table))[3] == "new"


def test_a_change_that_breaks_off_leaves_the_table_as_it_was(spark, table, monkeypatch):
    table.upsert(rows(spark, [(i, "a", 1) for i in range(9)]), ("at",), ("s", 0))
    before = held(table)
    put = Files.put
    monkeypatch.setattr(Files, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(rows(spark, [(2, "b", 2)]), ("at",), ("s", 1))
    assert held(table) == before
    monkeypatch.setattr(Files, "put", put)
    table.upsert(rows(spark, [(2, "b", 2)]), ("at",), ("s", 1))
    assert held(table) == sorted([r for r in before if r[0] != 2] + [(2, "b", 2)], key=str)


def test_readers_keep_their_version(spark, table):
    table.upsert(rows(spark, [(i, "a", 1) for i in range(9)]), ("at",))
    reader = table.read()
    table.upsert(rows(spark, [(i, "b", 2) for i in range(9)]), ("at",))
    assert {r.v for r in reader.collect()} == {"a"} and {v for _, v, _ in held(table)} == {"b"}
    assert table.vacuum(keep=1) == 4 and {v for _, v, _ in held(table)} == {"b"} and folders(table) == 4
    with pytest.raises(ValueError, match="other keys"):
        BucketTable(spark, table.root, ("k",), buckets=5).read()


def test_replace(spark, table):
    table.replace(rows(spark, [(1, "a", 0), (1, "b", 1), (2, "c", 0)]), rows(spark, [(1, "", 0), (2, "", 0)]))
    assert held(table) == [(1, "a", 0), (1, "b", 1), (2, "c", 0)]
    table.replace(rows(spark, [(1, "d", 0)]), rows(spark, [(1, "", 0), (7, "", 0)]))
    assert held(table) == [(1, "d", 0), (2, "c", 0)]
    table.replace(rows(spark, []), rows(spark, [(1, "", 0), (2, "", 0)]))
    assert held(table) == []


def test_store_stays_small(spark, tmp_path):
    store = cache.Store(spark, str(tmp_path / "kv"), buckets=2, most_folders=3)
    make = lambda n, at: spark.createDataFrame([(f"k{i}", f"[{at}]", float(at)) for i in range(n)], "key string, value string, created_at double")
    assert store.rows().count() == 0 and store.clear() == 0
    for at in range(12):
        store.put(make(5 + at % 2, at), ("s", at))
        store.put(make(99, 99), ("s", at))  # a batch that is in
        assert all(len(f) <= 3 for f in store.table.version().folders.values())
    assert {r.key: r.value for r in store.rows().collect()} == {**{f"k{i}": "[11]" for i in range(6)}}
    store.put(make(2, 50))
    assert sorted(r.key for r in store.fresh(F.lit(55.0), 10).collect()) == ["k0", "k1"]
    store.expire(F.lit(55.0), 10)
    assert sorted(r.key for r in store.rows().collect()) == ["k0", "k1"]
    assert store.clear() == 2 and store.rows().count() == 0


def test_stream_of_upserts(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ("doc_id",), buckets=3)
    run = lambda: reindex.run_upserts(spark, str(tmp_path / "in"), table, str(tmp_path / "state"), "doc_id long, text string, seen long", lambda r: reindex.index_rows(r, "seen"), ("seen",))
    drop = lambda data: spark.createDataFrame(data, "doc_id long, text string, seen long").write.mode("append").parquet(str(tmp_path / "in"))
    drop([(1, "a", 1), (2, "b\nc", 1), (None, "x", 1), (3, None, 1)])
    assert [c["changed"] for c in run()] == [4]
    drop([(1, "a2", 2), (2, "b\nc", 2)])
    assert [c["changed"] for c in run()] == [1]
    assert run() == []
    assert {r.doc_id: r.seen for r in table.read().collect()} == {None: 1, 1: 2, 2: 1, 3: 1}


def test_a_replacement_leaves_other_rows_where_they_are(spark, tmp_path, monkeypatch):
    """Only rows that come are shuffled; the others go from bucket to bucket, until files grow many."""
    table = buckets.BucketTable(spark, str(tmp_path / "t"), ("k",), buckets=3)
    frame = lambda ks, v: spark.createDataFrame([(k, v) for k in ks], "k long, v long")
    table.replace(frame(range(100), 0), frame(range(100), 0))
    wrote, write = [], table._write
    monkeypatch.setattr(table, "_write", lambda rows, number: wrote.append(rows.count()) or write(rows, number))
    table.replace(frame((1, 1, 200), 1), frame((1, 2, 200), 1))
    assert wrote == [3]
    want = sorted([(k, 0) for k in range(100) if k not in (1, 2)] + [(1, 1), (1, 1), (200, 1)])
    assert sorted(map(tuple, table.read().collect())) == want
    monkeypatch.setattr(buckets, "MOST_FILES", 0)
    table.replace(frame((3,), 2), frame((3,), 2))
    assert wrote[-1] > 1
    assert sorted(map(tuple, table.read().collect())) == sorted([r for r in want if r[0] != 3] + [(3, 2)])
    table.replace(frame((), 0), frame(range(300), 0))
    assert table.read().count() == 0
