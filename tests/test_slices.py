"""What Python takes of an Arrow batch at once is bounded by bytes; nothing is lost."""

import pyarrow as pa
from pyspark.sql import functions as F

from siltworks.functions import batches
from siltworks.operators import docs, retrieval


def test_slices_hold_all_rows_and_few_bytes(monkeypatch):
    monkeypatch.setattr(batches, "SLICE_BYTES", 100)
    texts = ["a" * n for n in (0, 30, 60, 20, 250, 1, 99, 0)] + [None, "b" * 100]
    got = list(batches.text_slices([pa.RecordBatch.from_pydict({"t": texts})], "t"))
    assert [t for p in got for t in p.column("t").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= 100 for p in got) and len(got) > 3
    nested = [[["x" * 40], ["y" * 40, "z"]], [], [["w" * 90]], [[]]]
    whole = pa.RecordBatch.from_pydict({"t": pa.array([[["gone"]], *nested])}).slice(1)
    got = list(batches.text_slices([whole], "t"))
    assert [t for p in got for t in p.column("t").to_pylist()] == nested and len(got) == 2


def test_rendering_goes_by_slices(spark, monkeypatch):
    """One task, one batch of 8 MB: no more than a slice is made into pages at once."""
    pages = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("page_id"), F.concat(F.lit("# a\n"), F.repeat(F.lit("word "), 4000)).alias("content"))
    frame = pages.toArrow().combine_chunks().to_batches()
    seen = []

    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return [seen.append(b.num_rows) or b for b in run(iter(frame))]

    out = docs.rendered(Pages())
    assert sum(seen) == 400 and max(seen) <= 105
    assert {t for b in out for t in b.column("html").to_pylist()} == {docs.markdown_to_html("# a\n" + "word " * 4000)}


def test_common_tokens_are_weighed_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "COMMON", 3)
    files = spark.createDataFrame([(f"f{i}", f"all some{i % 2} x{i} all\n\nrare{i // 2}") for i in range(40)], "path string, content string")
    index = retrieval.Index.build(files)
    want = {(r.path, r.token): r.tf * r.idf for r in index.tf.join(index.idf, "token").collect()}
    weights = index._weights()
    assert {(r.path, r.token): r.w for r in weights.collect()} == want
    first = spark.createDataFrame(weights.where("token = 'all'").select("path").distinct().collect())
    assert first.count() == 40
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and plan.count("strategy=broadcast") >= 2  # only the others' postings meet by a shuffle


def test_files_are_cut_and_counted_in_their_row(spark):
    texts = {f"f{i}": "\n".join(f"w{j % 7} def x_{j}" if j % 6 else "" for j in range(i * 3)) for i in range(30)} | {"none": None, "empty": ""}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    nested = retrieval.file_rows(files, ["path"])
    assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString() and nested.count() == 32
    flat = nested.select("path", F.inline("rows"))
    rows = retrieval.chunks(files)
    assert sorted(map(tuple, flat.drop("tokens").collect())) == sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, flat.select("path", "chunk", F.inline("tokens")).collect())) == sorted(map(tuple, retrieval.term_counts(rows, ["path", "chunk"]).collect()))
