"""The pipeline against a brute-force version of what its stages decide."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltworks.llm import packing, quality, secrets
from tests.llm.test_neardup import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(("an", "the", "er", "ou", "ing", "st", "lo", "mi")) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(60, 150))]
        if i % 5 == 0:
            words = [w + "&&&" for w in words]
        if i % 11 == 0:
            words[3] = 'token = "0123456789abcdef0123456789abcdef"'
        rows.append((i, " ".join(words), "en", rng.choice(["src0", "src1", "src9", None])))
        labels.append((i, int(i % 5 > 0), 0))
    rows += [(500 + i, rows[i][1], "en", "src0") for i in range(40)] + [(600, None, "en", "src0"), (601, "", None, "src0"), rows[1], rows[1]]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality_rules(spark, docs, folder)
    verdict = {r.doc_id: r.kept for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    kept = good.collect()
    assert good.columns == columns and sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in docs.collect() if verdict[r.doc_id])
    one = corpus_pipeline.near_duplicates(spark, good, folder)
    root = brute([(r.doc_id, r.text) for r in kept])
    left = one.collect()
    assert one.columns == columns and sorted(r.doc_id for r in left) == sorted(d for d in root if root[d] == d)
    clean = corpus_pipeline.secret_scan(spark, one, folder)
    found = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(found) == {r.doc_id for r in left}
    assert all(r.n_chars == len(r.text) and "0123456789abcdef" not in r.text for r in found.values())
    mixed = corpus_pipeline.mix_sources(spark, clean, folder)
    assert mixed.columns == columns and sorted(r.doc_id for r in mixed.collect()) == sorted(found)
    packed = corpus_pipeline.run(spark, folder).collect()
    want = {(r.doc_id, r.start, r.length) for r in packing.tokenize(clean).collect()}
    assert {(r.doc_id, r.start, r.length) for r in packed} == want and len(packed) == len(want)
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert secrets.redact(docs).columns == docs.columns


def test_sequences_follow_the_mix(spark, monkeypatch):
    monkeypatch.setattr(packing, "ORDERED_DOCS", 64)
    rng, names = random.Random(9), ("src0", "src1", "src2", "src3", None)
    rows = [(i, " ".join(["word"] * rng.randint(20, 900)), names[i % 5]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    packed = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    assert sorted(r.doc_id for r in packed if r.start == 0) == list(range(1500))
    first = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        first.setdefault(r.doc_id, len(first))
    came = [names[d % 5] for d in first]  # sources by the sequence that first holds a document of theirs
    for upto in (250, 400, 550):  # src0, with 8 of 21 parts, lasts for 787 documents
        for name, weight in (("src0", 8), ("src1", 4), ("src2", 4), ("src3", 3), (None, 2)):
            assert abs(came[:upto].count(name) / upto - weight / 21) < 0.06, (upto, name)
