"""Caches by path and content: only changed files are parsed, and what comes out equals a full build."""

import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import incremental, retrieval, symbols
from siltworks.project import Project


def frame(spark, files):
    return spark.createDataFrame([(p, "python", t) for p, t in files.items()], "path string, language string, content string")


def texts(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "def f(x):", "    return x", "", "class A:", "import os", "zeta"]
    return {f"d{i % 5}/f{i}.py": "\n".join(rng.choice(words) + f" w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 70))) for i in range(n)}


def table(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_file_cache(spark, tmp_path):
    rng = random.Random(2)
    files = texts(rng, 40) | {"empty.py": "", "none.txt": "nothing here"}
    kept = incremental.FileCache(spark, str(tmp_path), "symbols", symbols.extract, buckets=3)
    for step in range(4):
        got = kept.rows(frame(spark, files))
        want = symbols.extract(frame(spark, files))
        assert table(got, *want.columns) == table(want, *want.columns)
        assert (kept.parsed, kept.removed) == [(42, 0), (2, 1), (0, 0), (1, 1)][step]
        if step == 0:
            files["d0/f0.py"] += "\ndef changed(a):\n    pass\n"
            files["new.py"] = "def new():\n    pass\n"
        if step == 2:
            files["d1/f1.py"] += "\nx"
    assert kept.update(frame(spark, {})).removed == 43 and kept.rows(frame(spark, {})).count() == 0


def test_index_store_equals_a_full_build(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    files = texts(rng, 30)
    store = incremental.IndexStore(spark, str(tmp_path / "i"), buckets=3)
    asked = spark.createDataFrame([(0, "alpha w1 w2"), (1, "zeta class"), (2, "unknown words"), (3, "")], "question long, content string")
    for step in range(3):
        got, want = store.index(frame(spark, files)), retrieval.Index.build(frame(spark, files))
        assert table(got.idf, "token", "df", "idf") == table(want.idf, "token", "df", "idf")
        assert table(got.chunks, "path", "chunk", "line_start", "line_end", "content") == table(want.chunks, "path", "chunk", "line_start", "line_end", "content")
        assert table(got.norms.withColumn("norm", F.round("norm", 9)), "path", "chunk", "norm") == table(want.norms.withColumn("norm", F.round("norm", 9)), "path", "chunk", "norm")
        assert table(retrieval.retrieve(got, asked), "question", "rank", "path", "chunk", "score") == table(retrieval.retrieve(want, asked), "question", "rank", "path", "chunk", "score")
        del files[sorted(files)[step]]
        files["d9/x.py"] = f"alpha {step}\nbeta w1"
    # A change that broke off between the two tables: the counts are made anew.
    monkeypatch.setattr(store.df, "replace", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.update(frame(spark, files))
    monkeypatch.undo()
    assert table(store.index(frame(spark, files)).idf, "token", "df") == table(retrieval.Index.build(frame(spark, files)).idf, "token", "df")


def test_warm_index_does_not_parse(spark, tmp_path, monkeypatch):
    files = frame(spark, texts(random.Random(4), 12))
    store = incremental.IndexStore(spark, str(tmp_path / "i"), buckets=2)
    first = table(store.index(files).norms, "path", "chunk")
    monkeypatch.setattr(retrieval, "chunks", lambda *_: pytest.fail("parsed again"))
    monkeypatch.setattr(retrieval.Index, "save_weights", lambda *_: pytest.fail("weighed again"))
    assert table(incremental.IndexStore(spark, str(tmp_path / "i"), buckets=2).index(files).norms, "path", "chunk") == first


@pytest.mark.parametrize(("k", "seed"), [(1, 1), (3, 2), (5, 3)])
def test_waves_lose_nothing(spark, k, seed):
    """Against scores of every chunk, with ties, one-token questions and chunks that share nothing."""
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(60)]
    files = {f"f{i:03}": " ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.randint(1, 25))) for i in range(150)} | {f"same{i}": "r1 r2 c1" for i in range(8)}
    index = retrieval.Index.build(frame(spark, files))
    asked = spark.createDataFrame([(i, " ".join(rng.choice(common + rare) for _ in range(n))) for i, n in enumerate((1, 2, 5, 12, 30, 30))] + [(9, "r1"), (10, "nowhere")], "question long, content string")
    got = table(retrieval.retrieve(index, asked, k), "question", "rank", "path", "score")
    counts = {r.token: r.idf for r in index.idf.collect()}
    weigh = lambda text: {t: n * counts.get(t, 0) for t, n in __import__("collections").Counter(text.split()).items()}
    size = lambda w: sum(x * x for x in w.values()) ** 0.5
    want = []
    for q in asked.collect():
        w, scored = weigh(q.content), []
        for p, text in files.items():
            c = weigh(text)
            if size(w) and size(c):
                scored.append((-round(sum(w[t] * c.get(t, 0) for t in w) / size(w) / size(c), 9), p))
        want += [(q.question, n + 1, p, round(-s, 6)) for n, (s, p) in enumerate(sorted(scored)[:k]) if s < 0]
    assert got == sorted(want, key=str)
    found = retrieval.waves(index, asked, k)
    assert found["needed"].select("question", "token").distinct().count() <= found["asked"].count()


def test_project_keeps_its_answers(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("def start(x):\n    return x\n")
    (root / "src/b.py").write_text("import a\n")
    said = str(tmp_path / "asked")

    def answer(prompt: str) -> str:
        with open(said, "a") as f:
            f.write("1")
        return '{"name": "n", "purpose": "p"}'

    asked = lambda: len(open(said).read()) if (tmp_path / "asked").exists() else 0
    make = lambda: Project.from_path(spark, str(root), cache=str(tmp_path / "kept"))
    pages = table(make().document(answer)[0], "page_id", "content")
    n = asked()
    assert n > 0
    assert table(make().document(answer)[0], "page_id", "content") == pages and asked() == n
    (root / "src/b.py").write_text("import a\n\ndef more():\n    pass\n")
    make().document(answer)
    assert n < asked() < 2 * n
    assert make().ask(["start"]).first().answer is not None
