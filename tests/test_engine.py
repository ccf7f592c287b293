"""The corpus engine: goldens for functions and extractors, every registered query against its DuckDB SQL."""

import os

import pytest
from pyspark.sql import functions as F

from siltworks.functions import columns as C
from siltworks.operators import cache, completion, docs, graph, imports, retrieval, scan, symbols
from siltworks.plans.catalogue import ORACLES, QUERIES
from siltworks.sources.tree import read_tree

DATA = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "want"), [("a/./b//c", "a/b/c"), ("../a", "a"), ("a/../../b", "b"), ("", ""), ("/x", "x")])
def test_normalize_path(spark, path, want):
    assert value(spark, C.normalize_path(F.lit(path))) == want


@pytest.mark.parametrize(("text", "most", "want"), [("hello", 4096, "hello"), ("a" * 4094 + "─b", 4096, "a" * 4094), ("x" * 5000, 4096, "x" * 4096), ("é" * 5, 3, "é"), ("a😀b", 4, "a"), ("a😀b", 5, "a😀")])
def test_truncate(spark, text, most, want):
    assert value(spark, C.truncate_utf8(F.lit(text), most)) == want


@pytest.mark.parametrize(("path", "want"), [("Dockerfile", "dockerfile"), ("x/dockerfile.dev", "dockerfile"), ("Makefile", "makefile"), ("a.PY", "python"), (".gitignore", "unknown"), ("a.tar.rs", "rust"), ("x", "unknown"), ("a.R", "r")])
def test_language(spark, path, want):
    assert value(spark, scan.language(F.lit(path))) == want


def test_lines_and_links(spark):
    assert [value(spark, F.size(C.lines(F.lit(t)))) for t in ("", "a", "a\n", "a\r\nb\r\n", "\n\n")] == [0, 1, 1, 2, 2]
    assert value(spark, C.relative_href(F.lit("a/b"), F.lit("a/c/d"))) == docs.href("a/b", "a/c/d") == "c/d.md"
    assert value(spark, C.strip_md_links(F.lit("[a](b.md) [c](http://x/y.md)"))) == "[a](b) [c](http://x/y.md)"
    assert tuple(value(spark, C.git_url(F.lit("https://github.com/o/r.git/")))) == ("github.com", "o", "r")
    assert value(spark, C.git_url(F.lit("https://example.org/o/r"))) is None


@pytest.mark.parametrize(("rules", "path", "want"), [("*.log", "a/b.log", True), ("*.log\n!keep.log", "keep.log", False), ("build/", "build/x", False), ("a/*", "a/b/c", True), ("/foo", "x/foo", True), ("# c\n\nb?t", "bat/x", True), ("*.md\n! a.md", "a.md", False), ("a\\b.py", "a/b.py", True)])
def test_ignore(spark, rules, path, want):
    assert value(spark, scan.ignored(F.lit(path), scan.parse_ignore(rules))) is want
    assert value(spark, scan.ignored(F.lit("build/x"), scan.parse_ignore("build/", dirs=True))) is True


def test_reasons(spark):
    rows = [("node_modules/a.js", "x"), (".env", "x"), ("a.png", "x"), ("big.py", "x" * 99), ("none.py", ""), ("nul.py", "a\0b"), ("m.js", "y" * 2000), ("ok.py", "x = 1"), ("README.md", "# hi"), ("x.egg-info/y", "1")]
    df = spark.createDataFrame(rows, "path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    got = {r.path: r.reason for r in scan.with_reason(df.where("path <> 'm.js'"), 50).unionByName(scan.with_reason(df.where("path = 'm.js'"))).collect()}
    assert got == {"node_modules/a.js": "skipped", ".env": "sensitive", "a.png": "suffix", "big.py": "oversized", "none.py": "empty", "nul.py": "binary", "m.js": "minified", "ok.py": None, "README.md": None, "x.egg-info/y": "skipped"}
    capped = {r.path: r.reason for r in scan.cap(scan.with_reason(df, 5000), 1).collect()}
    assert capped["README.md"] is None and capped["ok.py"] == "priority"


def test_tree(spark, tmp_path):
    for name in ("__init__.py", ".github/x.yml", "src/a.py", "node_modules/z.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("a = 1\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "src/a.py")
    got = {r.path: (r.size, bytes(r.raw)) for r in read_tree(spark, str(tmp_path), skipDirs="node_modules").collect()}
    assert got == dict.fromkeys(("__init__.py", ".github/x.yml", "src/a.py"), (6, b"a = 1\n"))


def test_python_symbols():
    text = '@dec\nclass A(B):\n    """Doc."""\n    def __init__(self, x: int = f(1), *args):\n        self.x = x\n        self.y = 2\n\nasync def _go(a, b=g()) -> str:\n    """Long\n    doc.\n    """\n    return a\n'
    a, init, go = symbols.python_symbols(text)
    assert (a.name, a.kind, a.line, a.end_line, a.decorators, a.doc_comment, a.fields) == ("A", "class", 2, 6, ["dec"], "Doc.", ["x", "y"])
    assert (init.kind, init.visibility, init.calls) == ("method", "public", ["__init__", "f"])
    assert (go.visibility, go.return_type, go.doc_comment, go.calls, go.end_line) == ("private", "str", "Long\ndoc.", ["_go", "g"], 12)


@pytest.mark.parametrize(("lang", "source", "target", "known", "want"), [("python", "src/a/b.py", ".c", "src/a/c.py", "src/a/c.py"), ("python", "a/b/c.py", "..d.e", "a/d/e.py", "a/d/e.py"), ("typescript", "x/a.ts", "../b", "b/index.ts", "b/index.ts"), ("go", "m.go", "h/x/util", "x/util.go", "x/util.go"), ("rust", "src/m.rs", "q::z", "src/q/mod.rs", "src/q/mod.rs"), ("java", "A.java", "p.B", "src/main/java/p/B.java", "src/main/java/p/B.java"), ("python", "a.py", "nope", "b.py", None)])
def test_resolve(spark, lang, source, target, known, want):
    one = spark.createDataFrame([(source, lang, 0, target)], "path string, language string, ord int, target string")
    assert imports.resolve(one, spark.createDataFrame([(known,)], "path string")).first().resolved == want


def test_chunker():
    assert [c[:2] for c in retrieval.cut_chunks(["x"] * 4 + [""] + ["y"] * 65)] == [(1, 5), (6, 35), (36, 65), (66, 70)]
    assert retrieval.cut_chunks([" "] * 7) == [] and retrieval.cut_chunks([]) == []


def test_rank_on_the_cluster_equals_one_task(spark):
    nodes = spark.range(12).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 0), (3, 0), (4, 3), (5, 5), (6, 7), (7, 6)], "src long, dst long")
    one = {r.node: r.score for r in graph.pagerank(nodes, edges, "local").collect()}
    many = {r.node: r.score for r in graph.pagerank(nodes, edges, "cluster").collect()}
    assert one.keys() == many.keys() and abs(sum(one.values()) - 1) < 1e-9 and all(abs(one[k] - many[k]) < 1e-9 for k in one)
    assert {(r.node, r.component, r.size) for r in graph.cycles(edges).collect()} == {(0, 0, 3), (1, 0, 3), (2, 0, 3), (6, 6, 2), (7, 6, 2)}
    more = edges.union(spark.createDataFrame([(10, 11), (11, 10), (2, 10), (20, 21), (21, 22), (22, 20), (21, 20), (22, 6), (30, 20)], "src long, dst long"))
    assert {tuple(r) for r in graph.cycles(more, "cluster").collect()} == {tuple(r) for r in graph.cycles(more, "local").collect()} and graph.cycles(more).count() == 10
    assert graph.cycles(edges.limit(0), "cluster").isEmpty() and graph.cycles(spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long"), "cluster").isEmpty()


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', '{"a": 1}'), ('```json\n[1]\n```', "[1]"), ('x {"a": [1]} y', '{"a": [1]}'), ("none", None), ("{bad [1, 2]", "[1, 2]")])
def test_recover_json(text, want):
    assert completion.recover_json(text) == want


def test_pages(spark, tmp_path):
    pages = spark.createDataFrame([("index", "# A\n`x.py` and `f`\n```\n`f`\n```\n"), ("m/f", "`f` [`x.py`](y.md)")], "page_id string, content string")
    targets = spark.createDataFrame([("x.py", "m/x"), ("f", "m/f")], "span string, page_id string")
    got = {r.page_id: r.content for r in docs.linked(pages, targets).collect()}
    assert got == {"index": "# A\n[`x.py`](m/x.md) and [`f`](m/f.md)\n```\n`f`\n```\n", "m/f": "`f` [`x.py`](y.md)"}
    assert docs.export_markdown(pages, str(tmp_path))["written"] == ["index", "m/f"]
    again = docs.export_markdown(pages.where("page_id = 'index'"), str(tmp_path))
    assert again == {"written": [], "kept": ["index"], "removed": ["m/f"]}
    assert docs.markdown_to_html("# T\n- a\n> q\n`<b>`") == "<h1>T</h1>\n<ul>\n<li>a</li>\n</ul>\n<blockquote>q</blockquote>\n<p><code>&lt;b&gt;</code></p>"
    fenced = docs.markdown_to_html("```mermaid\ngraph LR\n```\n\n1. x\n```py\na<b\n```\n- [p](../modules/a.md) [q](z.md) **b**\n```\nopen", "modules/b", frozenset({"modules/a"}))
    assert fenced.split("\n") == ['<div class="mermaid">graph LR</div>', "<br>", "<ol>", "<li>x</li>", "</ol>", '<pre><code class="language-py">a&lt;b</code></pre>', "<ul>", """<li><a href="#" onclick="showPage('modules/a')">p</a> <a href="z.md">q</a> <strong>b</strong></li>""", "</ul>", '<pre><code class="language-text">open</code></pre>']


def test_cache(spark):
    kv = spark.createDataFrame([("a", "{}", 1.0), ("a", "[1]", 5.0), ("b", "bad {", 5.0), ("c", "1", 0.0)], "key string, value string, created_at double")
    assert [tuple(r) for r in cache.fresh(kv, F.lit(6.0), 4.0).collect()] == [("a", "[1]", 5.0)]


def test_index_round_trip(spark, tmp_path):
    files = spark.createDataFrame([("a", "red fox"), ("b", "blue sky fox"), ("c", "green")], "path string, content string")
    retrieval.Index.build(files).save(str(tmp_path))
    index = retrieval.Index.load(spark, str(tmp_path))
    asked = spark.createDataFrame([(1, "sky"), (2, "nothing")], "question long, content string")
    assert [(r.question, r.path) for r in retrieval.retrieve(index, asked).collect()] == [(1, "b")]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    frame = QUERIES[name](spark, DATA)
    rows = frame.collect()
    if name not in ORACLES:
        assert rows
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(want.columns)
    plain = lambda x: round(x, 9) + 0.0 if isinstance(x, float) else x
    order = sorted(frame.columns)
    mine = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    theirs = sorted(repr([plain(dict(zip(want.columns, r, strict=True))[c]) for c in order]) for r in want.fetchall())
    assert mine == theirs
