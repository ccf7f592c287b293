"""Registered queries of the corpus engine and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import columns as C
from siltworks.operators import cache, completion, docs, graph, imports, retrieval, scan, symbols, wiki
from siltworks.plans import details
from siltworks.plans.oracles import ORACLES
from siltworks.sources import views as V

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


IGNORE_TEXT = "# rules\nsrc1/*\n!src1/en/*\n*.txt\ndoc_?.md\nbuild/\n"
MAX_SIZE, MAX_FILES = 8192, 100


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return scan.cap(scan.with_reason(V.files_documents(spark, d), MAX_SIZE, scan.parse_ignore(IGNORE_TEXT)), MAX_FILES)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return V.files_documents(spark, d).withColumn("language", scan.language(F.col("path")))


def _synth(spark: SparkSession, d: str) -> DataFrame:
    return V.files_synth(spark, d).withColumn("language", scan.language(F.col("path")))


def _resolved(spark: SparkSession, d: str, flavour: str = "graph") -> DataFrame:
    files = _synth(spark, d)
    return imports.resolve(imports.extract(files), files, flavour)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _synth(spark, d).select(F.col("path").alias("node")), imports.edges(_resolved(spark, d))


@query
def repo_map_topn(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    best = graph.pagerank(nodes, edges).withColumn("r9", F.round("score", 9)).orderBy(F.desc("r9"), "node").limit(20)
    files = _synth(spark, d).select(F.col("path").alias("node"), "language", C.line_count(F.col("content")).alias("lines"))
    return best.join(files, "node", "left").select(F.col("node").alias("path"), F.round("score", 6).alias("score"), "language", "lines")


@query
def scan_report(spark, d):
    return scan.report(_scanned(spark, d))


@query
def drop_reasons(spark, d):
    return _scanned(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query
def scan_kept_files(spark, d):
    return _scanned(spark, d).where("reason is null").select("path", "size", "language")


@query
def ignore_rules(spark, d):
    f = V.files_documents(spark, d)
    return f.select("path", scan.ignored(F.col("path"), scan.parse_ignore(IGNORE_TEXT)).alias("ignored"))


@query
def minified_detection(spark, d):
    f = V.files_documents(spark, d).select(F.regexp_replace("path", r"\.[a-z]+$", ".min2.js").alias("path"), "content")
    return f.select("path", scan.looks_minified(F.col("path"), F.col("content")).alias("minified"))


@query
def language_histogram(spark, d):
    return scan.language_histogram(_documents(spark, d))


@query
def file_tree(spark, d):
    return scan.tree_rows(V.files_documents(spark, d))


@query
def line_counts(spark, d):
    return V.files_documents(spark, d).select("path", C.line_count(F.col("content")).alias("lines"))


@query
def previews(spark, d):
    return scan.described(V.files_documents(spark, d)).select("path", "is_config", "is_entrypoint", C.content_hash(F.col("preview")).alias("preview_hash"))


@query
def file_metrics(spark, d):
    return symbols.metrics(_documents(spark, d))


@query
def file_metrics_synth(spark, d):
    return symbols.metrics(_synth(spark, d))


@query
def imports_raw(spark, d):
    return imports.extract(_synth(spark, d)).select("path", F.col("ord").cast("long").alias("ord"), "target")


@query
def imports_resolved(spark, d):
    return _resolved(spark, d, "index").select("path", F.col("ord").cast("long").alias("ord"), "target", "resolved")


@query
def import_unresolved(spark, d):
    files = _synth(spark, d)
    some = files.where("k % 3 <> 0")
    return imports.resolve(imports.extract(some), some).where("resolved is null").select("path", F.col("ord").cast("long").alias("ord"), "target")


@query
def imports_indexed(spark, d):
    files = _synth(spark, d)
    found = imports.resolve(imports.extract_indexed(files), files, "index")
    return found.select("path", F.col("ord").cast("long").alias("ord"), "raw", "resolved", F.array_join("symbols", ",").alias("symbols"))


@query
def module_internal_edges(spark, d):
    return imports.module_links(_resolved(spark, d, "index"))[0]


@query
def module_external_deps(spark, d):
    return imports.module_links(_resolved(spark, d, "index"))[1]


@query
def module_deps(spark, d):
    return graph.module_edges(_graph(spark, d)[1])


@query
def mermaid(spark, d):
    return graph.diagram(graph.module_edges(_graph(spark, d)[1]))


@query
def module_rollup(spark, d):
    f = _synth(spark, d)
    return symbols.module_rollup(symbols.metrics(f), symbols.extract(f))


@query
def py_symbols(spark, d):
    flat = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["type_hint"], F.lit("-")))), ",")
    return symbols.extract(_synth(spark, d)).select("path", "ord", "name", "kind", "line", "end_line", "visibility", flat("params").alias("params"), "return_type", F.array_join("calls", ",").alias("calls"), F.array_join("fields", ",").alias("fields"))


@query
def symbol_index(spark, d):
    return symbols.symbol_index(symbols.extract(_synth(spark, d))).select("name", F.array_join("paths", ",").alias("paths"), "n")


@query
def exports(spark, d):
    return symbols.exports(symbols.extract(_synth(spark, d))).select("path", F.array_join("exports", ",").alias("exports"))


@query
def call_graph(spark, d):
    return symbols.call_edges(symbols.extract(_synth(spark, d)))


@query
def ambiguous_names(spark, d):
    return symbols.ambiguous_names(symbols.extract(_synth(spark, d)))


SNIPPETS = {
    "rust": "pub fn open(a: i32, b: &str) -> bool {\n    true\n}\nstruct Point {\n    x: i32,\n}\npub enum Shape { A }\nconst fn quick() {}\nimpl Point {\n    pub(crate) fn len(&self) -> i32 {\n        1\n    }\n}\nmacro_rules! twice { () => {} }\n",
    "typescript": "export class Box {\n  private fill(a: number) {\n    pour(a)\n  }\n}\nexport const add = (a: number) => a\nfunction plain(x) {\n}\ninterface Shape {\n}\ntype Id = string\n",
    "go": "package x\n\nfunc Open(a int) error {\n}\nfunc (b *Box) fill(n int) {\n}\ntype Box struct {\n}\ntype Shape interface {\n}\ntype Id string\n",
    "java": "public class Box {\n    private int size = 3;\n    public int fill(int a) {\n        return pour(a);\n    }\n}\ninterface Shape {\n}\n",
}


@query
def snippet_symbols(spark, d):
    """Each supplier has a file of each snippet."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("language"), F.lit(v).alias("content")) for k, v in SNIPPETS.items())))
    rows = V.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), each.alias("r")).select(F.concat(F.lit("snippet"), "k", F.lit("."), "r.language").alias("path"), "r.language", "r.content")
    return symbols.extract(rows).select("path", "ord", "name", "kind", "line", "end_line", "visibility")


@query
def pagerank_trade(spark, d):
    edges = V.graph_trade(spark, d)
    nodes = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return graph.pagerank(nodes, edges).select("node", F.round("score", 6).alias("score"))


def _user_graph(spark, d):
    edges = V.graph_users(spark, d)
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), edges


@query
def degrees(spark, d):
    return graph.degrees(*_user_graph(spark, d))


@query
def entry_points(spark, d):
    return graph.entry_points(graph.degrees(*_graph(spark, d)))


@query
def isolated(spark, d):
    return graph.isolated(graph.degrees(*_graph(spark, d))).select("node")


@query
def scc(spark, d):
    return graph.cycles(_graph(spark, d)[1])


@query
def trace_flow(spark, d):
    calls = _resolved(spark, d).where("resolved is not null").select(F.col("path").alias("from_symbol"), F.col("resolved").alias("to_symbol"))
    lowest = V.synth_edges(spark, d).agg(F.min("src")).first()[0]
    first = V.files_synth(spark, d).where(F.col("k") == F.lit(lowest)).select("path").first()
    return graph.trace(calls, first.path if first else "", 4)


@query
def trace_calls(spark, d):
    calls = symbols.call_edges(symbols.extract(_synth(spark, d)))
    return graph.trace_calls(calls, "fill_0", 3).select("from_symbol", "to_symbol", "depth")


@query
def chunks(spark, d):
    return retrieval.chunks(V.files_documents(spark, d)).select("path", "chunk", "line_start", "line_end", C.content_hash(F.col("content")).alias("hash"))


def _index(spark, d):
    return retrieval.Index.build(V.files_documents(spark, d))


def _questions(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("content"))


@query
def tf(spark, d):
    return _index(spark, d).tf


@query
def idf(spark, d):
    return _index(spark, d).idf.select("token", "df", F.round("idf", 6).alias("idf"))


@query
def chunk_norms(spark, d):
    return _index(spark, d).norms.select("path", "chunk", F.round("norm", 5).alias("norm"))


@query
def retrieve_top5(spark, d):
    return retrieval.retrieve(_index(spark, d), _questions(spark, d))


@query
def rag_context(spark, d):
    index, asked = _index(spark, d), _questions(spark, d)
    found = graph.written(retrieval.retrieve(index, asked))
    return retrieval.context(found, index.passages(found), asked).select("question", F.sha2("context", 256).alias("context_sha256"))


@query
def content_hash(spark, d):
    return V.files_documents(spark, d).select("path", C.content_hash(F.col("content")).alias("hash"))


@query
def fingerprint(spark, d):
    return retrieval.fingerprint(V.files_synth(spark, d).withColumn("size", F.octet_length("content").cast("long")), "/corpus")


@query
def truncate_utf8(spark, d):
    return V.table(spark, d, "documents").select("doc_id", *(F.octet_length(C.truncate_utf8(F.col("text"), n)).cast("long").alias(f"bytes_{n}") for n in (50, 101, 4096)))


@query
def cache_latest(spark, d):
    return cache.latest(V.kv_events(spark, d), "event_id").select("key", "value", F.round("created_at", 3).alias("created_at"))


@query
def cache_ttl(spark, d):
    now = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) / 1e6
    return cache.fresh(V.kv_events(spark, d), now, 7 * 86400, "event_id").select("key", "value")


@query
def incremental_plan(spark, d):
    docs_ = V.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), C.content_hash(F.col("text")).alias("inputs"))
    new = docs_.where("page_id % 10 <> 1").withColumn("inputs", F.when(F.col("page_id") % 10 == 2, F.concat("inputs", F.lit("x"))).otherwise(F.col("inputs")))
    return cache.page_plan(docs_.where("page_id % 10 <> 0"), new)


@query
def chat_window(spark, d):
    return completion.chat_window(V.table(spark, d, "conversations"), 4).select("conv_id", "turn", "role", C.content_hash(F.col("text")).alias("hash"))


@query
def normalize_path(spark, d):
    p = V.files_documents(spark, d).select("path", F.concat(F.lit("./x/../"), F.replace("path", F.lit("/"), F.lit("/./q/..//"))).alias("messy"))
    return p.select("path", C.normalize_path(F.col("messy")).alias("normal"))


@query
def module_names(spark, d):
    p = V.files_documents(spark, d).select(F.concat(F.element_at(F.array(*map(F.lit, ("src/", "crates/", "lib/", ""))), (F.col("doc_id") % 4 + 1).cast("int")), "path").alias("path"))
    return p.select("path", C.module_name(F.col("path")).alias("graph_module"), C.module_name(F.col("path"), C.INDEX_ROOTS).alias("index_module"))


@query
def rel_href(spark, d):
    p = V.files_documents(spark, d).select("doc_id", F.regexp_replace("path", r"\.[a-z]+$", "").alias("id"))
    here = F.element_at(F.array(F.lit("index"), F.lit("src0/x"), F.lit("src1/en/y"), F.lit("a/b/c/d")), (F.col("doc_id") % 4 + 1).cast("int"))
    return p.select("doc_id", C.relative_href(here, F.col("id")).alias("href"))


@query
def strip_md(spark, d):
    t = V.table(spark, d, "pages").select("page_id", F.concat(F.lit("see [a]("), "page_id", F.lit(".md) and [b]("), "url", F.lit(".md) and [c](x/y.md)")).alias("t"))
    return t.select("page_id", C.strip_md_links(F.col("t")).alias("text"))


@query
def html_escape(spark, d):
    return V.table(spark, d, "pages").select("page_id", C.content_hash(C.html_escape(F.col("html"))).alias("hash"))


@query
def git_url_parse(spark, d):
    kinds = ("https://github.com/", "http://www.gitlab.com/", "bitbucket.org/", "https://example.org/")
    host = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % 4 + 1).cast("int"))
    url = F.concat(host, F.lit("own"), "page_id", F.lit("/repo"), "page_id", F.when(F.col("page_id") % 3 == 0, ".git").when(F.col("page_id") % 3 == 1, "/").otherwise(""))
    g = C.git_url(url)
    return V.table(spark, d, "pages").select("page_id", g["host"].alias("host"), g["owner"].alias("owner"), g["repo"].alias("repo"))


@query
def extract_json(spark, d):
    body = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "k": [1, 2]}'))
    i = F.col("doc_id") % 4
    answer = F.when(i == 0, body).when(i == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i == 2, F.concat(F.lit("Sure: "), body, F.lit(" as asked."))).otherwise(F.lit("nothing here"))
    rows = V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), answer.alias("answer"))
    return completion.with_json(rows).select("key", "json")


@query
def completions(spark, d):
    rows = V.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.concat(F.lit("Q: "), "text").alias("prompt"))
    return completion.complete(rows).select("key", F.get_json_object("answer", "$.chars").cast("long").alias("chars"))


@query
def cross_links(spark, d):
    f = _synth(spark, d)
    page = F.concat(F.lit("files/"), F.col("k").cast("string"))
    bodies = f.select(page.alias("page_id"), F.concat(F.lit("Uses `src/n0/s0.py`, `Box"), F.col("k").cast("string"), F.lit("` and `Box"), ((F.col("k") + 1) % 7).cast("string"), F.lit("`.\n```\n`Box0`\n```\n[`Box1`](x.md)")).alias("content"))
    names = symbols.extract(f).join(f.select("path", page.alias("page_id")), "path").select("name", "page_id")
    return docs.links(bodies, docs.link_targets(f.select("path", page.alias("page_id")), names))


@query
def symbol_page_counts(spark, d):
    s = symbols.extract(_synth(spark, d)).withColumn("module", C.module_name(F.col("path"), C.INDEX_ROOTS))
    return s.groupBy("kind", "module").agg(F.count_distinct("name").alias("n"))


@query
def dependency_page(spark, d):
    nodes, edges = _graph(spark, d)
    nodes, edges = graph.written(nodes), graph.written(edges)
    top = graph.pagerank(nodes, edges).withColumn("r9", F.round("score", 9)).orderBy(F.desc("r9"), "node").limit(wiki.TOP_FILES)
    ranked = top.select(F.struct(-F.col("r9"), "node").alias("rank"), F.col("node").alias("path"))
    return wiki.dependency_page(ranked, graph.degrees(nodes, edges), graph.cycles(edges), graph.diagram(graph.module_edges(edges)))


@query
def module_hash(spark, d):
    f = V.files_synth(spark, d)
    return wiki.module_hash(f.select(C.module_name(F.col("path"), C.INDEX_ROOTS).alias("module"), "path", C.content_hash(F.col("content")).alias("content_hash")))


@query
def module_context(spark, d):
    s = symbols.extract(_synth(spark, d)).withColumn("module", C.module_name(F.col("path"), C.INDEX_ROOTS))
    return wiki.module_context(s)


@query
def module_summaries(spark, d):
    """One generation pass over the modules with the offline completer; it gives no purpose, so the default shows."""
    s = symbols.extract(_synth(spark, d)).withColumn("module", C.module_name(F.col("path"), C.INDEX_ROOTS))
    answers, _ = wiki.run_pass(wiki.module_context(s).select(F.col("module").alias("key"), F.col("context").alias("prompt")))
    sizes = s.groupBy("module").agg(F.count_distinct("path").alias("files"))
    return wiki.module_docs(answers, sizes)


@query
def sidebar(spark, d):
    n = V.table(spark, d, "supplier").select(F.concat(F.lit("modules/n"), "s_nationkey").alias("page_id"), F.concat(F.lit("n"), "s_nationkey").alias("title")).distinct()
    fixed = spark.createDataFrame([("symbols", "Symbols"), ("index", "Overview"), ("dependencies", "Dependencies")], "page_id string, title string")
    return wiki.sidebar(n.unionByName(fixed))


@query
def stream_text(spark, d):
    body = F.concat(F.lit('data: {"choices": [{"delta": {"content": "id "}}]}\n\ndata: {"choices": [{"delta": {"content": "'), F.col("item_id").cast("string"), F.lit('"}}]}\n: note\ndata: [DONE]\n'))
    return wiki.stream_text(V.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("key"), body.alias("body")))


@query
def usage_totals(spark, d):
    body = F.concat(F.lit('{"usage": {"prompt_tokens": '), F.col("item_id").cast("string"), F.lit(', "completion_tokens": 2}}'))
    return wiki.usage_totals(V.table(spark, d, "benchmark").select(body.alias("body")))


@query
def key_files_context(spark, d):
    f = scan.described(V.files_documents(spark, d).withColumn("path", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("/README.md"))).otherwise(F.col("path"))))
    return wiki.key_files_context(f.withColumn("ord", F.col("doc_id"))).select(F.sha2("context", 256).alias("context_sha256"))


@query
def render_html(spark, d):
    return docs.rendered(V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.concat(F.lit("# Title\n- a\n- **b**\n\n"), "text").alias("content")))


@query
def stream_incremental(spark, d):
    from siltworks.streaming.reindex import run_available

    root = graph.shared_folder(spark, "stream")
    table = V.table(spark, d, "documents")
    run_available(spark, f"{d}/documents*.parquet", f"{root}/out", f"{root}/state", table.schema)
    return spark.read.parquet(f"{root}/out")


QUERIES |= details.QUERIES
ORACLES |= details.ORACLES
