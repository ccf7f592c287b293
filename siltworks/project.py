"""One project from folder to answers: the engine's operators in the order a user needs them."""

from __future__ import annotations

import pathlib
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.columns import content_hash, line_count
from siltworks.operators import cache, completion, docs, graph, imports, incremental, passes, retrieval, scan, symbols, wiki
from siltworks.sources import project as helpers
from siltworks.sources.tree import read_tree


def content_name(text: str) -> str:
    """text as part of a folder's name."""
    return re.sub(r"[^A-Za-z0-9.]+", "-", text)


class Project:
    """files has path, size, content, raw; rules are parsed ignore rules.

    cache: a folder (on a cluster, one that all machines share) where symbols, imports, the retrieval index and answers to
    prompts stay from call to call, so that only changed files are parsed and only changed prompts asked.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, name: str, rules: list | None = None, config: helpers.Config | None = None, exclude: tuple = (), cache: str | None = None):
        self.spark, self.name, self.config, self.cache = spark, name, config or helpers.Config(), cache
        self.progress: list[str] = []
        self.asked: list[DataFrame] = []
        judged = scan.with_reason(files, self.config.max_file_size, rules, exclude, raw="raw")
        self.scanned = graph.written(scan.cap(judged, self.config.max_files).drop("raw"))

    @classmethod
    def from_path(cls, spark: SparkSession, root: str, config: helpers.Config | None = None, exclude: tuple = (), cache: str | None = None) -> Project:
        """A local folder, or a repository's address (cloned to a cache folder first)."""
        import os

        config = config or helpers.Config()
        if helpers.is_url(root):
            root = str(helpers.fetch(root, pathlib.Path.home() / ".cache/siltworks"))
        if not os.path.isdir(root):
            raise NotADirectoryError(f"no folder at {root}")
        raw = read_tree(spark, root, maxFileSize=config.max_file_size, skipDirs=",".join((*scan.SKIP_DIRS, *exclude)))
        files = raw.withColumn("content", F.try_validate_utf8(F.coalesce(F.col("raw"), F.lit(b"")).cast("string")))
        files = files.withColumn("content", F.coalesce("content", F.lit("")))
        rules = [r for n in (".gitignore", ".siltignore") if os.path.isfile(f"{root}/{n}") for r in scan.parse_ignore(open(f"{root}/{n}", encoding="utf-8", errors="ignore").read())]
        project = cls(spark, files, pathlib.Path(root).resolve().name, rules, config, exclude, cache)
        project.name = helpers.guess_name(scan.in_order(project.files), root)
        return project

    @cached_property
    def files(self) -> DataFrame:
        return scan.described(self.scanned.where("reason is null"))

    def report(self) -> DataFrame:
        return scan.report(self.scanned)

    def tree_text(self, most: int = 200) -> str:
        return scan.tree_text(self.files, most).first().text

    def tree(self) -> DataFrame:
        return scan.tree_rows(self.files)

    def _parsed(self, name: str, parse) -> DataFrame:
        """parse(files), from the cache where there is one."""
        if self.cache is None:
            return graph.written(parse(self.files))
        return incremental.FileCache(self.spark, self.cache, name, parse).rows(self.files)

    @cached_property
    def imports(self) -> DataFrame:
        return graph.written(imports.resolve(self._parsed("imports", imports.extract), self.files))

    def edges(self) -> DataFrame:
        return imports.edges(self.imports)

    def nodes(self) -> DataFrame:
        return self.files.select(F.col("path").alias("node"))

    def map(self, top: int = 50) -> DataFrame:
        """rank, path, score, share of the best score, language, lines."""
        best = graph.pagerank(self.nodes(), self.edges()).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "node").limit(top)
        from pyspark.sql.window import Window

        order = Window.orderBy(F.desc("score"), "node")  # at most `top` rows
        ranked = best.withColumn("rank", F.row_number().over(order)).withColumn("share", F.col("score") / F.first("score").over(order))
        about = self.files.select(F.col("path").alias("node"), "language", line_count(F.col("content")).alias("lines"))
        return ranked.join(about, "node", "left").select("rank", F.col("node").alias("path"), "score", "share", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("lines", F.lit(0)).alias("lines"))

    @cached_property
    def _symbols(self) -> DataFrame:
        return self._parsed("symbols", symbols.extract)

    def symbols(self) -> DataFrame:
        return self._symbols

    def metrics(self) -> DataFrame:
        return symbols.metrics(self.files)

    def modules(self) -> DataFrame:
        return symbols.module_rollup(self.metrics(), self._symbols).orderBy(F.desc("files"), "module")

    def call_graph(self) -> DataFrame:
        return symbols.call_edges(self._symbols)

    def flow(self, entry: str, depth: int = 5) -> DataFrame:
        """Calls reachable from a symbol's name, breadth first."""
        return graph.trace_calls(self.call_graph(), entry, depth).orderBy("depth", "place").drop("place")

    @cached_property
    def indexed_imports(self) -> DataFrame:
        """Imports as the index reads them, with the names they bring in; unresolved ones have a null path."""
        return graph.written(imports.resolve(imports.extract_indexed(self.files), self.files, "index"))

    def indexed_files(self) -> DataFrame:
        """One nested row a file: path, language, size, lines, metrics, symbols, imports, exports, content_hash."""
        nested = lambda rows, name, *fields: rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias(name))
        metric = self.metrics().select("path", F.struct("code_lines", "comment_lines", "blank_lines", "complexity").alias("metrics"))
        own = nested(self._symbols, "symbols", "name", "kind", "line", "end_line", "visibility", "params", "return_type", "doc_comment", "decorators", "calls", "fields")
        brought = nested(self.indexed_imports, "imports", "raw", F.col("resolved").alias("resolved_path"), "symbols")
        out = self.files.select("path", "language", "size", "lines", content_hash(F.col("content")).alias("content_hash"))
        for more in (metric, own, brought, symbols.exports(self._symbols)):
            out = out.join(more, "path", "left")
        return out

    def module_links(self) -> tuple[DataFrame, DataFrame]:
        return imports.module_links(self.indexed_imports)

    def totals(self) -> DataFrame:
        return passes.totals(self)

    def document(self, completer: completion.Completer = completion.offline, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(page_id, title, content of every page; rows for the cache): all generation passes, then assembly.

        Without known rows, the cache's are used and the new ones put there.
        """
        if known is not None or self.cache is None:
            return passes.document(self, completer, known)
        store = cache.Store(self.spark, f"{self.cache}/answers-{content_name(self.config.model)}")
        pages, rows = passes.document(self, completer, store.fresh().select("key", "value"))
        pages = graph.written(pages)
        store.put(rows)
        return pages, rows

    def usage(self) -> DataFrame:
        """One row: prompts asked so far by document(), calls, tokens and failures."""
        rows = self.spark.createDataFrame([], completion.ASKED)
        for more in self.asked:
            rows = rows.unionByName(more)
        return completion.usage(rows)

    def progress_since(self, seen: int = 0) -> list[tuple[int, str]]:
        """Steps from the one numbered `seen` on; the last is "done"."""
        return list(enumerate(self.progress))[seen:]

    def file(self, path: str) -> DataFrame:
        return self.files.where(F.col("path") == path).select("path", "language", "lines", "content")

    def graph(self, top: int = 20) -> dict:
        """The best files with their scores and the links between modules, for display."""
        best = self.map(top).orderBy("rank").select("path", "score").collect()
        pairs = graph.module_edges(self.edges()).orderBy("src", "dst").toLocalIterator()
        return {"files": [r.asDict() for r in best], "modules": [r.asDict() for r in pairs]}

    def export(self, folder: str, completer: completion.Completer = completion.offline, form: str = "markdown", wiki_links: bool = False, full: bool = False):
        """Write all pages: form markdown (with sidebar and front page), json or html."""
        pages = graph.written(self.document(completer)[0])
        side = wiki.sidebar(pages.select("page_id", "title")).first().text
        if form == "json":
            return docs.export_json(pages, side, self.name, f"{folder}/wiki.json")
        if form == "html":
            return wiki.html_site(pages, self.name, f"{folder}/index.html", side)
        summary = docs.export_markdown(pages, folder, wiki_links, full)
        overview = pages.where("page_id = 'index'").first().content
        for name, text in (("_sidebar.md", side), ("README.md", docs.readme(overview, side, self.name, wiki_links))):
            (pathlib.Path(folder) / name).write_text(text)
        if not wiki_links:
            wiki.site_loader(folder, self.name)
        return summary

    def cycles(self) -> DataFrame:
        return graph.cycles(self.edges())

    def index(self) -> retrieval.Index:
        return retrieval.Index.build(self.files) if self.cache is None else incremental.IndexStore(self.spark, f"{self.cache}/index").index(self.files)

    def ask(self, questions: list[str], completer: completion.Completer = completion.offline, k: int = 5, history: list[tuple[str, str]] = (), index: retrieval.Index | None = None, prompts: list | None = None) -> DataFrame | None:
        """question, context and answer of each question. history: earlier (role, text) turns; the last 12 that count go along.

        An index that was built or loaded before may be given. With a list as prompts, it gets the prompts and nothing is asked.
        """
        asked = self.spark.createDataFrame(list(enumerate(questions)), "question long, content string")
        index = index or self.index()
        found = retrieval.context(retrieval.retrieve(index, asked, k), index.chunks, asked)
        turns = self.spark.createDataFrame([(0, n, *turn) for n, turn in enumerate(history)], "conv_id long, turn long, role string, text string")
        said = completion.chat_window(turns).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"], F.lit("\n"))), "").alias("said"))
        whole = found.join(asked, "question").crossJoin(F.broadcast(said))  # said is one row
        whole = whole.select(F.col("question").cast("string").alias("key"), F.concat("context", F.lit("\n\n"), "said", F.lit("Question: "), "content").alias("prompt"))
        if prompts is not None:
            prompts += [r.prompt for r in whole.orderBy(F.col("key").cast("long")).collect()]  # as many as questions
            return None
        answers = completion.complete(whole, completer)
        return found.join(answers, found.question.cast("string") == answers.key).select("question", "context", "answer")

    def pages(self, completer: completion.Completer = completion.offline) -> DataFrame:
        """page_id, content of every page."""
        return self.document(completer)[0].select("page_id", "content")

    def references(self, question: str, k: int = 5, index: retrieval.Index | None = None) -> list[dict]:
        """The passages that an answer rests on, best first: path, line_start, line_end and the first 200 characters."""
        index = index or self.index()
        asked = self.spark.createDataFrame([(0, question)], "question long, content string")
        rows = retrieval.retrieve(index, asked, k).join(index.chunks, ["path", "chunk"]).orderBy("rank")
        return [r.asDict() for r in rows.select("path", "line_start", "line_end", F.substring("content", 1, 200).alias("snippet")).collect()]  # k rows

    def plan(self, old: DataFrame) -> DataFrame:
        """What an export would do, given the page_id, inputs of the last one."""
        return cache.page_plan(old, self.pages().select("page_id", content_hash(F.col("content")).alias("inputs")))
