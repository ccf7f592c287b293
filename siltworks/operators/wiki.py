"""Wiki assembly: contexts for generation, the passes that fill pages, and the pages themselves.

A pass turns a prompt table into answers through a completer, keyed by content: answers that a cache table holds are not
asked for again. Answers that don't parse leave defaults, so assembly never depends on a provider.
"""

from __future__ import annotations

import html
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import content_hash, truncate_utf8
from siltworks.operators import cache, completion, docs, graph

# How many entries pages and prompts show.
TOP_FILES, ENTRY_POINTS, ISOLATED, CYCLES, GUIDE_FILES, SHOWN_SYMBOLS = 10, 10, 15, 10, 20, 5
KEY_FILE_BYTES, DOC_BYTES = 4096, 120


def ordered(rows: Column, separator: str = "\n") -> Column:
    """The field t of collected structs, in the order of the fields before it."""
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["t"]), separator)


# ---- contexts -------------------------------------------------------------------------------------------------------
def key_files_context(files: DataFrame) -> DataFrame:
    """One row, context: configs and entry points (files: ord, path, content, is_config, is_entrypoint), each cut at 4096 bytes."""
    text = F.concat(F.lit("## "), "path", F.lit("\n"), truncate_utf8(F.col("content"), KEY_FILE_BYTES))
    return files.where("is_config or is_entrypoint").agg(ordered(F.collect_list(F.struct("ord", text.alias("t"))), "\n\n").alias("context"))


def module_context(symbols: DataFrame) -> DataFrame:
    """module, context: signatures of a module's symbols (module, path, ord, name, kind, params, return_type, doc_comment).

    Doc comments are cut at 120 bytes, between characters.
    """
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.when(p["type_hint"].isNull(), "").otherwise(F.concat(F.lit(": "), p["type_hint"])))), ", ")
    line = F.concat(F.lit("- "), "kind", F.lit(" "), "name", F.lit("("), params, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "return_type"), F.lit("")), F.coalesce(F.concat(F.lit(": "), truncate_utf8(F.col("doc_comment"), DOC_BYTES)), F.lit("")))
    per_file = symbols.groupBy("module", "path").agg(F.concat(F.lit("### "), "path", F.lit("\n"), ordered(F.collect_list(F.struct("ord", line.alias("t"))))).alias("t"))
    return per_file.groupBy("module").agg(ordered(F.collect_list(F.struct("path", "t")), "\n\n").alias("context"))


def module_hash(files: DataFrame) -> DataFrame:
    """module, hash: digest of the file hashes (files: module, path, content_hash), by path."""
    return files.groupBy("module").agg(content_hash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content_hash"))), lambda x: x["content_hash"]), ":")).alias("hash"))


# ---- passes ---------------------------------------------------------------------------------------------------------
def run_pass(prompts: DataFrame, known: DataFrame | None = None, completer: completion.Completer = completion.offline, at_once: int | None = None, told: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, json of every prompt; rows to put into the cache). prompts: key, prompt; known: key, value of fresh cache rows.

    The cache key is the prompt's key and its content, so changed inputs ask again. Failures are not cached. With a list
    as told, it gets the rows of completion.asked() for what was asked.
    """
    keyed = prompts.withColumn("key", F.concat("key", F.lit(":"), content_hash(F.col("prompt"))))
    hits, misses = cache.probe(keyed, known) if known is not None else (None, keyed)
    answers = graph.written(completion.asked(misses, completer, at_once))
    if told is not None:
        told.append(answers)
    new = graph.written(completion.with_json(answers.select("key", "answer")).select("key", F.col("json").alias("value")))
    every = new if hits is None else new.unionByName(hits.select("key", "value"))
    bare = F.regexp_replace("key", ":[0-9a-f]{24}$", "")
    return every.select(bare.alias("key"), F.col("value").alias("json")), new.where("value is not null").withColumn("created_at", F.unix_micros(F.current_timestamp()) / 1e6)


def module_docs(answers: DataFrame, sizes: DataFrame) -> DataFrame:
    """module, purpose of every module (sizes: module, files); a fixed sentence where the answer has none."""
    purpose = F.get_json_object("json", "$.purpose")
    default = F.concat(F.lit("Module containing "), F.col("files").cast("string"), F.lit(" files"))
    return sizes.join(answers.withColumnRenamed("key", "module"), "module", "left").select("module", F.coalesce(purpose, default).alias("purpose"))


# ---- pages ----------------------------------------------------------------------------------------------------------
def dependency_page(ranked: DataFrame, degree: DataFrame, cycles: DataFrame, diagram: DataFrame) -> DataFrame:
    """One row (page_id, content): best files (rank, path), entry points, cycles, isolated files, module diagram.

    Lists are cut where they are made: each is a sorted limit before it is joined to text.
    """

    def section(title: str, rows: DataFrame, by: list[str], text: Column, most: int) -> DataFrame:
        top = rows.orderBy(*by).limit(most).select(F.struct(*by).alias("o"), text.alias("t"))
        return top.agg(F.when(F.count("*") > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n"), F.lit("\n"))).otherwise("").alias("t"))

    code = lambda c: F.concat(F.lit("- `"), c, F.lit("`"))
    groups = cycles.groupBy("component").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("node")).alias("members")).withColumn("less", -F.col("n"))
    parts = [
        section("Core files", ranked, ["rank"], code(F.col("path")), TOP_FILES),
        section("Entry points", graph.entry_points(degree), ["node"], code(F.col("node")), ENTRY_POINTS),
        section("Cycles", groups, ["less", "component"], code(F.array_join("members", "` -> `")), CYCLES),
        section("Isolated files", graph.isolated(degree), ["node"], code(F.col("node")), ISOLATED),
        diagram.select(F.concat(F.lit("## Modules\n```mermaid\n"), "text", F.lit("\n```\n")).alias("t")),
    ]
    whole = parts[0].select(F.lit(0).alias("i"), "t")
    for i, part in enumerate(parts[1:], 1):
        whole = whole.unionByName(part.select(F.lit(i).alias("i"), "t"))
    return whole.agg(F.concat(F.lit("# Dependencies\n"), ordered(F.collect_list(F.struct("i", "t")), "")).alias("content")).select(F.lit("dependencies").alias("page_id"), "content")


# The order of pages in the sidebar; modules stand between.
PAGE_ORDER = {"index": 0, "architecture": 1, "reading-guide": 10, "dependencies": 11, "symbols": 12}


def _place() -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PAGE_ORDER.items() for x in kv)), F.col("page_id")), F.lit(2))


def sidebar(pages: DataFrame) -> DataFrame:
    """One row, text: links to the pages (page_id, title) in their order, module pages indented under one heading."""
    place = _place()
    inside = F.col("page_id").startswith("modules/")
    line = F.concat(F.when(inside, "  ").otherwise(""), F.lit("- ["), "title", F.lit("]("), "page_id", F.lit(".md)"))
    rows = pages.select(place.alias("place"), "page_id", line.alias("t"))
    head = pages.where(inside).limit(1).select(F.lit(2).alias("place"), F.lit("").alias("page_id"), F.lit("- Modules").alias("t"))
    return rows.unionByName(head).agg(ordered(F.collect_list(F.struct("place", "page_id", "t"))).alias("text"))


_DRAW = '<script src="https://cdn.jsdelivr.net/npm/mermaid@11/dist/mermaid.min.js"></script>'
_SHOW = """<script>
function showPage(id) { document.querySelectorAll("section").forEach(s => s.hidden = s.id !== "page-" + id); if (window.mermaid) mermaid.run({ querySelector: "section:not([hidden]) .mermaid" }); }
if (window.mermaid) mermaid.initialize({ startOnLoad: false });
showPage(document.querySelector("section").id.slice(5));
</script>"""


def html_site(pages: DataFrame, name: str, path: str, side: str = "") -> bool:
    """All rendered pages as one HTML file, one shown at a time, with the sidebar (text of sidebar()) as navigation.

    A project's pages are few; they come to the driver one by one. Left alone if nothing changed. True if it was written.
    """
    known = frozenset(r.page_id for r in pages.select("page_id").toLocalIterator())
    found = docs.rendered(pages, known).withColumn("place", _place()).orderBy("place", "page_id")
    body = "\n".join(f'<section id="page-{r.page_id}" hidden>\n{r.html}\n</section>' for r in found.toLocalIterator())
    nav = docs.markdown_to_html(re.sub(r"(?m)^ +", "", side), "", known)
    head = f'<meta charset="utf-8"><title>{html.escape(name)}</title>{_DRAW}'
    return _replaced(path, f"<!doctype html>\n<html><head>{head}</head><body>\n<nav>\n{nav}\n</nav>\n{body}\n{_SHOW if known else ''}\n</body></html>\n")


def _replaced(path: str, text: str) -> bool:
    target = Path(path)
    if target.exists() and target.read_text() == text:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    return True


def site_loader(folder: str, name: str) -> None:
    """The two files that let a static host show the Markdown pages, with sidebar and diagrams."""
    base = "https://cdn.jsdelivr.net/npm/"
    settings = json.dumps({"name": name, "homepage": "README.md", "loadSidebar": "_sidebar.md", "subMaxLevel": 2})
    loads = "".join(f'<script src="{base}{x}"></script>\n' for x in ("docsify@4", "mermaid@11/dist/mermaid.min.js", "docsify-mermaid@2/dist/docsify-mermaid.js"))
    text = f'<!doctype html>\n<html><head><meta charset="utf-8"><title>{html.escape(name)}</title><link rel="stylesheet" href="{base}docsify@4/lib/themes/vue.css"></head>\n<body><div id="app"></div>\n<script>window.$docsify = {settings}</script>\n{loads}<script>mermaid.initialize({{ startOnLoad: false }})</script></body></html>\n'
    _replaced(f"{folder}/index.html", text)
    _replaced(f"{folder}/.nojekyll", "")


def stream_text(answers: DataFrame) -> DataFrame:
    """key, text: the joined deltas of streamed completions (key, body); lines that begin with "data:" hold JSON, [DONE] ends."""
    lines = F.filter(F.split("body", r"\r?\n"), lambda x: x.startswith("data:"))
    deltas = F.transform(lines, lambda x: F.coalesce(F.get_json_object(F.trim(F.substring(x, F.lit(6), F.length(x))), "$.choices[0].delta.content"), F.lit("")))
    return answers.select("key", F.array_join(deltas, "").alias("text"))


def usage_totals(answers: DataFrame) -> DataFrame:
    """prompt_tokens, completion_tokens over the bodies of completions (body as JSON)."""
    n = lambda k: F.coalesce(F.sum(F.get_json_object("body", f"$.usage.{k}").cast("long")), F.lit(0)).alias(k)
    return answers.agg(n("prompt_tokens"), n("completion_tokens"))

