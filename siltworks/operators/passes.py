"""Generation passes over one project and the documents they fill: overview, modules, architecture, reading guide.

Each pass is a prompt table, a completer and a schema that its JSON answers are read with. Fields that an answer lacks are
null and leave their block of the page out, so a page never depends on a provider.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions.columns import INDEX_ROOTS, module_name
from siltworks.operators import completion, docs, graph, scan, symbols, wiki

# Fields of the answers.
OVERVIEW = "name string, one_liner string, description string, tech_stack array<struct<name:string,category:string,version:string>>, setup_instructions array<string>, key_features array<string>"
MODULE = (
    "name string, purpose string, description string, files array<struct<path:string,purpose:string,key_symbols:array<struct<name:string,kind:string,line:bigint,description:string>>>>, "
    "relationships array<struct<source:string,target:string,description:string>>, key_concepts array<struct<name:string,explanation:string>>"
)
ARCHITECTURE = "architecture_type string, description string, components array<struct<name:string,purpose:string,files:array<string>>>, mermaid_component string, mermaid_sequence string, data_flow string"
GUIDE = "introduction string, steps array<struct<order:bigint,title:string,files:array<string>,explanation:string,time_estimate:string>>, tips array<string>"
TITLES = {"index": "Overview", "architecture": "Architecture", "reading-guide": "Reading Guide", "dependencies": "Dependencies", "symbols": "Symbols"}


# ---- blocks: null where there is nothing to say; concat_ws then leaves them out ----------------------------------------
def _said(c: Column, before: str = "", after: str = "") -> Column:
    return F.when(c != "", F.concat(F.lit(before), c, F.lit(after)))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(title: str, items: Column, line: Callable[..., Column]) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(items, line), "\n")))


def _page(*blocks: Column) -> Column:
    return F.concat_ws("\n\n", *blocks)


def coverage_line() -> Column:
    """How much of a tree was kept and why the rest was not, from the columns of scan.report()."""
    counts = (("oversized_count", " oversized"), ("binary_count", " binary"), ("minified_count", " minified/generated"), ("priority_dropped", " lower-priority over the file cap"))
    drops = F.concat_ws(", ", *(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(t))) for c, t in counts))
    return F.concat_ws("; ", F.concat(F.col("kept").cast("string"), F.lit(" of "), F.col("candidates").cast("string"), F.lit(" files")), _said(drops, "skipped: "))


def overview_page(answer: DataFrame, report: DataFrame, name: str) -> DataFrame:
    """page_id, content; answer: one row with d (OVERVIEW), report: scan.report()."""
    note = F.when(F.col("kept") < F.col("candidates"), F.concat(F.lit("> Partial coverage: "), coverage_line(), _or_empty(_said(F.col("oversized"), "; left out for size: ")), F.lit(".")))
    d = F.col("d")
    tech = _list("Tech Stack", d["tech_stack"], lambda t: F.concat(F.lit("- **"), t["name"], F.lit("**"), _or_empty(_said(t["version"], " ")), _or_empty(_said(t["category"], " (", ")"))))
    steps = _list("Getting Started", d["setup_instructions"], lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    title = F.concat(F.lit("# "), F.coalesce(_said(d["name"]), F.lit(name)))
    features = _list("Key Features", d["key_features"], lambda f: F.concat(F.lit("- "), f))
    return report.crossJoin(answer).select(F.lit("index").alias("page_id"), _page(title, _said(d["one_liner"], "> "), _said(d["description"]), note, tech, features, steps).alias("content"))


def module_pages(answers: DataFrame, sizes: DataFrame) -> DataFrame:
    """page_id modules/<name>, content of every module (sizes: module, files); answers: key, d (MODULE)."""
    d = F.col("d")
    symbol = lambda s: F.concat(F.lit("- `"), s["name"], F.lit("` ("), _or_empty(s["kind"]), F.lit(")"), _or_empty(_said(s["description"], " - ")))
    one_file = lambda f: F.concat(F.lit("### `"), f["path"], F.lit("`"), _or_empty(_said(f["purpose"], "\n")), F.when(F.size(f["key_symbols"]) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(f["key_symbols"], symbol), "\n"))).otherwise(""))
    purpose = F.coalesce(_said(d["purpose"]), F.concat(F.lit("Module containing "), F.col("files").cast("string"), F.lit(" files")))
    concepts = _list("Key Concepts", d["key_concepts"], lambda c: F.concat(F.lit("- **"), c["name"], F.lit("**: "), _or_empty(c["explanation"])))
    relations = _list("Internal Relationships", d["relationships"], lambda r: F.concat(F.lit("- `"), r["source"], F.lit("` → `"), r["target"], F.lit("`: "), _or_empty(r["description"])))
    title = F.concat(F.lit("# "), F.coalesce(_said(d["name"]), F.col("module")))
    text = _page(title, F.concat(F.lit("> "), purpose), _said(d["description"]), _list("Files", d["files"], one_file), concepts, relations)
    return sizes.join(answers.withColumnRenamed("key", "module"), "module", "left").select(F.concat(F.lit("modules/"), "module").alias("page_id"), text.alias("content"))


def architecture_page(answer: DataFrame, modules: DataFrame) -> DataFrame:
    """page_id, content; no page without a type. Components that bear a module's name are links."""
    d = F.col("d")
    known = modules.agg(F.collect_set("module").alias("known"))
    label = lambda c: F.when(F.array_contains("known", c["name"]), F.concat(F.lit("["), c["name"], F.lit("](modules/"), c["name"], F.lit(".md)"))).otherwise(c["name"])
    parts = _list("Components", d["components"], lambda c: F.concat(F.lit("- "), label(c), _or_empty(_said(c["purpose"], ": "))))
    drawn = (_said(d[k], f"## {t}\n```mermaid\n", "\n```") for k, t in (("mermaid_component", "Diagram"), ("mermaid_sequence", "Sequence")))
    text = _page(F.concat(F.lit("# Architecture\n"), d["architecture_type"]), _said(d["description"]), parts, *drawn, _said(d["data_flow"], "## Data Flow\n"))
    return answer.crossJoin(known).where(d["architecture_type"] != "").select(F.lit("architecture").alias("page_id"), text.alias("content"))


def guide_page(answer: DataFrame) -> DataFrame:
    """page_id, content; no page without steps."""
    d = F.col("d")
    step = lambda s, i: F.concat_ws("\n", F.concat(F.coalesce(s["order"], i + 1).cast("string"), F.lit(". **"), _or_empty(s["title"]), F.lit("**"), _or_empty(_said(s["time_estimate"], " (", ")"))), _said(s["explanation"], "   "), F.when(F.size(s["files"]) > 0, F.concat(F.lit("   `"), F.array_join(s["files"], "`, `"), F.lit("`"))))
    text = _page(F.lit("# Reading Guide"), _said(d["introduction"]), _list("Steps", d["steps"], step), _list("Tips", d["tips"], lambda t: F.concat(F.lit("- "), t)))
    return answer.where(F.size(d["steps"]) > 0).select(F.lit("reading-guide").alias("page_id"), text.alias("content"))


#: Symbols that a module's line in the summary names.
NAMED_SYMBOLS = 5


def module_summary(files: DataFrame, own: DataFrame) -> DataFrame:
    """module, files, line of every module: how many files and symbols it has, its first symbols, its files.

    files: path, module; own: path, ord, name of symbols. Order is that of the files, then of the symbols in them. The first
    symbols are a ranked cut, which each task makes for itself before rows move.
    """
    placed = scan.in_order(files.select("path", "module")).withColumnRenamed("ord", "file")
    held = own.select("path", "ord", "name").join(placed, "path")
    place = F.row_number().over(Window.partitionBy("module").orderBy("file", "ord"))
    named = held.withColumn("place", place).where(F.col("place") <= NAMED_SYMBOLS).groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ").alias("names"))
    counted = held.groupBy("module").agg(F.count("*").alias("n"))
    paths = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "path"))), lambda x: x["path"]), ", ")
    whole = placed.groupBy("module").agg(F.count("*").alias("files"), paths.alias("paths")).join(counted, "module", "left").join(named, "module", "left")
    line = F.concat(F.lit("- "), "module", F.lit(" ("), F.col("files").cast("string"), F.lit(" files, "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" symbols)"), F.coalesce(F.concat(F.lit(" \u2014 "), "names"), F.lit("")), F.lit("\n  Files: "), "paths")
    return whole.select("module", "files", line.alias("line"))


# ---- the passes --------------------------------------------------------------------------------------------------------
def _prompt(task: str, body: Column, language: str) -> Column:
    return F.concat(F.lit(completion.prompt(task, "", language)), body)


def document(project, completer: completion.Completer = completion.offline, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages: page_id, title, content; rows to put into the cache: key, value, created_at) of a Project.

    known holds key, value of fresh cache rows; what it holds is not asked again. Failures leave defaults and are not
    cached. project.progress takes a line for each pass.
    """
    language, new = project.config.language, []

    def run(prompts: DataFrame, schema: str) -> DataFrame:
        answers, rows = wiki.run_pass(prompts, known, completer, project.config.concurrency if completer is not completion.offline else None, project.asked)
        new.append(rows)
        return answers.select("key", F.from_json("json", schema).alias("d"))

    project.progress.append("overview")
    tree = project.tree().agg(F.array_join(F.array_sort(F.collect_list("entry")), "\n").alias("tree"))
    facts = tree.crossJoin(wiki.key_files_context(scan.in_order(project.files)))
    overview = run(facts.select(F.lit("overview").alias("key"), _prompt("Describe the project. Fields: " + OVERVIEW, F.concat("tree", F.lit("\n\n"), "context"), language).alias("prompt")), OVERVIEW).select("d")

    project.progress.append("modules")
    own = project.symbols().withColumn("module", module_name(F.col("path"), INDEX_ROOTS))
    sizes = graph.written(project.files.groupBy(module_name(F.col("path"), INDEX_ROOTS).alias("module")).agg(F.count("*").alias("files")))
    asked = sizes.join(wiki.module_context(own), "module", "left")
    modules = run(asked.select(F.col("module").alias("key"), _prompt("Describe this module. Fields: " + MODULE, F.concat("module", F.lit("\n"), _or_empty(F.col("context"))), language).alias("prompt")), MODULE)
    purposes = sizes.join(modules.withColumnRenamed("key", "module"), "module", "left").agg(F.array_join(F.array_sort(F.collect_list(F.concat("module", F.lit(": "), _or_empty(F.col("d.purpose"))))), "\n").alias("purposes"))

    lines = module_summary(project.files.select("path", module_name(F.col("path"), INDEX_ROOTS).alias("module")), own)
    summary = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("files"), "module", "line"))), lambda x: x["line"]), "\n").alias("summary"))
    purposes = graph.written(summary.crossJoin(purposes).select(F.concat("summary", F.lit("\n\n"), "purposes").alias("purposes")))  # one row each

    project.progress.append("architecture")
    architecture = run(purposes.select(F.lit("architecture").alias("key"), _prompt("Describe the architecture. Fields: " + ARCHITECTURE, F.col("purposes"), language).alias("prompt")), ARCHITECTURE).select("d")

    project.progress.append("reading guide")
    top = project.map(wiki.GUIDE_FILES).join(project.files.select("path", "is_config", "is_entrypoint"), "path")
    tag = F.when(F.col("is_entrypoint"), " (entry point)").when(F.col("is_config"), " (configuration)").otherwise("")
    ranked = top.agg(wiki.ordered(F.collect_list(F.struct("rank", F.concat("path", tag).alias("t")))).alias("ranked"))
    guide = run(ranked.crossJoin(purposes).select(F.lit("guide").alias("key"), _prompt("Suggest a reading order. Fields: " + GUIDE, F.concat("ranked", F.lit("\n\n"), "purposes"), language).alias("prompt")), GUIDE).select("d")

    project.progress.append("pages")
    edges = graph.written(project.edges())
    degree = graph.degrees(project.nodes(), edges)
    pairs = graph.written(graph.module_edges(edges))
    best = project.map(wiki.TOP_FILES).select("rank", "path")
    deps = wiki.dependency_page(best, degree, graph.cycles(edges), graph.diagram(pairs))
    deps = deps.join(pairs.limit(1).select(F.lit("dependencies").alias("page_id")), "page_id", "left_semi")
    public = own.where("visibility = 'public'").select("kind", "module", "ord", "name", F.col("doc_comment").alias("description"))
    index = docs.symbol_page(public).where("content is not null").select(F.lit("symbols").alias("page_id"), "content")
    pages = overview_page(overview, project.report(), project.name)
    for more in (module_pages(modules, sizes), architecture_page(architecture, sizes), guide_page(guide), deps, index):
        pages = pages.unionByName(more)
    page_of = F.concat(F.lit("modules/"), module_name(F.col("path"), INDEX_ROOTS))
    targets = docs.link_targets(project.files.select("path", page_of.alias("page_id")), own.select("name", page_of.alias("page_id")))
    linked = docs.linked(pages, targets).withColumn("content", F.when(F.col("page_id").startswith("modules/"), docs.plain_relationships(F.col("content"))).otherwise(F.col("content")))
    title = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv)), F.col("page_id")), F.regexp_replace("page_id", "^modules/", ""))
    rows = new[0]
    for more in new[1:]:
        rows = rows.unionByName(more)
    project.progress.append("done")
    return linked.select("page_id", title.alias("title"), "content"), rows


def totals(project) -> DataFrame:
    """One row: files, lines, symbols, call_edges."""
    counts = project.files.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return counts.crossJoin(project.symbols().agg(F.count("*").alias("symbols"))).crossJoin(symbols.call_edges(project.symbols()).agg(F.count("*").alias("call_edges")))
