"""Documentation pages: assembly, cross links, rendering, export."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.sources.pages import write_pages
from siltworks.functions.batches import frugal, text_slices
from siltworks.functions.columns import strip_md_links


def link_targets(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """span, page_id: files by path, and symbols by a name that only one symbol bears. Files win over symbols."""
    single = symbols.groupBy(F.col("name").alias("span")).agg(F.count("*").alias("n"), F.first("page_id").alias("page_id")).where("n = 1").select("span", "page_id")
    paths = files.select(F.col("path").alias("span"), "page_id")
    return paths.unionByName(single.join(paths.select("span"), "span", "left_anti"))


def spans(pages: DataFrame) -> DataFrame:
    """page_id, span: code spans outside fences that are not yet links."""
    open_text = F.regexp_replace(F.regexp_replace("content", r"(?ms)^```.*?^```", ""), r"\[`[^`]*`\]\([^)]*\)", "")
    return pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(open_text, F.lit(r"`([^`\n]+)`"), 1))).alias("span"))


def links(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """page_id, span, target of each code span that names another page's file or symbol."""
    return spans(pages).join(targets.withColumnRenamed("page_id", "target"), "span").where("page_id <> target").select("page_id", "span", "target")


def linked(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """pages (page_id, content) with those spans turned into links. A page's own links travel with it, not the whole map."""
    own = links(pages, targets).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("span", "target"))).alias("_links"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "content"):
            out = [link_text(i, c or "", dict(m or [])) for i, c, m in zip(*(part.column(n).to_pylist() for n in ("page_id", "content", "_links")), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(out, pa.string())], names=["page_id", "content"])

    return pages.select("page_id", "content").join(own, "page_id", "left").mapInArrow(frugal(run), "page_id string, content string")


def href(here: str, there: str) -> str:
    own, parts = here.split("/")[:-1], there.split("/")
    n = 0
    while n < min(len(own), len(parts) - 1) and own[n] == parts[n]:
        n += 1
    return "../" * (len(own) - n) + "/".join(parts[n:]) + ".md"


def link_text(page_id: str, text: str, targets: dict[str, str]) -> str:
    out, fenced = [], False
    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced:
            line = re.sub(r"(\[`[^`]*`\]\([^)]*\))|`([^`\n]+)`", lambda m: m[0] if m[1] or m[2] not in targets else f"[`{m[2]}`]({href(page_id, targets[m[2]])})", line)
        out.append(line)
    return "\n".join(out)


def plain_relationships(content: Column) -> Column:
    """Links around code spans taken out again from the heading of internal relationships on."""
    at = F.instr(content, "## Internal Relationships")
    rest = F.regexp_replace(F.substring(content, at, F.length(content)), r"\[(`[^`\n]+`)\]\([^)]+\)", "$1")
    return F.when(at > 0, F.concat(F.substring(content, F.lit(1), at - 1), rest)).otherwise(content)


def symbol_page(symbols: DataFrame) -> DataFrame:
    """One row: the symbol index as text, by kind, then module; the first description of a name wins (symbols: kind, module, ord, name, description)."""
    kind = F.when(F.coalesce("kind", F.lit("")) == "", "other").otherwise(F.col("kind"))
    once = symbols.withColumn("kind", kind).groupBy("kind", "module", "name").agg(F.min_by("description", "ord").alias("description"), F.min("ord").alias("ord"))
    line = F.concat(F.lit("- `"), "name", F.lit("`"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), "description")).otherwise(""))
    pick = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["t"]), "\n")
    modules = once.groupBy("kind", "module").agg(F.concat(F.lit("### "), "module", F.lit("\n"), pick(F.collect_list(F.struct("ord", "name", line.alias("t"))))).alias("t"), F.count("*").alias("n"))
    kinds = modules.groupBy("kind").agg(F.concat(F.lit("## "), "kind", F.lit("\n"), pick(F.collect_list(F.struct("module", "t")))).alias("t"), F.sum("n").alias("n"), F.count("*").alias("m"))
    return kinds.agg(F.concat(F.lit("# Symbols\n"), F.sum("n").cast("string"), F.lit(" symbols\n"), pick(F.collect_list(F.struct("kind", "t")))).alias("content"))


#: Lines that are lists, by what opens them; and headings and quotes, by the tag that holds their text.
_LISTS = ((re.compile(r"- "), "ul"), (re.compile(r"\d+\. "), "ol"))
_HEADS = (("# ", "h1"), ("## ", "h2"), ("### ", "h3"), ("> ", "blockquote"))
_LINK = re.compile(r"\[(.+?)\]\((.+?)\)")


def _escaped(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "'")


def page_of_link(page_id: str, target: str) -> str:
    """The page id that a relative link to a .md file on a page means."""
    parts: list[str] = []
    for part in [*page_id.split("/")[:-1], *target.removesuffix(".md").split("/")]:
        if part == "..":
            parts = parts[:-1]
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def inline_html(text: str, page_id: str = "", pages: frozenset = frozenset()) -> str:
    """Bold, code and links; a link to one of pages shows it (showPage)."""

    def link(m: re.Match) -> str:
        if m[2].endswith(".md") and (page := page_of_link(page_id, m[2])) in pages:
            return f"""<a href="#" onclick="showPage('{page}')">{m[1]}</a>"""
        return f'<a href="{m[2]}">{m[1]}</a>'

    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", _escaped(text))
    return _LINK.sub(link, re.sub(r"`(.+?)`", r"<code>\1</code>", text))


def _fence(language: str, rows: list[str]) -> str:
    body = _escaped("\n".join(rows))
    return f'<div class="mermaid">{body}</div>' if language == "mermaid" else f'<pre><code class="language-{language}">{body}</code></pre>'


def markdown_to_html(text: str, page_id: str = "", pages: frozenset = frozenset()) -> str:
    """A subset: fences with their language, diagrams, lists, headings to level 3, quotes, blank lines, inline_html().

    A fence without an end holds the rest of the text.
    """
    out: list[str] = []
    fence: tuple[str, list[str]] | None = None
    listed = ""
    for line in text.split("\n"):
        if fence is not None and not line.startswith("```"):
            fence[1].append(line)
            continue
        tag, rest = next(((t, line[m.end() :]) for p, t in _LISTS if fence is None and (m := p.match(line))), ("", line))
        if tag != listed and fence is None:
            out += [f"</{listed}>"] * bool(listed) + [f"<{tag}>"] * bool(tag)
            listed = tag
        if line.startswith("```"):
            if fence is not None:
                out.append(_fence(*fence))
            fence = (line[3:].strip() or "text", []) if fence is None else None
        elif tag:
            out.append(f"<li>{inline_html(rest, page_id, pages)}</li>")
        elif head := next((h for h in _HEADS if line.startswith(h[0])), None):
            out.append(f"<{head[1]}>{inline_html(line[len(head[0]) :], page_id, pages)}</{head[1]}>")
        else:
            out.append(f"<p>{inline_html(line, page_id, pages)}</p>" if line.strip() else "<br>")
    if fence is not None:
        out.append(_fence(*fence))
    return "\n".join(out + [f"</{listed}>"] * bool(listed))


def rendered(pages: DataFrame, known: frozenset = frozenset()) -> DataFrame:
    """page_id, html of pages (page_id, content); known: ids that links may show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "content"):
            ids = part.column("page_id").to_pylist()
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([markdown_to_html(c or "", i or "", known) for i, c in zip(ids, part.column("content").to_pylist(), strict=True)], pa.string())], names=["page_id", "html"])

    return pages.select("page_id", "content").mapInArrow(frugal(run), "page_id string, html string")


def export_json(pages: DataFrame, sidebar: str, name: str, path: str) -> bool:
    """pages (page_id, title, content) and the sidebar's text as one JSON file; left alone if nothing changed. True if it was written."""
    entries = [{"id": r.page_id, "title": r.title, "content": r.content} for r in pages.orderBy("page_id").toLocalIterator()]
    text = json.dumps({"project_name": name, "pages": entries, "sidebar": sidebar.split("\n")}, indent=2, ensure_ascii=False) + "\n"
    target = Path(path)
    if target.exists() and target.read_text() == text:
        return False
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    return True


def readme(overview: str, sidebar: str, name: str, wiki_links: bool = False) -> str:
    """The front page: the overview's text, then the sidebar as contents."""
    listed = re.sub(r"\.md\)", ")", sidebar) if wiki_links else sidebar
    return "\n".join([f"# {name}\n", *([overview.strip(), ""] if overview.strip() else []), "## Contents\n", listed]) + "\n"


def export_markdown(pages: DataFrame, folder: str, wiki_links: bool = False, full: bool = False) -> dict[str, list[str]]:
    """Write a project's pages below a folder that all machines see; only new and changed ones are written (all of them if full), and vanished ones removed.

    Tasks write drafts and the commit puts them in place, so a failed export leaves the last one. Returns page ids by action.
    """
    text = strip_md_links(F.col("content")) if wiki_links else F.col("content")
    return write_pages(pages.select("page_id", text.alias("content"), F.sha2(text, 256).alias("inputs")), folder, full)
