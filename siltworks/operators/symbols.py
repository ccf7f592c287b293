"""Symbols, calls, metrics and module roll-ups of source files.

Symbols come from declarative rules: a rule names a line pattern, a kind and how visibility shows. One engine walks a
file's lines with a language's rules; it runs in Arrow batches. Metrics are DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import INDEX_ROOTS, count_of, module_name

SCHEMA = "path string, ord long, name string, kind string, line long, end_line long, visibility string, params array<struct<name:string,type_hint:string>>, return_type string, doc_comment string, decorators array<string>, calls array<string>, fields array<string>"

# Words that a call pattern finds but that call nothing.
NOT_CALLS = (
    "if", "for", "while", "def", "class", "return", "import", "from", "with", "as", "try", "except", "raise", "yield", "print", "async", "await", "lambda", "not", "and", "or", "in", "is", "else", "elif", "pass", "break", "continue",
)
NOT_METHODS = (
    "if", "for", "while", "switch", "catch", "return", "new", "function", "else", "try", "throw", "typeof", "await",
)


@dataclass(frozen=True)
class Rule:
    """pattern has the group name; group vis, if it took part, makes the symbol public (or names its visibility)."""

    pattern: re.Pattern
    kind: str
    inside: str | None = None  # only while a line that opened such a scope was seen
    opens: str | None = None  # the scope that a match opens
    block: bool = True


def _rules(*rows: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(re.compile(p), k, **o) for p, k, o in rows)


_PUB = r"^\s*(?P<vis>pub(?:\([^)]*\))?\s+)?"
_EXPORT = r"^\s*(?P<vis>export\s+)?"
_JAVA = r"^\s*(?P<vis>public|private|protected)?\s*"
# Which lines declare what. The first rule that matches a line wins.
RULES = {
    "rust": _rules(
        (_PUB + r'(?:async\s+)?(?:unsafe\s+)?(?:extern(?:\s+"[^"]*")?\s+)?fn\s+(?P<name>\w+)', "function", {}),
        (_PUB + r"struct\s+(?P<name>\w+)", "struct", {}),
        (_PUB + r"enum\s+(?P<name>\w+)", "enum", {}),
        (_PUB + r"trait\s+(?P<name>\w+)", "trait", {}),
        (_PUB + r"(?:const|static)\s+(?P<name>\w+)", "constant", {"block": False}),
        (_PUB + r"type\s+(?P<name>\w+)", "type_alias", {"block": False}),
        (r"macro_rules!\s*(?P<name>\w+)", "macro", {}),
    ),
    "typescript": _rules(
        (_EXPORT + r"(?:async\s+)?function\s+(?P<name>\w+)", "function", {}),
        (_EXPORT + r"(?:abstract\s+)?class\s+(?P<name>\w+)", "class", {"opens": "class"}),
        (_EXPORT + r"interface\s+(?P<name>\w+)", "interface", {}),
        (_EXPORT + r"type\s+(?P<name>\w+)", "type_alias", {"block": False}),
        (_EXPORT + r"(?:const|let)\s+(?P<name>\w+)\s*(?::\s*\w+)?\s*=\s*(?:async\s+)?\(", "function", {}),
        (_EXPORT + r"(?:const|let)\s+(?P<name>\w+)\s*(?::\s*\w+)?\s*=\s*(?:async\s+)?\w+\s*=>", "function", {}),
        (r"^\s+(?P<vis>public|private|protected)?\s*(?:async\s+)?(?P<name>\w+)\s*\(", "method", {"inside": "class"}),
    ),
    "go": _rules(
        (r"^func\s+\((?P<self>\w+)\s+\*?(?P<owner>\w+)\)\s+(?P<name>\w+)\s*\(", "method", {}),
        (r"^func\s+(?P<name>\w+)\s*\(", "function", {}),
        (r"^type\s+(?P<name>\w+)\s+struct", "struct", {}),
        (r"^type\s+(?P<name>\w+)\s+interface", "interface", {}),
        (r"^type\s+(?P<name>\w+)\s+\w+", "type_alias", {"block": False}),
    ),
    "java": _rules(
        (_JAVA + r"(?:static\s+)?(?:abstract\s+)?(?:final\s+)?class\s+(?P<name>\w+)", "class", {"opens": "class"}),
        (_JAVA + r"interface\s+(?P<name>\w+)", "interface", {}),
        (_JAVA + r"enum\s+(?P<name>\w+)", "enum", {}),
        (r"^\s+(?P<vis>public|private|protected)?\s*(?:static\s+)?(?:final\s+)?[\w<>\[\], ]+\s+(?P<name>\w+)\s*\(", "method", {}),
        (r"^\s+(?P<vis>public|private|protected)?\s*(?:static\s+)?(?:final\s+)?\w+\s+(?P<name>\w+)\s*=", "constant", {"inside": "class", "block": False}),
    ),
}
RULES["tsx"] = RULES["jsx"] = RULES["javascript"] = RULES["typescript"]
_IMPL = re.compile(r"^\s*impl(?:<[^>]*>)?\s+\w+")
_CALL = re.compile(r"(\w+)\s*\(")
_PY_CLASS = re.compile(r"^(?P<indent>\s*)class\s+(?P<name>\w+)")
_PY_DEF = re.compile(r"^(?P<indent>\s*)(?:async\s+)?def\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)")
_PY_DECORATOR = re.compile(r"^(\s*)@(\w+)")
_PY_RETURN = re.compile(r"\)\s*->\s*(.+?)\s*:")


@dataclass
class Symbol:
    name: str
    kind: str
    line: int
    end_line: int
    visibility: str = "private"
    params: list = field(default_factory=list)
    return_type: str | None = None
    doc_comment: str | None = None
    decorators: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    fields: list = field(default_factory=list)


def split_lines(text: str) -> list[str]:
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def indented_end(rows: list[str], at: int, indent: int) -> int:
    """Number of the last line that belongs to the block opened at rows[at]."""
    end = at
    for i in range(at + 1, len(rows)):
        if rows[i].strip():
            if _indent(rows[i]) <= indent:
                break
            end = i
    return end + 1


def braced_end(rows: list[str], at: int) -> int:
    """Number of the line that closes the first brace opened at or after rows[at]; without one, that of the line itself."""
    depth, seen = 0, False
    for i in range(at, len(rows)):
        for sign in re.findall(r"[{}]", rows[i]):
            depth += 1 if sign == "{" else -1
            seen |= sign == "{"
            if seen and depth == 0:
                return i + 1
    return at + 1


def _typed(part: str, default: str = "=") -> tuple[str, str | None]:
    """Name and type of a parameter; the type ends at `default`."""
    name, colon, hint = part.partition(":")
    return (name.strip(), hint.partition(default)[0].strip()) if colon else (part.partition("=")[0].strip(), None)


def _docstring(rows: list[str], at: int) -> str | None:
    first = rows[at + 1].strip() if at + 1 < len(rows) else ""
    quote = first[:3]
    if quote not in ('"""', "'''"):
        return None
    if len(first) > 3 and first.endswith(quote):
        return first[3:-3].strip()
    held = [first[3:]] if first[3:] else []
    for row in map(str.strip, rows[at + 2 :]):
        if row.endswith(quote):
            held += [row[:-3]] if row[:-3] else []
            break
        held.append(row)
    return "\n".join(held).strip() or None


def _doc_above(rows: list[str], at: int) -> str | None:
    """The Rust doc comment that ends above rows[at]; blank lines between are skipped."""
    out = []
    for i in range(at - 1, -1, -1):
        row = rows[i].strip()
        if row.startswith(("///", "//!")):
            out.append(row.lstrip("/").lstrip("!").strip())
        elif row:
            break
    return "\n".join(reversed(out)) if out else None


FIELDS = {"rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:"), "go": re.compile(r"^\s+(\w+)\s+")}


def _struct_fields(language: str, rows: list[str], at: int) -> list[str]:
    """Names declared in the lines of a struct's body, up to its closing brace; in Rust also up to a line that isn't indented further."""
    out = []
    for i in range(at + 1, len(rows)):
        bare = rows[i].strip()
        if not bare:
            continue
        if bare.startswith("}") or language == "rust" and _indent(rows[i]) <= _indent(rows[at]):
            break
        if m := FIELDS[language].match(rows[i]):
            out.append(m[1])
    return out


def _self_fields(rows: list[str], start: int, end: int) -> list[str]:
    """Names assigned on self inside __init__, in order, once."""
    out: dict[str, None] = {}
    at = next((i for i in range(start, end) if re.match(r"^\s+def\s+__init__", rows[i])), None)
    if at is not None:
        for row in rows[at + 1 : indented_end(rows, at, _indent(rows[at]))]:
            out |= dict.fromkeys(re.findall(r"self\.(\w+)\s*=", row))
    return list(out)


def python_symbols(text: str) -> list[Symbol]:
    rows, out, pending, mark = split_lines(text), [], [], 0
    for i, row in enumerate(rows):
        if m := _PY_DECORATOR.match(row):
            pending.append(m[2])
            mark = len(m[1])
        elif (m := _PY_CLASS.match(row)) and (not m["indent"] or pending and len(m["indent"]) == mark):
            end = indented_end(rows, i, len(m["indent"]))
            out.append(Symbol(m["name"], "class", i + 1, end, doc_comment=_docstring(rows, i), decorators=pending, fields=_self_fields(rows, i + 1, end)))
            pending = []
        elif m := _PY_DEF.match(row):
            parts = [p.strip() for p in m["params"].split(",")]
            params = [_typed(p) for p in parts if p and p not in ("self", "cls") and not p.startswith("*")]
            back = _PY_RETURN.search(row)
            calls = [c for c in _CALL.findall(row) if c not in NOT_CALLS]
            out.append(Symbol(m["name"], "method" if m["indent"] else "function", i + 1, indented_end(rows, i, len(m["indent"])), params=params, return_type=back[1] if back else None, doc_comment=_docstring(rows, i), decorators=pending, calls=calls))
            pending = []
        elif row.strip() and not row.strip().startswith("#"):
            pending = []
    for s in out:
        s.visibility = "private" if s.name.startswith("_") and not s.name.startswith("__") else "public"
    return out


def _visibility(language: str, m: re.Match) -> str:
    mark = (m.groupdict().get("vis") or "").strip()
    if language == "go":
        return "public" if m["name"][0].isupper() else "private"
    if language == "rust":
        return "public" if mark else "private"
    if mark in ("public", "private", "protected"):
        return mark
    return "public" if mark or language == "java" or m.re.pattern.startswith(r"^\s+") else "private"


def braced_symbols(language: str, text: str) -> list[Symbol]:
    rows, out, scopes = split_lines(text), [], set()
    impl = None  # indent of the last impl line, while functions below are indented further
    for i, row in enumerate(rows):
        if language == "rust":
            if not row.strip() or row.strip().startswith(("//", "/*")):
                continue
            if _IMPL.match(row):
                impl = _indent(row)
                continue
        for rule in RULES[language]:
            m = rule.pattern.search(row)
            if not m or rule.inside and rule.inside not in scopes or rule.kind == "method" and m["name"] in NOT_METHODS:
                continue
            kind = rule.kind
            if language == "rust" and kind == "function":
                if impl is not None and _indent(row) > impl:
                    kind = "method"
                else:
                    impl = None
            inside = re.search(r"\(([^)]*)\)", row)  # for Go methods these are the receiver's
            parts = [p.strip() for p in inside[1].split(",")] if inside and kind in ("function", "method") else []
            if language in ("go", "java"):
                params = [(p.split()[-1], " ".join(p.split()[:-1]) or None) if language == "java" else (p.split()[0], " ".join(p.split()[1:]) or None) for p in parts if p]
            else:
                bare = [re.sub(r"^(?:mut )+" if language == "rust" else r"^(?:\.\.\.)+", "", p) for p in parts]
                params = [_typed(p, "\n") for p in bare if ":" in p or language != "rust" and p]  # no part holds a line end
            back = re.search(r"\)\s*->\s*(.+?)\s*\{", row) if language == "rust" else None
            out.append(Symbol(m["name"], kind, i + 1, braced_end(rows, i) if rule.block else i + 1, _visibility(language, m), params, back[1] if back else None))
            if language == "rust" and kind not in ("type_alias", "macro"):
                out[-1].doc_comment = _doc_above(rows, i)
            if language in FIELDS and kind == "struct":
                out[-1].fields = _struct_fields(language, rows, i)
            scopes |= {rule.opens} - {None}
            break
    return out


def symbols_of(language: str, text: str) -> list[Symbol]:
    if language == "python":
        return python_symbols(text)
    return braced_symbols(language, text) if language in RULES else []


def extract(files: DataFrame) -> DataFrame:
    """Symbol rows of files (path, language, content), numbered within each file. Null contents have none."""
    pairs = pa.list_(pa.struct([("name", pa.string()), ("type_hint", pa.string())]))
    names = pa.list_(pa.string())
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pairs, pa.string(), pa.string(), names, names, names]
    columns = ["path", "ord", "name", "kind", "line", "end_line", "visibility", "params", "return_type", "doc_comment", "decorators", "calls", "fields"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                for n, s in enumerate(symbols_of(lang, text or "")):
                    rows.append((path, n, s.name, s.kind, s.line, s.end_line, s.visibility, [{"name": a, "type_hint": b} for a, b in s.params], s.return_type, s.doc_comment, s.decorators, s.calls, s.fields))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=columns)

    return files.select("path", "language", "content").mapInArrow(run, SCHEMA)


# What raises complexity, by language.
_C_LIKE = ("if ", "else if ", "for ", "while ", "switch ", "case ", "&&", "||")
BRANCHES = {"python": ("if ", "elif ", "for ", "while ", "except ", "and ", "or "), "rust": ("if ", "else if ", "for ", "while ", "match ", "&&", "||"), "go": ("if ", "else if ", "for ", "switch ", "case ", "&&", "||"), "java": _C_LIKE} | dict.fromkeys(("typescript", "tsx", "javascript", "jsx"), (*_C_LIKE, "? "))
BLOCK_COMMENTS = ("rust", "go", "java", "typescript", "tsx", "javascript", "jsx")


def metrics(files: DataFrame) -> DataFrame:
    """path, language, code_lines, comment_lines, blank_lines, complexity.

    Lines are trimmed by one expression over the whole text, and each step stands in a projection of its own, so that
    Spark works it out once. Only texts that open a block comment are walked line by line.
    """
    bare = F.regexp_replace("content", r"(?dmU)^[^\S\n]+|[^\S\n]+$", "")
    rows = files.select("path", "language", F.when(F.col("content") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(bare, r"\n\z", ""), "\n", -1)).alias("_rows"))
    rows = rows.select("path", "language", F.size("_rows").cast("long").alias("_all"), F.array_remove("_rows", "").alias("_full"))
    rows = rows.select("*", F.size("_full").cast("long").alias("_n"), F.array_join("_full", "\n").alias("_body"))  # no keyword holds a line end

    def step(state: Column, x: Column) -> Column:
        opened, closed = x.startswith("/*"), x.contains("*/")
        comment = state["inside"] | x.startswith("//") | opened
        return F.struct((state["n"] + comment.cast("long")).alias("n"), F.when(state["inside"], ~closed).otherwise(opened & ~closed & ~x.startswith("//")).alias("inside"))

    blocks = F.aggregate("_full", F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("inside")), step)["n"]
    starting = lambda mark: F.regexp_count("_body", F.lit(f"(?dm)^{mark}")).cast("long")
    comment = F.when(F.col("language") == "python", starting("#")).when(F.col("language").isin(*BLOCK_COMMENTS), F.when(F.col("_body").contains("/*"), blocks).otherwise(starting("//"))).otherwise(F.lit(0).cast("long"))
    branches = F.lit(0).cast("long")
    for lang, words in BRANCHES.items():
        branches = F.when(F.col("language") == lang, sum((count_of(F.col("_body"), w) for w in words), F.lit(0).cast("long"))).otherwise(branches)
    out = rows.select("path", "language", "_n", (F.col("_all") - F.col("_n")).alias("blank_lines"), comment.alias("comment_lines"), (branches + 1).alias("complexity"))
    return out.select("path", "language", (F.col("_n") - F.col("comment_lines")).alias("code_lines"), "comment_lines", "blank_lines", "complexity")


def symbol_index(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """name and the paths of its occurrences, one for each, in the order of files (path, is_config, is_entrypoint) and place.

    Files come as scan.in_order() has them: configs, entry points, others, each by path. Without files, all are others.
    """
    rank = F.lit(2)
    if files is not None:
        symbols = symbols.join(files.select("path", "is_config", "is_entrypoint"), "path")
        rank = F.when(F.col("is_config"), 0).when(F.col("is_entrypoint"), 1).otherwise(2)
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "path", "ord")))
    return symbols.groupBy("name").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"), F.count("*").alias("n"))


def exports(symbols: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ord", "name")))
    return symbols.where("visibility = 'public'").groupBy("path").agg(F.transform(ordered, lambda x: x["name"]).alias("exports"))


def call_edges(symbols: DataFrame) -> DataFrame:
    """from_file, from_symbol, to_file, to_symbol: calls of names that other files define, each once."""
    calls = symbols.select(F.col("path").alias("from_file"), F.col("name").alias("from_symbol"), F.explode("calls").alias("to_symbol")).distinct()
    targets = symbols.select(F.col("path").alias("to_file"), F.col("name").alias("to_symbol")).distinct()
    return calls.join(targets, "to_symbol").where("from_file <> to_file").select("from_file", "from_symbol", "to_file", "to_symbol")


def module_rollup(metrics_rows: DataFrame, symbols: DataFrame, roots: tuple = INDEX_ROOTS) -> DataFrame:
    per_file = symbols.groupBy("path").agg(F.count("*").alias("n"))
    joined = metrics_rows.join(per_file, "path", "left").withColumn("module", module_name(F.col("path"), roots))
    return joined.groupBy("module").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.sum("complexity").alias("complexity"))


def ambiguous_names(symbols: DataFrame) -> DataFrame:
    """Names that several symbols bear; they get no links."""
    return symbols.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
