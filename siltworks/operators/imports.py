"""Imports: extraction by pattern, candidate paths, resolution by preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import INDEX_ROOTS, folder, module_name, normalize_path

# What counts as an import in each language, in order.
_SCRIPT = (r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]""", r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""")
PATTERNS = {
    "python": (r"(?m)^\s*import\s+([\w.]+)", r"(?m)^\s*from\s+([\w.]+)\s+import"),
    "javascript": _SCRIPT, "jsx": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT,
    "go": (r'"([^"]+)"',),
    "rust": (r"(?m)^\s*use\s+([\w:]+)", r"(?m)^\s*mod\s+(\w+)"),
    "java": (r"(?m)^\s*import\s+([\w.]+);",),
}
SCRIPT_ENDINGS = {"graph": ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs"), "index": ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")}


def extract(files: DataFrame) -> DataFrame:
    """path, language, ord, target: one row a match, all matches of a language's first pattern before those of the second."""
    found = F.array().cast("array<string>")
    for lang, patterns in PATTERNS.items():
        both = F.concat(*(F.regexp_extract_all("content", F.lit(p), 1) for p in patterns))
        found = F.when(F.col("language") == lang, both).otherwise(found)
    return files.where(F.col("language").isin(*PATTERNS)).select("path", "language", F.posexplode(found).alias("ord", "target"))


def _names(text: Column, renamed: bool = True) -> Column:
    """Comma-separated names, trimmed; of "a as b" the first unless renamed is off."""
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, " as .*", "") if renamed else x, r"(?U)^\s+|\s+$", "")
    return F.filter(F.transform(F.split(text, ","), bare), lambda x: x != "")


def _found(pattern: str, raw, target, symbols) -> Column:
    """struct(raw, target, symbols) of each match; raw, target and symbols get the array of whole matches' pieces by group number."""
    hits = F.regexp_extract_all("content", F.lit(pattern), 0)
    group = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(hits, lambda x: F.struct(raw(lambda i: group(x, i)).alias("raw"), target(lambda i: group(x, i)).alias("target"), symbols(lambda i: group(x, i)).alias("symbols")))


def extract_indexed(files: DataFrame) -> DataFrame:
    """The index's view of imports: path, language, ord, raw, target and the imported names as symbols.

    Its patterns differ from those of extract(): names are read, Rust's mod lines and Go's stray strings are not, and a
    single Go import counts only at the very start of a file. Input of resolve(..., "index").
    """
    none = lambda g: F.array().cast("array<string>")
    one, said = (lambda g: g(1)), lambda before, after="": lambda g: F.concat(F.lit(before), g(1), F.lit(after))
    braces = lambda g: F.when(g(1).contains("{"), _names(F.regexp_extract(g(1), r"(?s)\{([^}]*)", 1), renamed=False)).otherwise(none(g))
    script = F.concat(
        _found(r"""(?U)import\s+(?:\{([^}]*)\}|(\w+))\s+from\s+['"]([^'"]+)['"]""", lambda g: g(3), lambda g: g(3), lambda g: F.when(g(2) != "", F.array(g(2))).otherwise(_names(g(1)))),
        _found(_SCRIPT[1], one, one, none),
    )
    quoted = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"(?s)import\s*\((.*?)\)"), 1), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), 1)))
    by_language = {
        "python": F.concat(_found(r"(?dmU)^\s*import\s+([\w.]+)", said("import "), one, none), _found(r"(?dmU)^\s*from\s+([\w.]+)\s+import\s+(.+)", said("from ", " import ..."), one, lambda g: _names(g(2)))),
        "rust": _found(r"(?dmU)^\s*use\s+([\w:]+(?:\s*\{[^}]*\})?)", one, lambda g: F.trim(F.split(g(1), r"\{")[0]), braces),
        "go": F.concat(_found(r'\A\s*import\s+"([^"]+)', one, one, none), F.transform(quoted, lambda x: F.struct(x.alias("raw"), x.alias("target"), F.array().cast("array<string>").alias("symbols")))),
        "java": _found(r"(?dmU)^\s*import\s+(?:static\s+)?([\w.]+);", one, one, none),
    } | dict.fromkeys(("javascript", "jsx", "typescript", "tsx"), script)
    found = F.array().cast("array<struct<raw:string,target:string,symbols:array<string>>>")
    for lang, hits in by_language.items():
        found = F.when(F.col("language") == lang, hits).otherwise(found)
    rows = files.where(F.col("language").isin(*by_language)).select("path", "language", F.posexplode(found).alias("ord", "_i"))
    return rows.select("path", "language", "ord", "_i.raw", "_i.target", "_i.symbols")


def _python_module(target: Column, path: Column) -> Column:
    """A module's path; leading dots start from the importing file's folder and climb with each further dot."""
    dots = F.length(F.regexp_extract(target, r"^\.*", 0))
    module = F.replace(F.regexp_replace(target, r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.when(path.contains("/"), F.split(folder(path), "/")).otherwise(F.array().cast("array<string>"))
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0)))
    return F.when(dots == 0, module).otherwise(F.array_join(F.concat(base, F.when(module == "", F.array().cast("array<string>")).otherwise(F.array(module))), "/"))


def candidates(imports: DataFrame, flavour: str = "graph") -> DataFrame:
    """Adds candidate and pref: the paths an import may mean, best first."""
    target, path, lang = F.col("target"), F.col("path"), F.col("language")
    py = _python_module(target, path)
    python = F.concat(F.array(F.concat(py, F.lit(".py")), F.concat(py, F.lit("/__init__.py"))), F.when(py.startswith("src/"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src/"), py, F.lit(".py")), F.concat(F.lit("src/"), py, F.lit("/__init__.py")))))
    js = F.when(target.startswith("."), normalize_path(F.concat(folder(path), F.lit("/"), target))).otherwise(target)
    script = F.array(*(F.concat(js, F.lit(e)) for e in SCRIPT_ENDINGS[flavour]))
    go = F.split(target, "/")
    last_two = F.when(F.size(go) >= 2, F.array(F.concat(F.get(go, F.size(go) - 2), F.lit("/"), F.get(go, F.size(go) - 1), F.lit(".go"))))
    crate = F.split(target, "::")[0]
    rust = F.array(F.concat(F.lit("src/"), crate, F.lit(".rs")), F.concat(F.lit("src/"), crate, F.lit("/mod.rs")), F.concat(crate, F.lit(".rs")))
    dotted = F.replace(target, F.lit("."), F.lit("/"))
    java = F.array(F.concat(F.lit("src/main/java/"), dotted, F.lit(".java")), F.concat(dotted, F.lit(".java")))
    options = F.when(lang == "python", python).when(lang == "go", last_two).when(lang == "rust", rust).when(lang == "java", java).otherwise(script)
    rows = imports.select("*", F.posexplode(options).alias("pref", "candidate"))
    return rows.withColumn("candidate", normalize_path(F.replace("candidate", F.lit("\\"), F.lit("/"))))


def resolve(imports: DataFrame, files: DataFrame, flavour: str = "graph") -> DataFrame:
    """imports with resolved: the first candidate that is a known path, else null. Keys: path, ord."""
    known = files.select(F.col("path").alias("candidate")).distinct()
    best = candidates(imports, flavour).join(known, "candidate").groupBy("path", "ord").agg(F.min_by("candidate", "pref").alias("resolved"))
    return imports.join(best, ["path", "ord"], "left")


def edges(resolved: DataFrame) -> DataFrame:
    """src, dst of resolved imports between different files, repeated ones kept."""
    return resolved.where("resolved is not null and resolved <> path").select(F.col("path").alias("src"), F.col("resolved").alias("dst"))


def module_links(resolved: DataFrame, roots: tuple = INDEX_ROOTS) -> tuple[DataFrame, DataFrame]:
    """(module, src, dst of resolved imports within a module, repeated ones and those of a file itself kept; distinct module, dependency between modules)."""
    pairs = resolved.where("resolved is not null").select(module_name(F.col("path"), roots).alias("module"), module_name(F.col("resolved"), roots).alias("dependency"), F.col("path").alias("src"), F.col("resolved").alias("dst"))
    inside = pairs.where("module = dependency").select("module", "src", "dst")
    return inside, pairs.where("module <> dependency").select("module", "dependency").distinct()
