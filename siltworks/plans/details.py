"""Registered queries that meet the finer rules: reasons, languages, symbols and imports by language, pages, passes.

Their inputs are made from whole tables by a rule, one file a row, and their SQL states what must come out of that rule.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions import columns as C
from siltworks.operators import cache, docs, graph, imports, incremental, passes, ranges, retrieval, scan, symbols, wiki
from siltworks.plans import oracles
from siltworks.project import Project
from siltworks.sources import project as helpers
from siltworks.sources import views as V
from siltworks.sources.buckets import BucketTable
from siltworks.streaming import expiry, reindex

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def _by_rule(key: str, choices: list) -> F.Column:
    """The choice that a row's key picks, each in turn."""
    return F.element_at(F.array(*(c if not isinstance(c, str) else F.lit(c) for c in choices)), (F.pmod(F.col(key), F.lit(len(choices))) + 1).cast("int"))


def _texts(spark: SparkSession, d: str, pattern: str, language: str, path: str = "f{}") -> DataFrame:
    """One file a supplier: pattern and path with {} for its key."""
    k = F.col("s_suppkey").cast("string")
    fill = lambda s: F.concat_ws("", *(x for i, part in enumerate(s.split("{}")) for x in ([k] if i else []) + [F.lit(part)]))
    return V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), fill(path).alias("path"), F.lit(language).alias("language"), fill(pattern).alias("content"))


# ---- scanning ------------------------------------------------------------------------------------------------------
_NAMES = ["node_modules/a{}.js", "x/.git/c{}", "pkg{}.egg-info/y.py", "a/.env", "a/.env.example", "b/id_rsa", "p{}.png", "q{}.min.js", "r{}.tar.gz", "z{}.bin.py", "s{}.js", "t{}.css", "u{}.py", "v{}.lock", "w/.env.{}", "m{}.JS"]
_REASONS = ["skipped", "skipped", "skipped", "sensitive", None, "sensitive", "suffix", "suffix", "suffix", "binary", "minified", "minified", None, "suffix", "sensitive", None]
_SQL_REASONS = "[" + ", ".join("NULL" if r is None else f"'{r}'" for r in _REASONS) + f"][doc_id % {len(_REASONS)} + 1]"


def _named(spark, d):
    key = F.col("doc_id").cast("string")
    names = [F.replace(F.lit(n), F.lit("{}"), key) for n in _NAMES]
    i = F.pmod("doc_id", F.lit(len(_NAMES)))
    text = F.when(i == 9, F.concat(F.lit("a = 1\0"), key)).when(i.isin(10, 11), F.repeat(F.lit("y"), 1500)).when(i == 15, F.concat_ws("\n", *[F.lit("a = 1")] * 8)).otherwise(F.lit("a = 1\n"))
    return V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), key, F.lit("/"), _by_rule("doc_id", names)).alias("path"), text.alias("content")).withColumn("size", F.octet_length("content").cast("long"))


@query(f"SELECT doc_id, {_SQL_REASONS} AS reason FROM documents")
def scan_reasons(spark, d):
    """Skipped folders, sensitive names, endings, NUL bytes and long lines, each with its own reason."""
    return scan.with_reason(_named(spark, d)).select("doc_id", "reason")


_COUNTED = f"counted AS (SELECT {_SQL_REASONS} AS reason FROM documents), report AS (SELECT count(*) FILTER (reason IS NULL OR reason IN ('binary', 'minified')) AS candidates, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason = 'binary') AS n_bin, count(*) FILTER (reason = 'minified') AS n_min FROM counted)"


@query(f"WITH {_COUNTED} SELECT candidates, kept, 0::BIGINT AS oversized_count, n_bin AS binary_count, n_min AS minified_count, 0::BIGINT AS priority_dropped, '' AS oversized FROM report")
def scan_counts(spark, d):
    return scan.report(scan.with_reason(_named(spark, d)))


@query(f"WITH {_COUNTED} SELECT kept || ' of ' || candidates || ' files' || CASE WHEN n_bin + n_min > 0 THEN '; skipped: ' || concat_ws(', ', CASE WHEN n_bin > 0 THEN n_bin || ' binary' END, CASE WHEN n_min > 0 THEN n_min || ' minified/generated' END) ELSE '' END AS line FROM report")
def coverage_line(spark, d):
    return scan_counts(spark, d).select(passes.coverage_line().alias("line"))


_ENDINGS = [*scan.LANGUAGES, ".none", ""]
_LANGS = [*scan.LANGUAGES.values(), "unknown", "unknown"]


@query(f"SELECT doc_id, [{', '.join(repr(x) for x in _LANGS)}][doc_id % {len(_LANGS)} + 1] AS language FROM documents")
def languages(spark, d):
    return V.table(spark, d, "documents").select("doc_id", scan.language(F.concat(F.lit("a/b"), _by_rule("doc_id", _ENDINGS))).alias("language"))


_FILES = [*scan.CONFIG_FILES, *scan.ENTRYPOINT_NAMES, *(f"{x}/tool" for x in scan.ENTRYPOINT_DIRS), "plain.py", "lib/x.go"]
_FLAG = [1] * len(scan.CONFIG_FILES) + [2] * (len(scan.ENTRYPOINT_NAMES) + len(scan.ENTRYPOINT_DIRS)) + [0, 0]
_SQL_FLAG = f"{_FLAG}[doc_id % {len(_FLAG)} + 1]"
_SQL_NAME = f"'d' || doc_id || '/' || [{', '.join(repr(x) for x in _FILES)}][doc_id % {len(_FILES)} + 1]"


def _flagged(spark, d):
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), _by_rule("doc_id", _FILES))
    return V.table(spark, d, "documents").select("doc_id", path.alias("path"), F.col("text").alias("content"))


@query(f"SELECT doc_id, {_SQL_FLAG} = 1 AS is_config, {_SQL_FLAG} = 2 AS is_entrypoint, sha256(CASE WHEN {_SQL_FLAG} > 0 THEN text ELSE array_to_string(string_split(text, chr(10))[1:2], chr(10)) END) AS preview_sha256 FROM documents WHERE text NOT LIKE '%' || chr(13) || '%'")
def file_flags(spark, d):
    """Config and entry point flags; such files are previewed whole."""
    found = scan.described(_flagged(spark, d)).where(~F.col("content").contains("\r"))
    return found.select("doc_id", "is_config", "is_entrypoint", F.sha2("preview", 256).alias("preview_sha256"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY [3, 1, 2][{_SQL_FLAG} + 1], {_SQL_NAME}) - 1 AS ord FROM documents")
def file_order(spark, d):
    return scan.in_order(_flagged(spark, d)).select("doc_id", "ord")


_TREE = "entries AS (SELECT source || '/' || lang || '/doc_' || doc_id || ['.py', '.rs', '.ts', '.go', '.java', '.md', '.txt'][doc_id % 7 + 1] AS entry FROM documents UNION SELECT source || '/' FROM documents UNION SELECT source || '/' || lang || '/' FROM documents)"


@query(f"WITH {_TREE}, top AS (SELECT * FROM entries ORDER BY entry LIMIT 150) SELECT string_agg(repeat('  ', len(string_split(rtrim(entry, '/'), '/')) - 1) || string_split(rtrim(entry, '/'), '/')[-1] || CASE WHEN entry LIKE '%/' THEN '/' ELSE '' END, chr(10) ORDER BY entry) || (SELECT CASE WHEN count(*) > 150 THEN chr(10) || '  ... and ' || (count(*) - 150) || ' more entries' ELSE '' END FROM entries) AS text FROM top")
def tree_text(spark, d):
    return scan.tree_text(V.files_documents(spark, d), 150)


@query("SELECT 'p' || s_suppkey || '.py' AS path, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 3 <> 0 ELSE s_suppkey % 5 = 0 END AS ignored FROM supplier")
def ignore_marks(spark, d):
    """Negations with a blank behind the mark, back slashes for slashes, rules by key."""
    k = F.col("s_suppkey")
    folder = F.when(k % 2 == 0, F.when(k % 3 == 0, "keep/x/").otherwise("drop/x/")).otherwise(F.when(k % 5 == 0, "keep/y/").otherwise("other/"))
    rules = scan.parse_ignore("# x\n\n*/x/*\n! keep/x\nkeep\\y\n!  nothing \n")
    rows = V.table(spark, d, "supplier").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".py")).alias("path"), F.concat(folder, F.lit("z.py")).alias("at"))
    return rows.select("path", scan.ignored(F.col("at"), rules).alias("ignored"))


# ---- chunks with blank lines ---------------------------------------------------------------------------------------
@query(
    """SELECT path, chunk::BIGINT AS chunk, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM (SELECT 'f' || s_suppkey AS path, unnest([0, 1, 2, 3]) AS chunk, unnest([1, 9, 39, 69]) AS line_start, unnest([8, 38, 68, 74]) AS line_end FROM supplier)"""
)
def chunks_blank(spark, d):
    """A blank line ends a chunk of five lines or more, not a shorter one; else 30 lines do; a chunk of blanks is left out."""
    text = "a{}\nb\n\n" + "c{}\n" * 4 + "\n" + "d\n" * 30 + "e{}\n" * 30 + "f\n" * 5 + "\n" + " \n" * 7
    return retrieval.chunks(_texts(spark, d, text, "text")).select("path", "chunk", "line_start", "line_end")


# ---- symbols and imports by language -------------------------------------------------------------------------------
def _symbol_sql(rows: list[tuple]) -> str:
    """Expected rows (name, kind, line, end, visibility, params, return type, doc, decorators, calls, fields); {} is the key."""
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''").replace("{}", "' || s_suppkey || '") + "'"
    each = (f"SELECT 'f' || s_suppkey AS path, {i}::BIGINT AS ord, {text(r[0])} AS name, '{r[1]}' AS kind, {r[2]}::BIGINT AS line, {r[3]}::BIGINT AS end_line, '{r[4]}' AS visibility, {text(r[5])} AS params, {text(r[6])} AS return_type, {text(r[7])} AS doc_comment, {text(r[8])} AS decorators, {text(r[9])} AS calls, {text(r[10])} AS fields FROM supplier" for i, r in enumerate(rows))
    return " UNION ALL ".join(each)


def _symbols(files: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",").alias(c)
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["type_hint"], F.lit("-")))), ",").alias("params")
    return symbols.extract(files).select("path", "ord", "name", "kind", "line", "end_line", "visibility", params, "return_type", "doc_comment", joined("decorators"), joined("calls"), joined("fields"))


_PYTHON = '@wrap\n@cached(5)\ndef load_{}(path: str, deep=False, *rest) -> list:\n    """Reads {}.\n    Twice.\n    """\n    return path\n\nclass Store{}(Base):\n    """Keeps {}."""\n    def __init__(self, size: int = 3):\n        self.size = size\n        self.seen = []\n        self.size = 4\n\n    @property\n    def _hidden(self):\n        return 1\n\nasync def go_{}(cls, a, b=make()):\n    pass\n'


@query(_symbol_sql([
    ("load_{}", "function", 3, 7, "public", "path:str,deep:-", "list", "Reads {}.\nTwice.", "wrap,cached", "load_{}", ""), ("Store{}", "class", 9, 18, "public", "", None, "Keeps {}.", "", "", "size,seen"),
    ("__init__", "method", 11, 14, "public", "size:int", None, None, "", "__init__", ""), ("_hidden", "method", 17, 18, "private", "", None, None, "property", "_hidden", ""), ("go_{}", "function", 20, 21, "public", "a:-,b:-", None, None, "", "go_{},make", ""),
]))
def symbols_python(spark, d):
    return _symbols(_texts(spark, d, _PYTHON, "python"))


_RUST = "/// A box.\n/// Holds {}.\npub struct Box{} {\n    pub width: i32,\n    height{}: Vec<u8>,\n}\n\nimpl Box{} {\n    /// Makes one.\n    pub fn make_{}(mut w: i32, h: &str) -> Self {\n        Box { }\n    }\n    fn inner(&self) {\n    }\n}\n\npub(crate) async fn free_{}(a: u8) -> Result<u8, E> {\n    a\n}\nenum Kind{} {\n    A,\n}\npub trait Draw{} {\n}\nstatic LIMIT{}: u8 = 1;\npub type Id{} = u64;\nmacro_rules! twice_{} {\n}\n"


@query(_symbol_sql([
    ("Box{}", "struct", 3, 6, "public", "", None, "A box.\nHolds {}.", "", "", "width,height{}"), ("make_{}", "method", 10, 12, "public", "w:i32,h:&str", "Self", "Makes one.", "", "", ""), ("inner", "method", 13, 14, "private", "", None, None, "", "", ""),
    ("free_{}", "function", 17, 19, "public", "", "Result<u8, E>", None, "", "", ""), ("Kind{}", "enum", 20, 22, "private", "", None, None, "", "", ""), ("Draw{}", "trait", 23, 24, "public", "", None, None, "", "", ""),
    ("LIMIT{}", "constant", 25, 25, "private", "", None, None, "", "", ""), ("Id{}", "type_alias", 26, 26, "public", "", None, None, "", "", ""), ("twice_{}", "macro", 27, 28, "private", "", None, None, "", "", ""),
]))
def symbols_rust(spark, d):
    return _symbols(_texts(spark, d, _RUST, "rust"))


_SCRIPT = "export abstract class Page{} {\n  private fill(a: number = 3, ...b) {\n  }\n  render_{}(x: string) {\n    if (x) {\n    }\n  }\n}\nexport async function load_{}(url: string) {\n}\nexport const add_{} = (a: number) => a\nlet twice_{} = x => x\nexport interface Shape{} {\n}\nexport type Id{} = string\n"


@query(_symbol_sql([
    ("Page{}", "class", 1, 8, "public", "", None, None, "", "", ""), ("fill", "method", 2, 3, "private", "a:number = 3,b:-", None, None, "", "", ""), ("render_{}", "method", 4, 7, "public", "x:string", None, None, "", "", ""),
    ("load_{}", "function", 9, 10, "public", "url:string", None, None, "", "", ""), ("add_{}", "function", 11, 14, "public", "a:number", None, None, "", "", ""), ("twice_{}", "function", 12, 14, "private", "", None, None, "", "", ""),
    ("Shape{}", "interface", 13, 14, "public", "", None, None, "", "", ""), ("Id{}", "type_alias", 15, 15, "public", "", None, None, "", "", ""),
]))
def symbols_typescript(spark, d):
    return _symbols(_texts(spark, d, _SCRIPT, "typescript"))


_GO = "package x\n\nfunc Open{}(a int, b string) error {\n}\nfunc (b *Box) fill_{}(n int) {\n}\ntype Box{} struct {\n\twidth int\n\theight{} int\n}\ntype shape{} interface {\n}\ntype Id{} string\n"


@query(_symbol_sql([
    ("Open{}", "function", 3, 4, "public", "a:int,b:string", None, None, "", "", ""), ("fill_{}", "method", 5, 6, "private", "b:*Box", None, None, "", "", ""), ("Box{}", "struct", 7, 10, "public", "", None, None, "", "", "width,height{}"),
    ("shape{}", "interface", 11, 12, "private", "", None, None, "", "", ""), ("Id{}", "type_alias", 13, 13, "public", "", None, None, "", "", ""),
]))
def symbols_go(spark, d):
    return _symbols(_texts(spark, d, _GO, "go"))


_JAVA = "public class Box{} {\n    private int size{} = 3;\n    public int fill_{}(int a, String b) {\n        return a;\n    }\n    protected static void drain() {\n    }\n}\ninterface Shape{} {\n}\npublic enum Kind{} {\n}\n"


@query(_symbol_sql([
    ("Box{}", "class", 1, 8, "public", "", None, None, "", "", ""), ("size{}", "constant", 2, 2, "private", "", None, None, "", "", ""), ("fill_{}", "method", 3, 5, "public", "a:int,b:String", None, None, "", "", ""),
    ("drain", "method", 6, 7, "protected", "", None, None, "", "", ""), ("Shape{}", "interface", 9, 10, "public", "", None, None, "", "", ""), ("Kind{}", "enum", 11, 12, "public", "", None, None, "", "", ""),
]))
def symbols_java(spark, d):
    return _symbols(_texts(spark, d, _JAVA, "java"))


#: language, its path, a text, the graph's view (target, path it means), the index's view (target, names).
_IMPORTS = (
    ("typescript", "web/s{}/a.ts", 'import { one as two, three } from "./b"\nimport D from "../lib/d"\nconst z = require("pkg{}")\n', [("./b", "web/s{}/b.ts"), ("../lib/d", "web/lib/d/index.ts"), ("pkg{}", None)], [("./b", "one,three"), ("../lib/d", "D"), ("pkg{}", "")]),
    ("rust", "src/s{}.rs", "use util{}::deep::{a, b};\nuse std::io;\nmod part{};\n", [("util{}::deep::", "src/util{}.rs"), ("std::io", None), ("part{}", "src/part{}/mod.rs")], [("util{}::deep::", "a,b"), ("std::io", "")]),
    ("go", "cmd{}.go", 'import "host/x/util{}"\nimport (\n\t"fmt"\n\t"host/y{}/tool"\n)\nvar s = "no"\n', [("host/x/util{}", "x/util{}.go"), ("fmt", None), ("host/y{}/tool", "y{}/tool.go"), ("no", None)], [("host/x/util{}", ""), ("fmt", ""), ("host/y{}/tool", "")]),
    ("java", "A{}.java", "import p{}.B;\nimport static q.C;\n", [("p{}.B", "src/main/java/p{}/B.java")], [("p{}.B", ""), ("q.C", "")]),
    ("python", "src/n/s{}.py", "from .near{} import f as g, h\nimport top{}.mod\nfrom ..up import *\n", [("top{}.mod", "src/top{}/mod.py"), (".near{}", "src/n/near{}.py"), ("..up", "src/up/__init__.py")], [("top{}.mod", ""), (".near{}", "f,h"), ("..up", "*")]),
)


def _import_files(spark, d) -> DataFrame:
    files = None
    for language, path, text, graph_view, _ in _IMPORTS:
        some = _texts(spark, d, text, language, path)
        for _, meant in graph_view:
            if meant is not None:
                some = some.unionByName(_texts(spark, d, "", language, meant))
        files = some if files is None else files.unionByName(some)
    return files.select("path", "language", "content").distinct()


def _import_sql(view: int) -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("{}", "' || s_suppkey || '") + "'"
    last = "resolved" if view == 3 else "symbols"
    return " UNION ALL ".join(f"SELECT {text(row[1])} AS path, {i}::BIGINT AS ord, {text(a)} AS target, {text(b)} AS {last} FROM supplier" for row in _IMPORTS for i, (a, b) in enumerate(row[view]))


@query(_import_sql(3))
def imports_by_language(spark, d):
    files = _import_files(spark, d)
    return imports.resolve(imports.extract(files), files).select("path", F.col("ord").cast("long").alias("ord"), "target", "resolved")


@query(_import_sql(4))
def imports_indexed_by_language(spark, d):
    found = imports.extract_indexed(_import_files(spark, d))
    return found.select("path", F.col("ord").cast("long").alias("ord"), "target", F.array_join("symbols", ",").alias("symbols"))


@query(
    "SELECT 'shared' || s_suppkey % 5 AS name, string_agg(path, ',' ORDER BY r, path) AS paths, count(*) AS n FROM (SELECT s_suppkey, s_suppkey % 3 AS i, [1, 2, 0][s_suppkey % 3 + 1] AS r, 'd' || s_suppkey || '/' || ['main.py', 'x.py', 'config.py'][s_suppkey % 3 + 1] AS path FROM supplier) GROUP BY 1"
)
def symbol_index_in_order(spark, d):
    """A name's paths come in the order of the files: configs, entry points, others."""
    k = F.col("s_suppkey").cast("string")
    path = F.concat(F.lit("d"), k, F.lit("/"), _by_rule("s_suppkey", ["main.py", "x.py", "config.py"]))
    text = F.concat(F.lit("def shared"), (F.col("s_suppkey") % 5).cast("string"), F.lit("(a):\n    return a\n"))
    files = scan.described(V.table(spark, d, "supplier").select(path.alias("path"), F.lit("python").alias("language"), text.alias("content")))
    return symbols.symbol_index(symbols.extract(files), files).select("name", F.array_join("paths", ",").alias("paths"), "n")


# ---- pages ---------------------------------------------------------------------------------------------------------
def _answers(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select("key", F.from_json("json", schema).alias("d"))


def _sizes(spark, d) -> DataFrame:
    return V.table(spark, d, "supplier").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("module")).agg(F.count("*").alias("files"))


_MOD = "mod AS (SELECT s_nationkey AS n, count(*) AS files FROM supplier GROUP BY s_nationkey)"
_MODULE_JSON = """{"name": "Mod NN", "purpose": "Rules NN", "description": "Text NN", "files": [{"path": "a.py", "purpose": "start", "key_symbols": [{"name": "run", "kind": "function", "line": 1, "description": "runs"}, {"name": "stop", "kind": "function"}]}], "relationships": [{"source": "a", "target": "b", "description": "calls"}], "key_concepts": [{"name": "c", "explanation": "why"}]}"""
_MODULE_TEXT = "# Mod NN\n\n> Rules NN\n\nText NN\n\n## Files\n### `a.py`\nstart\n- `run` (function) - runs\n- `stop` (function)\n\n## Key Concepts\n- **c**: why\n\n## Internal Relationships\n- `a` → `b`: calls"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("NN", "' || n || '") + "'"


@query(f"WITH {_MOD} SELECT 'modules/n' || n AS page_id, CASE WHEN n % 2 = 0 THEN {_lit(_MODULE_TEXT)} ELSE '# n' || n || chr(10) || chr(10) || '> Module containing ' || files || ' files' END AS content FROM mod")
def module_pages(spark, d):
    """Modules with an even number have an answer, others show the default."""
    n = F.regexp_extract("module", r"\d+", 0)
    answers = _sizes(spark, d).where(n.cast("int") % 2 == 0).select(F.col("module").alias("key"), F.replace(F.lit(_MODULE_JSON), F.lit("NN"), n).alias("json"))
    return passes.module_pages(_answers(answers, passes.MODULE), _sizes(spark, d))


_ARCHITECTURE = '{"architecture_type": "layered", "description": "Two layers.", "components": [{"name": "n1", "purpose": "rules"}, {"name": "web"}], "mermaid_component": "graph TD", "data_flow": "down"}'


@query(f"SELECT 'architecture' AS page_id, '# Architecture' || chr(10) || 'layered' || chr(10) || chr(10) || 'Two layers.' || chr(10) || chr(10) || '## Components' || chr(10) || '- ' || CASE WHEN EXISTS (FROM supplier WHERE s_nationkey = 1) THEN '[n1](modules/n1.md)' ELSE 'n1' END || ': rules' || chr(10) || '- web' || chr(10) || chr(10) || '## Diagram' || chr(10) || '```mermaid' || chr(10) || 'graph TD' || chr(10) || '```' || chr(10) || chr(10) || '## Data Flow' || chr(10) || 'down' AS content")
def architecture_page(spark, d):
    answer = _answers(spark.createDataFrame([("architecture", _ARCHITECTURE)], "key string, json string"), passes.ARCHITECTURE).select("d")
    return passes.architecture_page(answer, _sizes(spark, d))


_OVERVIEW = '{"name": "Demo", "one_liner": "Small.", "description": "Long.", "tech_stack": [{"name": "Python", "version": "3", "category": "language"}, {"name": "Go"}], "setup_instructions": ["get", "run"], "key_features": ["fast"]}'


@query(f"WITH {_COUNTED} SELECT 'index' AS page_id, '# Demo' || chr(10) || chr(10) || '> Small.' || chr(10) || chr(10) || 'Long.' || chr(10) || chr(10) || '> Partial coverage: ' || kept || ' of ' || candidates || ' files; skipped: ' || n_bin || ' binary, ' || n_min || ' minified/generated.' || chr(10) || chr(10) || '## Tech Stack' || chr(10) || '- **Python** 3 (language)' || chr(10) || '- **Go**' || chr(10) || chr(10) || '## Key Features' || chr(10) || '- fast' || chr(10) || chr(10) || '## Getting Started' || chr(10) || '1. get' || chr(10) || '2. run' AS content FROM report")
def overview_page(spark, d):
    answer = _answers(spark.createDataFrame([("overview", _OVERVIEW)], "key string, json string"), passes.OVERVIEW).select("d")
    return passes.overview_page(answer, scan_counts(spark, d), "unnamed")


_GUIDE = '{"introduction": "NN files.", "steps": [{"order": 1, "title": "Main", "files": ["a.py", "b.py"], "explanation": "It runs.", "time_estimate": "5 min"}, {"title": "Rest"}], "tips": ["slowly"]}'


@query("SELECT 'reading-guide' AS page_id, '# Reading Guide' || chr(10) || chr(10) || count(*) || ' files.' || chr(10) || chr(10) || '## Steps' || chr(10) || '1. **Main** (5 min)' || chr(10) || '   It runs.' || chr(10) || '   `a.py`, `b.py`' || chr(10) || '2. **Rest**' || chr(10) || chr(10) || '## Tips' || chr(10) || '- slowly' AS content FROM supplier")
def guide_page(spark, d):
    n = V.table(spark, d, "supplier").agg(F.count("*").cast("string").alias("n"))
    rows = n.select(F.explode(F.array(F.struct(F.lit("guide").alias("key"), F.replace(F.lit(_GUIDE), F.lit("NN"), F.col("n")).alias("json")), F.struct(F.lit("none").alias("key"), F.lit('{"steps": []}').alias("json")))).alias("r")).select("r.*")
    return passes.guide_page(_answers(rows, passes.GUIDE).select("d"))


@query("WITH s AS (SELECT 'kind' || s_suppkey % 3 AS kind, 'n' || s_nationkey AS module, 'Name' || s_suppkey AS name, s_suppkey AS k FROM supplier), m AS (SELECT kind, module, '### ' || module || chr(10) || string_agg('- `' || name || '`' || CASE WHEN k % 2 = 0 THEN ': about ' || k ELSE '' END, chr(10) ORDER BY k) AS t, count(*) AS n FROM s GROUP BY kind, module), ks AS (SELECT kind, '## ' || kind || chr(10) || string_agg(t, chr(10) ORDER BY module) AS t, sum(n) AS n FROM m GROUP BY kind) SELECT '# Symbols' || chr(10) || sum(n)::BIGINT || ' symbols' || chr(10) || string_agg(t, chr(10) ORDER BY kind) AS content FROM ks")
def symbol_page(spark, d):
    k = F.col("s_suppkey")
    about = F.when(k % 2 == 0, F.concat(F.lit("about "), k.cast("string")))
    rows = V.table(spark, d, "supplier").select(F.concat(F.lit("kind"), (k % 3).cast("string")).alias("kind"), F.concat(F.lit("n"), "s_nationkey").alias("module"), k.alias("ord"), F.concat(F.lit("Name"), k.cast("string")).alias("name"), about.alias("description"))
    return docs.symbol_page(rows)


@query(f"WITH {oracles._SYN}, f AS (SELECT path, 'n' || n AS module FROM paths), s AS (SELECT f.module, f.path, ord, name, row_number() OVER (PARTITION BY f.module ORDER BY f.path, ord) AS place FROM sym JOIN f USING (path)) SELECT f.module, count(*) AS files, '- ' || f.module || ' (' || count(*) || ' files, ' || any_value((SELECT count(*) FROM s WHERE s.module = f.module)) || ' symbols) \u2014 ' || any_value((SELECT string_agg(name, ', ' ORDER BY place) FROM s WHERE s.module = f.module AND place <= 5)) || chr(10) || '  Files: ' || string_agg(path, ', ' ORDER BY path) AS line FROM f GROUP BY f.module")
def module_summary(spark, d):
    files = V.files_synth(spark, d).withColumn("language", scan.language(F.col("path")))
    return passes.module_summary(files.select("path", C.module_name(F.col("path"), C.INDEX_ROOTS).alias("module")), symbols.extract(files))


# ---- passes, cache, tables -----------------------------------------------------------------------------------------
@query("SELECT item_id::VARCHAR AS key, CASE WHEN item_id % 3 = 0 THEN '{\"cached\": ' || item_id || '}' WHEN item_id % 3 = 1 THEN '{\"asked\": ' || length(text) || '}' END AS json, item_id % 3 = 1 AS cached_now FROM benchmark")
def pass_with_cache(spark, d):
    """A third of the prompts is in the cache, a third is answered, a third gets no JSON and is not cached."""
    prompts = V.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("key"), "text", "item_id")
    asked = prompts.select("key", F.concat(F.col("item_id").cast("string"), F.lit("|"), "text").alias("prompt"), "item_id")
    known = asked.where("item_id % 3 = 0").select(F.concat("key", F.lit(":"), C.content_hash(F.col("prompt"))).alias("key"), F.concat(F.lit('{"cached": '), F.col("item_id").cast("string"), F.lit("}")).alias("value"))

    def answer(prompt: str) -> str:
        key, _, text = prompt.partition("|")
        return f'{{"asked": {len(text)}}}' if int(key) % 3 == 1 else "nothing"

    answers, new = wiki.run_pass(asked.select("key", "prompt"), known, answer)
    stored = new.select(F.regexp_replace("key", ":[0-9a-f]{24}$", "").alias("key"), F.lit(True).alias("cached_now"))
    return answers.join(stored, "key", "left").select("key", "json", F.coalesce("cached_now", F.lit(False)).alias("cached_now"))


@query("SELECT user_id::VARCHAR AS key, arg_max(props, event_id) AS value FROM events GROUP BY user_id")
def project_blobs(spark, d):
    """Rows put into a table in 50 appends and read back: the newest of each key. No bucket keeps more folders than MOST_FOLDERS."""
    store = cache.Store(spark, graph.shared_folder(spark, "blobs"), buckets=2)
    rows = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("event_id").cast("double").alias("created_at"))
    for part in range(50):
        store.put(rows.where(F.pmod(F.col("created_at").cast("long"), F.lit(50)) == part), ("events", part))
    return store.rows().select("key", "value")


_DROPPED = "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN text || chr(10) || 'changed' ELSE text END AS text, CASE WHEN doc_id % 4 < 2 THEN 2 ELSE 1 END AS seen FROM documents"


@query(f"SELECT doc_id, seen, substr(sha256(text), 1, 24) AS content_hash, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM ({_DROPPED})")
def stream_upsert(spark, d):
    """Three drops: new documents; further and changed ones; the same ones, and old versions that come late. Each document stands once, as last changed."""
    root = graph.shared_folder(spark, "upsert")
    docs_ = V.table(spark, d, "documents").select("doc_id", "text")
    kind, seen = F.col("doc_id") % 4, lambda n: F.lit(n).alias("seen")
    first = docs_.where(kind != 0).select("doc_id", "text", seen(1))
    second = docs_.where(kind < 2).select("doc_id", F.when(kind == 1, F.concat("text", F.lit("\nchanged"))).otherwise(F.col("text")).alias("text"), seen(2))
    third = docs_.where(kind == 2).select("doc_id", "text", seen(3)).unionByName(docs_.where(kind == 1).select("doc_id", F.lit("late").alias("text"), seen(0)))
    table = BucketTable(spark, f"{root}/table", ("doc_id",), buckets=8)
    for drop in (first, second, third):
        drop.write.mode("append").parquet(f"{root}/in")
        reindex.run_upserts(spark, f"{root}/in", table, f"{root}/state", drop.schema, lambda rows: reindex.index_rows(rows, "seen"), ("seen",))
    return table.read()


@query("WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z_][\\p{L}\\p{M}\\p{Nd}\\p{Pc}]*')) AS token FROM benchmark) SELECT token, count(DISTINCT item_id) AS df FROM t GROUP BY token")
def index_saved(spark, d):
    """An index saved and loaded again: in how many chunks each token stands (each text is one line, so one chunk)."""
    path = graph.shared_folder(spark, "index")
    files = V.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("path"), F.regexp_replace("text", r"[\r\n]", " ").alias("content"))
    retrieval.Index.build(files).save(path)
    return retrieval.Index.load(spark, path).idf.select("token", "df")


_CACHED = "WITH kv AS (SELECT user_id || ':' || event_type AS key, props AS value, ts AS put_at, event_id FROM events), newest AS (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY key ORDER BY put_at DESC, event_id DESC) = 1)"


@query(f"{_CACHED} SELECT key, value FROM newest WHERE epoch_ms(put_at) + 86400000 >= (SELECT max(epoch_ms(put_at)) FROM kv)")
def stream_expiry(spark, d):
    """The events as puts into a key-value stream, in two drops by time: what is live at the end, a day being an entry's life."""
    root = graph.shared_folder(spark, "expiry")
    puts = graph.written(V.table(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("tie")))
    half = puts.agg(F.timestamp_micros(((F.min(F.unix_micros("at")) + F.max(F.unix_micros("at"))) / 2).cast("long"))).first()[0]
    table = BucketTable(spark, f"{root}/table", ("key",), buckets=8)
    for drop in (puts.where(F.col("at") <= F.lit(half)), puts.where(F.col("at") > F.lit(half))):
        drop.write.mode("append").parquet(f"{root}/in")
        expiry.run_expiring(spark, spark.readStream.schema(puts.schema).parquet(f"{root}/in"), table, f"{root}/state", 86400)
    return expiry.live(table).select("key", "value")


# Documents before and after a change of about 3 percent: some changed, some gone, some new. One digit of the id decides.
_AFTER = "SELECT doc_id, source, lang, CASE WHEN doc_id % 100 = 7 THEN text || chr(10) || 'one changed line' ELSE text END AS text FROM documents WHERE doc_id % 100 <> 8"
_AFTER_CHUNKS = oracles._CHUNKS.replace("FROM documents)", f"FROM ({_AFTER}))")


def _two_states(spark, d) -> tuple[DataFrame, DataFrame]:
    files, digit = V.files_documents(spark, d), F.col("doc_id") % 100
    changed = F.when(digit == 7, F.concat("content", F.lit("\none changed line"))).otherwise(F.col("content"))
    return files.where(digit != 9), files.where(digit != 8).withColumn("content", changed)


@query(f"WITH {_AFTER_CHUNKS} SELECT path, chunk, round(norm, 5) AS norm FROM norms")
def index_followed(spark, d):
    """The norms of an index that was built over one state of the files and brought to the next: those of a full build."""
    before, after = _two_states(spark, d)
    store = incremental.IndexStore(spark, graph.shared_folder(spark, "followed"))
    store.update(before)
    return store.index(after).norms.select("path", "chunk", F.round("norm", 5).alias("norm"))


@query("SELECT 1::BIGINT AS step, count(*) FILTER (doc_id % 100 <> 9) AS parsed, 0::BIGINT AS removed FROM documents UNION ALL SELECT 2, count(*) FILTER (doc_id % 100 IN (7, 9)), count(*) FILTER (doc_id % 100 IN (7, 8)) FROM documents UNION ALL SELECT 3, 0, 0")
def files_parsed(spark, d):
    """How many files are parsed, and how many rows leave, when symbols are kept by path and content: at first, after a change, without one."""
    before, after = (x.withColumn("language", scan.language(F.col("path"))) for x in _two_states(spark, d))
    kept, told = incremental.FileCache(spark, graph.shared_folder(spark, "parsed"), "symbols", symbols.extract), []
    for step, files in enumerate((before, after, after), 1):
        kept.update(files)
        told.append((step, kept.parsed, kept.removed))  # two counts a step
    return spark.createDataFrame(told, "step long, parsed long, removed long")


# Model, key and address as configured, and what they must come to.
_MODELS = [("deepseek/deepseek-chat", "", "", "https://api.deepseek.com", "deepseek-chat"), ("x/y", "sk-or-1", "", "https://openrouter.ai/api/v1", "x/y"), ("m", "k", "http://h/v1/", "http://h/v1", "m"), ("anthropic/claude", "k", "", "https://api.anthropic.com/v1", "claude"), ("plain", "", "", "https://api.openai.com/v1", "plain"), ("gemini/g/h", "", "", "https://generativelanguage.googleapis.com/v1beta", "g")]
_TOLD = f"[{', '.join(repr(m[3]) for m in _MODELS)}][s_suppkey % 6 + 1] || '/chat/completions' AS address, [{', '.join(repr(m[4]) for m in _MODELS)}][s_suppkey % 6 + 1] || CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 3 THEN '' WHEN 5 THEN '' ELSE s_suppkey::VARCHAR END AS model"


def _by_python(rows: DataFrame, names: list[str], work, schema: str) -> DataFrame:
    """key and the strings that a helper of the driver's makes of a row's strings."""

    def run(batches):
        for batch in batches:
            out = [work(*row) for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [[]] * (schema.count(",")))) ], names=[c.split()[0] for c in schema.split(", ")])

    return rows.select("key", *names).mapInArrow(run, schema)


@query(f"SELECT s_suppkey AS key, {_TOLD} FROM supplier")
def endpoints(spark, d):
    """Each supplier a configuration; models that are passed on whole have its key behind them."""
    k = F.col("s_suppkey")
    whole = F.when((k % 6).isin(1, 2, 4), k.cast("string")).otherwise("")
    rows = V.table(spark, d, "supplier").select(k.alias("key"), F.concat(_by_rule("s_suppkey", [m[0] for m in _MODELS]), whole).alias("model"), *(_by_rule("s_suppkey", [m[i] for m in _MODELS]).alias(n) for i, n in ((1, "api_key"), (2, "api_base"))))
    return _by_python(rows, ["model", "api_key", "api_base"], helpers.endpoint, "key long, address string, model string")


@query("WITH k AS (SELECT s_suppkey AS key, substr(sha256(s_suppkey::VARCHAR), 1, (s_suppkey % 20)::INT) AS secret FROM supplier) SELECT key, CASE WHEN length(secret) <= 12 THEN '***' ELSE substr(secret, 1, 8) || '...' || substr(secret, length(secret) - 3) END AS masked FROM k")
def masked_keys(spark, d):
    """Keys of 0 to 19 characters."""
    k = F.col("s_suppkey")
    rows = V.table(spark, d, "supplier").select(k.alias("key"), F.substr(F.sha2(k.cast("string"), 256), F.lit(1), (k % 20).cast("int")).alias("secret"))
    return _by_python(rows, ["secret"], lambda s: (helpers.mask(s),), "key long, masked string")


# ---- a whole project over the synthetic modules ----------------------------------------------------------------------
def _project(spark, d) -> Project:
    """No file is dropped for number."""
    files = V.files_synth(spark, d).select("path", "content", F.octet_length("content").cast("long").alias("size"), F.encode("content", "UTF-8").alias("raw"))
    return Project(spark, files, "synth", config=helpers.Config(max_files=100_000_000))


_RANK = oracles._pagerank("SELECT path AS node FROM paths", "SELECT * FROM edges", oracles._SYN)


@query(f"WITH RECURSIVE {_RANK}, best AS (SELECT node AS path, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, node) AS rank FROM final) SELECT rank::INT AS rank, path, score, round(score / (SELECT max(score) FROM best), 9) AS share, 'python' AS language, (greatest(m, 1) + 17)::BIGINT AS lines FROM best JOIN cnt USING (path) WHERE rank <= 15")
def repo_map_ranked(spark, d):
    return _project(spark, d).map(15).withColumn("share", F.round("share", 9))


@query(f"WITH {oracles._SYN} SELECT (SELECT count(*) FROM sup) AS files, (SELECT sum(greatest(m, 1) + 17) FROM cnt)::BIGINT AS lines, (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM (SELECT DISTINCT c.path, c.name, s.path, s.name FROM calls c JOIN sym s ON s.name = c.called WHERE c.path <> s.path)) AS call_edges")
def project_totals(spark, d):
    return _project(spark, d).totals()


@query("SELECT 'n' || s_nationkey AS module, count(*) AS files, row_number() OVER (ORDER BY count(*) DESC, 'n' || s_nationkey) AS place FROM supplier GROUP BY s_nationkey")
def modules_in_order(spark, d):
    """The modules of a project, the one with most files first."""
    placed = ranges.numbered(_project(spark, d).modules().select("module", "files"), [F.desc("files"), F.col("module")], "place")
    return placed.withColumn("place", F.col("place") + 1)


@query(f"WITH {oracles._SYN}, {oracles._MODS} SELECT 'index' AS page_id, 'Overview' AS title UNION ALL SELECT 'symbols', 'Symbols' UNION ALL SELECT 'dependencies', 'Dependencies' WHERE EXISTS (FROM mods) UNION ALL SELECT DISTINCT 'modules/n' || n, 'n' || n FROM sup")
def document_pages(spark, d):
    """All passes over a project with the offline completer: no architecture and no guide, as it tells of none."""
    return _project(spark, d).document()[0].select("page_id", "title")
