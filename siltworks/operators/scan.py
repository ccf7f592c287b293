"""Which files to keep, and why the others go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.columns import file_name, line_count, lines, trimmed
from siltworks.operators import ranges

# Names, endings and lists that decide results.
SKIP_DIRS = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "env", ".idea", ".vscode", ".next", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", ".turbo", "coverage", ".cache", "vendor", "target", "__snapshots__", ".svn", ".hg", ".gradle", ".m2", "Pods", ".dart_tool", ".pub-cache",
)
SKIP_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".flac", ".zip", ".tar", ".gz", ".bz2", ".7z", ".rar", ".xz",
    ".exe", ".dll", ".so", ".dylib", ".bin", ".dat", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pyc", ".pyo", ".class", ".o", ".obj", ".pdf", ".doc", ".docx", ".xls", ".xlsx",
    ".ppt", ".pptx", ".db", ".sqlite", ".sqlite3", ".lock", ".min.js", ".min.css", ".map", ".wasm",
)
SENSITIVE_NAMES = (".env", ".env.local", ".env.production", ".env.development", ".npmrc", ".pypirc", ".netrc", "id_rsa", "id_ed25519", "known_hosts")
MINIFIED_SUFFIXES = (".js", ".mjs", ".cjs", ".css")
CODE_LANGUAGES = (
    "python", "javascript", "typescript", "jsx", "tsx", "go", "rust", "java", "kotlin", "scala", "c", "cpp", "csharp", "ruby", "php", "r", "sql", "swift", "lua", "dart", "vue", "svelte",
    "zig", "shell", "dockerfile", "makefile",
)
CONFIG_FILES = (
    "requirements.txt", "setup.py", "setup.cfg", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "go.sum", "Makefile", "CMakeLists.txt", "Dockerfile", "docker-compose.yml",
    "docker-compose.yaml", ".env.example", "config.py", "config.yaml", "config.json", "config.toml", "README.md", "README.rst", "README.txt", "README", "tsconfig.json", "vite.config.ts",
    "vite.config.js", "webpack.config.js", "rollup.config.js", "Gemfile", "build.gradle", "pom.xml", ".eslintrc.json", ".prettierrc",
)
ENTRYPOINT_NAMES = (
    "main.py", "app.py", "index.py", "server.py", "run.py", "__main__.py", "main.go", "main.rs", "main.ts", "main.js", "index.ts", "index.js", "index.tsx", "index.jsx", "App.tsx", "App.jsx",
    "App.vue", "App.svelte", "manage.py", "wsgi.py", "asgi.py",
)
ENTRYPOINT_DIRS = ("cmd", "bin", "scripts", "entrypoints")
# The language of each ending.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".mts": "typescript", ".jsx": "jsx",
    ".tsx": "tsx", ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".less": "less", ".json": "json", ".jsonc": "json", ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml", ".md": "markdown", ".mdx": "markdown", ".txt": "text", ".env": "text", ".rst": "rst", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".go": "go",
    ".rs": "rust", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".r": "r", ".sql": "sql", ".swift": "swift", ".lua": "lua", ".dart": "dart", ".vue": "vue", ".svelte": "svelte",
    ".zig": "zig", ".nim": "nim", ".ex": "elixir", ".exs": "elixir", ".erl": "erlang", ".hs": "haskell", ".ml": "ocaml", ".clj": "clojure", ".proto": "protobuf",
    ".graphql": "graphql", ".gql": "graphql", ".tf": "terraform", ".hcl": "hcl", ".prisma": "prisma", ".astro": "astro", ".cfg": "ini", ".ini": "ini", ".cmake": "cmake",
    ".gradle": "gradle", ".dockerfile": "dockerfile",
}

MAX_FILE_SIZE, MAX_FILES = 200 * 1024, 1000


def language(path: Column) -> Column:
    name = F.lower(file_name(path))
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.when((name == "dockerfile") | name.startswith("dockerfile."), "dockerfile").when(name == "makefile", "makefile").otherwise(F.coalesce(F.try_element_at(known, ext), F.lit("unknown")))


def is_config(path: Column) -> Column:
    return file_name(path).isin(*CONFIG_FILES)


def is_entrypoint(path: Column) -> Column:
    parts = F.split(path, "/")
    return file_name(path).isin(*ENTRYPOINT_NAMES) | F.coalesce(F.get(parts, F.size(parts) - 2).isin(*ENTRYPOINT_DIRS), F.lit(False))


def glob_regex(pattern: str) -> str:
    """* crosses folders, ? is one character, all else is literal."""
    import re

    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def parse_ignore(text: str, dirs: bool = False) -> list[tuple[str, bool]]:
    """(pattern, negated) by line. Patterns for folders only never match files and are left out, unless dirs is set:
    then they match every path below."""
    out = []
    for line in (x.strip() for x in text.splitlines()):
        if not line or line.startswith("#"):
            continue
        negated, body = line.startswith("!"), line.removeprefix("!").strip().replace("\\", "/")
        if body.endswith("/"):
            if not dirs:
                continue
            body = body.strip("/") + "/*"
        if body := body.strip("/"):
            out.append((body, negated))
    return out


def _some_part(path: Column, regex: str) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.rlike(regex))


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last matching rule decides. A pattern with a slash is matched to the whole path or as a leading folder,
    another to each part of the path."""
    verdict = F.lit(False)
    for pattern, negated in rules:
        if "/" in pattern:
            hit = path.rlike(glob_regex(pattern)) | path.startswith(f"{pattern}/")
        else:
            hit = _some_part(path, glob_regex(pattern))
        verdict = F.when(hit, not negated).otherwise(verdict)
    return verdict


def looks_minified(path: Column, text: Column) -> Column:
    sizes = F.transform(lines(text), lambda x: F.octet_length(x))
    longest = F.coalesce(F.array_max(sizes), F.lit(0))
    full = F.size(F.filter(lines(text), lambda x: trimmed(x) != ""))
    ending = F.lower(path).rlike(r"\.(js|mjs|cjs|css)$")
    return ending & (longest >= 1000) & ((full <= 5) | (longest > F.floor(F.octet_length(text) / 2)))


def with_reason(files: DataFrame, max_file_size: int = MAX_FILE_SIZE, rules: list | None = None, exclude: tuple = (), raw: str | None = None) -> DataFrame:
    """files (path, size, content) with language, and reason: null for kept files, else the first test that a file fails.

    skipped, ignored, sensitive and suffix files are no candidates; oversized, empty, binary and minified ones are.
    """
    parts = F.split("path", "/")
    name = F.lower(file_name(F.col("path")))
    skip = F.exists(parts, lambda p: p.isin(*SKIP_DIRS, *exclude) | p.endswith(".egg-info"))
    secret = name.isin(*SENSITIVE_NAMES) | (name.startswith(".env.") & (name != ".env.example"))
    suffix = name.rlike("(" + "|".join(s.replace(".", r"\.") for s in SKIP_SUFFIXES) + ")$")
    head = F.substring(F.col(raw) if raw else F.encode(F.substring("content", 1, 1024), "UTF-8"), 1, 1024)
    reason = F.when(skip, "skipped").when(ignored(F.col("path"), rules or []), "ignored").when(secret, "sensitive").when(suffix, "suffix").when(F.col("size") > max_file_size, "oversized").when(F.col("size") == 0, "empty")
    reason = reason.when(F.hex(head).rlike("^(..)*?00"), "binary").when(looks_minified(F.col("path"), F.col("content")), "minified")
    return files.withColumn("language", language(F.col("path"))).withColumn("reason", reason)


def cap(files: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Kept files over max_files get the reason priority: configs and entry points stay first, then code, then by path.

    The hard cap on scanned files comes before: kept rows after the first max(4 * max_files, max_files + 100) paths go.
    Both cuts rank paths by range over the cluster, whatever the limits are.
    """
    kept = files.where("reason is null").select("path", "language")
    hard = max(4 * max_files, max_files + 100)
    early = ranges.first_rows(kept, ["path"], hard)
    order = F.when(is_config(F.col("path")) | is_entrypoint(F.col("path")), 0).when(F.col("language").isin(*CODE_LANGUAGES), 1).otherwise(2)
    best = ranges.first_rows(early, [order, F.col("path")], max_files).select("path", F.lit(True).alias("_best"))
    out = files.join(best, "path", "left")
    return out.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_best").isNull(), "priority").otherwise(F.col("reason"))).drop("_best")


def report(files: DataFrame) -> DataFrame:
    """One row of counts over with_reason() (and cap())."""
    n = lambda *names: F.count_if(F.col("reason").isin(*names))
    big = files.where("reason = 'oversized'").select("path").orderBy("path").limit(3).agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("oversized"))
    candidates = F.count_if(F.col("reason").isNull() | ~F.col("reason").isin("skipped", "ignored", "sensitive", "suffix"))
    return files.agg(candidates.alias("candidates"), F.count_if(F.col("reason").isNull()).alias("kept"), n("oversized").alias("oversized_count"), n("binary").alias("binary_count"), n("minified").alias("minified_count"), n("priority").alias("priority_dropped")).crossJoin(F.broadcast(big))  # one row each


def described(files: DataFrame, preview_lines: int = 2) -> DataFrame:
    """Adds is_config, is_entrypoint, lines and preview."""
    p, text = F.col("path"), F.col("content")
    whole = is_config(p) | is_entrypoint(p)
    preview = F.when(whole, text).otherwise(F.array_join(F.slice(lines(text), 1, preview_lines), "\n"))
    return files.withColumn("is_config", is_config(p)).withColumn("is_entrypoint", is_entrypoint(p)).withColumn("lines", line_count(text)).withColumn("preview", preview)


def in_order(files: DataFrame) -> DataFrame:
    """Adds ord: configs, then entry points, then others, by path."""
    kind = F.when(is_config(F.col("path")), 0).when(is_entrypoint(F.col("path")), 1).otherwise(2)
    keys = ranges.numbered(files.select("path"), [kind, F.col("path")])
    return files.join(keys, "path")


def tree_rows(files: DataFrame) -> DataFrame:
    """Every path and every folder above it (with a slash at the end), once."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return files.select(F.explode(F.array_append(above, F.col("path"))).alias("entry")).distinct()


def tree_text(files: DataFrame, most: int = 200) -> DataFrame:
    """One row, text: the entries of tree_rows() in order, indented by depth; after `most` of them, how many more there are."""
    rows = tree_rows(files)
    bare = F.regexp_replace("entry", "/$", "")
    depth = F.size(F.split(bare, "/")) - 1
    line = F.concat(F.repeat(F.lit("  "), depth), file_name(bare), F.when(F.col("entry").endswith("/"), "/").otherwise(""))
    top = rows.orderBy("entry").limit(most).agg(F.array_sort(F.collect_list(F.struct("entry", line.alias("t")))).alias("rows"))
    more = rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    rest = F.when(F.col("more") > 0, F.concat(F.lit("\n  ... and "), F.col("more").cast("string"), F.lit(" more entries"))).otherwise("")
    return top.crossJoin(more).select(F.concat(F.array_join(F.transform("rows", lambda x: x["t"]), "\n"), rest).alias("text"))  # one row each


def language_histogram(files: DataFrame, top: int = 10) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes")).orderBy(F.desc("n_files"), "language").limit(top)
