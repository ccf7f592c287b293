"""Column functions over paths, lines and text; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Lines without their ends: \\n or \\r\\n ends one, a last end opens none, an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def line_count(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def normalize_path(path: Column) -> Column:
    """Drops "." and empty parts; ".." takes back the part before it, if there is one."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


#: First path parts that hold code rather than name a module: as graphs see them, and as the index does.
GRAPH_ROOTS = ("src", "lib", "pkg", "internal", "app")
INDEX_ROOTS = (*GRAPH_ROOTS, "crates")


def module_name(path: Column, roots: tuple = GRAPH_ROOTS) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, "root").when(parts[0].isin(*roots) & (F.size(parts) > 2), parts[1]).otherwise(parts[0])


def diagram_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")


def html_escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def strip_md_links(text: Column) -> Column:
    """[label](page.md) becomes [label](page), unless the target has "://"."""
    return F.regexp_replace(text, r"\[([^\]]*)\]\((?![^)]*://)([^)]+)\.md\)", "[$1]($2)")


def relative_href(here: Column, there: Column) -> Column:
    """Link from one page id to another: up out of what they don't share, then down; with .md at the end."""
    a, b = F.split(here, "/"), F.split(there, "/")
    own = F.slice(a, F.lit(1), F.size(a) - 1)
    most = F.least(F.size(own), F.size(b) - 1)
    shared = F.aggregate(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(own, i - 1) == F.get(b, i - 1)), i).otherwise(n))
    up = F.repeat(F.lit("../"), F.size(own) - shared)
    return F.concat(up, F.array_join(F.slice(b, shared + 1, F.size(b)), "/"), F.lit(".md"))


def content_hash(text: Column) -> Column:
    """First 12 bytes of SHA-256, in hex."""
    return F.substring(F.sha2(text, 256), 1, 24)


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` bytes that ends between characters."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    # Bytes of an unfinished last character: a head byte and the followers it still waits for.
    tail = F.regexp_extract(F.hex(raw), r"((?:[CDEF][0-9A-F])(?:[89AB][0-9A-F])*)$", 1)
    have = F.length(tail) / 2
    need = F.when(tail.rlike("^[CD]"), 2).when(tail.rlike("^E"), 3).when(tail.rlike("^F"), 4).otherwise(0)
    keep = F.octet_length(raw) - F.when(have < need, have).otherwise(0)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), keep.cast("int")), "UTF-8"))


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle.encode())).cast("long")


GIT_URL = r"^(?:https?://)?(?:www\.)?(github\.com|gitlab\.com|bitbucket\.org)/([^/\s]+)/([^/\s]+)$"


def git_url(url: Column) -> Column:
    """struct(host, owner, repo) of a repository address; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")
    part = lambda i: F.regexp_extract(bare, GIT_URL, i)
    return F.when(bare.rlike(GIT_URL), F.struct(part(1).alias("host"), part(2).alias("owner"), part(3).alias("repo")))
