"""What was read from files, kept by path and content, so that only changed files are parsed again.

A table holds one row a file: its path, the digest of its content and what was parsed from it, nested. Files are bounded in
size, so a row is. An anti join of the files at hand with that table is the list of work; rows whose file changed or went
leave in the same version. The retrieval index keeps how many chunks hold a token in a second table, which gets the
differences only: the tokens of chunks that came less those of chunks that went.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.columns import content_hash
from siltworks.operators import retrieval
from siltworks.operators.graph import written
from siltworks.sources.buckets import BucketTable

BUCKETS = 16


@dataclass
class Change:
    """The files that were parsed (work: all their columns) and the paths whose rows left the table."""

    work: DataFrame
    gone: DataFrame
    parsed: int
    removed: int


def changes(files: DataFrame, table: BucketTable) -> Change:
    """files: path, content and more. A file is work where the table doesn't hold its path with its content."""
    at = table.version()
    now = files.withColumn("content_hash", content_hash(F.col("content")))
    held = table.read(at)
    if held is None:
        return Change(now, now.select("path").limit(0), now.count(), 0)
    held = held.select("path", "content_hash")
    gone = written(held.join(now.select("path", "content_hash"), ["path", "content_hash"], "left_anti").select("path"))
    fresh = written(now.select("path", "content_hash").join(held, ["path", "content_hash"], "left_anti"))
    return Change(now.join(fresh, ["path", "content_hash"], "left_semi"), gone, fresh.count(), gone.count())


class FileCache:
    """Flat rows (path, ...) that parse() makes of files, one table a name. nest(), if given, makes path, content_hash, rows of the same
    files (with content_hash), one row a file, without a shuffle."""

    def __init__(self, spark: SparkSession, folder: str, name: str, parse: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, nest: Callable[[DataFrame], DataFrame] | None = None):
        self.table, self.parse, self.nest = BucketTable(spark, f"{folder}/{name}", ("path",), buckets), parse, nest
        self.parsed = self.removed = 0

    def update(self, files: DataFrame) -> Change:
        """Bring the table to these files. parsed and removed tell how many files were read and how many rows left."""
        change = changes(files, self.table)
        self.parsed, self.removed = change.parsed, change.removed
        if change.parsed or change.removed:
            if self.nest is None:
                work = written(change.work)
                flat = self.parse(work.drop("content_hash"))
                rows = flat.groupBy("path").agg(F.collect_list(F.struct(*(c for c in flat.columns if c != "path"))).alias("rows"))
                parsed = work.select("path", "content_hash").join(rows, "path", "left")
            else:
                work, parsed = change.work, self.nest(change.work)
            self.table.replace(parsed, change.gone.unionByName(work.select("path")))
            self.table.vacuum()
        return change

    def rows(self, files: DataFrame) -> DataFrame:
        """What parse(files) gives, read from the table after an update."""
        self.update(files)
        held = self.table.read()
        return self.parse(files.limit(0)) if held is None else held.select("path", F.inline("rows"))


class IndexStore:
    """A retrieval index that follows its files.

    chunks: by path, its chunks with the counts of their tokens; df: by token, in how many chunks it stands. The norms
    depend on the number of all chunks, so they are made anew where anything changed, from the stored counts and without
    reading a text; they and the postings stay for the next call with the same files.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.cache = FileCache(spark, self.folder, "chunks", self._parse, buckets, self._nest)
        self.df = BucketTable(spark, f"{self.folder}/df", ("token",), buckets)

    @staticmethod
    def _parse(files: DataFrame) -> DataFrame:
        """path, chunk, line_start, line_end, content, tokens (array of token, tf) of each chunk."""
        return retrieval.file_rows(files, ["path"]).select("path", F.inline("rows"))

    @staticmethod
    def _nest(files: DataFrame) -> DataFrame:
        return retrieval.file_rows(files, ["path", "content_hash"])

    @staticmethod
    def _tokens(rows: DataFrame) -> DataFrame:
        """One row a chunk and token of it, of rows as the table holds them."""
        return rows.select("path", F.inline("rows")).select("path", "chunk", F.inline("tokens"))

    def update(self, files: DataFrame) -> Change:
        before = self.cache.table.version()
        was = self.cache.table.read(before)
        follows = self.df.version().batches.get("chunks", -1) == before.number  # else a change broke off between the two tables
        change = self.cache.update(files)
        now = self.cache.table.version()
        if now.number == before.number and follows:
            return change
        whole = self.cache.table.read(now)
        if whole is None:
            return change
        if was is None or not follows:
            counts = self._tokens(whole).groupBy("token").agg(F.count("*").alias("df"))
            held = self.df.read()
            gone = counts.select("token") if held is None else counts.select("token").union(held.select("token"))
        else:
            came = self._tokens(whole.join(written(change.work.select("path", "content_hash")), ["path", "content_hash"], "left_semi")).select("token", F.lit(1).alias("n"))
            went = self._tokens(was.join(change.gone, "path", "left_semi")).select("token", F.lit(-1).alias("n"))
            delta = written(came.unionByName(went).groupBy("token").agg(F.sum("n").alias("n")).where("n <> 0"))
            held = self.df.read().join(delta.select("token"), "token", "left_semi")
            counts = delta.join(held, "token", "left").select("token", (F.coalesce("df", F.lit(0)) + F.col("n")).cast("long").alias("df")).where("df > 0")
            gone = delta.select("token")
        self.df.replace(counts.select("token", "df"), gone, ("chunks", now.number))
        self.df.vacuum()
        self.cache.table.vacuum()
        return change

    def index(self, files: DataFrame) -> retrieval.Index:
        """The index of these files: equal to Index.build(files)."""
        self.update(files)
        held, df = self.cache.table.read(), self.df.read()
        if held is None or df is None:
            return retrieval.Index.build(files)
        rows = held.select("path", F.inline("rows"))
        chunks = rows.select("path", "chunk", "line_start", "line_end", "content")
        lists = rows.select("path", "chunk", "tokens")
        tf = lists.select("path", "chunk", F.inline("tokens"))
        number = f"{self.cache.table.version().number}-{self.df.version().number}"
        at = f"{self.folder}/weights/{number}"
        files_of = self.cache.table.files
        weights = files_of.jvm.Path(at)
        if not files_of.fs.exists(files_of.jvm.Path(f"{at}/norms/_SUCCESS")):
            idf = retrieval.with_idf(df, chunks.count())
            idf.write.mode("overwrite").parquet(f"{at}/idf")
            retrieval.Index.of(chunks, tf, self.spark.read.parquet(f"{at}/idf")).save_weights(at)
            parent = weights.getParent()
            for other in files_of.fs.listStatus(parent):
                if other.getPath().getName() != number:
                    files_of.fs.delete(other.getPath(), True)
        return retrieval.Index.with_weights(chunks, tf, at, lists)
