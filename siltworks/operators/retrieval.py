"""Passage retrieval: chunks, TF-IDF, cosine top-k for many questions at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions.batches import frugal, text_slices
from siltworks.operators.graph import written

#: Lines a chunk at most, and from how many on a blank line ends it.
MOST_LINES, BREAK_FROM = 30, 5
TOKEN = r"[a-zA-Z_][\p{L}\p{M}\p{Nd}\p{Pc}]*"


def cut_chunks(rows: list[str]) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each chunk; chunks of white space are left out, their lines still count."""
    out, at = [], 0
    while at < len(rows):
        end = min(at + MOST_LINES, len(rows))
        # A blank line ends a chunk that holds enough lines before it.
        stop = next((i + 1 for i in range(at + BREAK_FROM - 1, end) if not rows[i].strip()), end)
        text = "\n".join(rows[at:stop])
        if text.strip():
            out.append((at + 1, stop, text))
        at = stop
    return out


def chunks(files: DataFrame) -> DataFrame:
    """path, chunk, line_start, line_end, content of files (path, content); chunk counts from 0 within a file."""
    from siltworks.operators.symbols import split_lines

    names = ["path", "chunk", "line_start", "line_end", "content"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "content"):
            rows = [(p, n, *c) for p, t in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True) for n, c in enumerate(cut_chunks(split_lines(t or "")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(frugal(run), "path string, chunk long, line_start long, line_end long, content string")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def counted(lists: pa.Array) -> pa.Array:
    """Each list of tokens as a list of (token, tf), by token's first place in the batch."""
    import numpy as np

    coded = lists.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    width = max(1, len(coded.dictionary))
    cell, tf = np.unique(of * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(cell % width)), pa.array(tf, pa.int64())], names=["token", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(cell // width, np.arange(len(lists) + 1)), pa.int32()), pairs)


def term_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and tokens (array of token, tf) of rows (keys, content). Tokens are counted where they are, so nothing is shuffled."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_tokens"):
            yield pa.RecordBatch.from_arrays([*map(part.column, keys), counted(part.column("_tokens"))], names=[*keys, "tokens"])

    return rows.select(*keys, tokens(F.col("content")).alias("_tokens")).mapInArrow(frugal(run), f"{kept}, tokens array<struct<token: string, tf: bigint>>")


def term_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, token, tf of rows (keys, content); keys must be unique."""
    return term_lists(rows, keys).select(*keys, F.inline("tokens"))


def file_rows(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and rows (array of chunk, line_start, line_end, content, tokens) of files (keys, content): a file stays one row, and nothing is shuffled."""
    from siltworks.operators.symbols import split_lines

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keys).schema)
    cut = "chunk: bigint, line_start: bigint, line_end: bigint, content: string"
    kind = pa.list_(pa.struct([("chunk", pa.int64()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("content", pa.string())]))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "content"):
            rows = [[{"chunk": n, "line_start": a, "line_end": z, "content": c} for n, (a, z, c) in enumerate(cut_chunks(split_lines(t or "")))] for t in part.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(part.column, keys), pa.array(rows, kind)], names=[*keys, "rows"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "_tokens"):
            rows = part.column("rows")
            flat = rows.flatten()
            whole = pa.StructArray.from_arrays([*(flat.field(n) for n in ("chunk", "line_start", "line_end", "content")), counted(part.column("_tokens").flatten())], names=["chunk", "line_start", "line_end", "content", "tokens"])
            offsets = pa.array(rows.offsets.to_numpy() - rows.offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([*map(part.column, keys), pa.ListArray.from_arrays(offsets, whole)], names=[*keys, "rows"])

    chunked = files.select(*keys, "content").mapInArrow(frugal(lines), f"{kept}, rows array<struct<{cut}>>")
    tokened = chunked.withColumn("_tokens", F.transform("rows", lambda r: tokens(r["content"])))
    return tokened.mapInArrow(frugal(counts), f"{kept}, rows array<struct<{cut}, tokens: array<struct<token: string, tf: bigint>>>>")


def with_idf(df: DataFrame, n_chunks: int) -> DataFrame:
    """token, df, idf = ln(chunks / (df + 1)) of token, df."""
    return df.withColumn("idf", F.log(F.lit(float(n_chunks)) / (F.col("df") + 1)))


def inverse_frequencies(tf: DataFrame, n_chunks: int) -> DataFrame:
    return with_idf(tf.groupBy("token").agg(F.count("*").alias("df")), n_chunks)


TABLES = ("chunks", "tf", "idf", "norms")
#: Tokens of all questions up to which they are sent to every task; told by a count.
FEW_TOKENS = 100_000
#: Classes of norm a doubling; a question's terms of the first wave; chunks a question probed for each of its k; what a score may be off by.
CLASSES, LEAD, PROBES, SLACK = 4, 8, 4, 1e-8
#: Terms by class of norm up to which they are sent to every task.
FEW_TERMS = 1_000_000
#: The most frequent tokens that are sent to every task, fewer where some tie; only the postings of the others are shuffled to be weighed.
COMMON = 131_072


class Index:
    """Term counts, inverse frequencies and norms of chunks; tables may be saved and loaded as Parquet.

    postings: token, path, chunk, block, u (the token's weight over the chunk's norm); tops: token, block, top (its largest u
    there). A block is a class of norms: in short chunks a token weighs much, and they must not set the bound of long ones.
    Both are made when a question is asked first.
    """

    def __init__(self, chunk_rows: DataFrame, tf: DataFrame, idf: DataFrame, norms: DataFrame | None = None, lists: DataFrame | None = None, files: DataFrame | None = None, folder: str | None = None):
        self.chunks, self.tf, self.idf = chunk_rows, tf, idf
        self._norms, self._postings, self._tops = norms, None, None
        #: The counts as one row a chunk, if they are at hand so; the files; where weights are kept.
        self._lists, self._files, self._folder = lists, files, folder

    @classmethod
    def build(cls, files: DataFrame) -> Index:
        rows = chunks(files)
        lists = written(term_lists(rows, ["path", "chunk"]))
        tf = lists.select("path", "chunk", F.inline("tokens"))
        return cls(rows, tf, written(inverse_frequencies(tf, lists.count())), lists=lists, files=files)

    @classmethod
    def of(cls, chunk_rows: DataFrame, tf: DataFrame, idf: DataFrame) -> Index:
        return cls(chunk_rows, tf, idf)

    def _weighed(self, tf: DataFrame) -> DataFrame:
        """tf's columns with w, the weight of each token. Postings of the COMMON most frequent tokens are weighed where they are."""
        idf = self.idf.select("token", "df", "idf")
        weigh = lambda rows: rows.withColumn("w", F.col("tf") * F.col("idf")).drop("tf", "df", "idf")
        if idf.count() <= COMMON:
            return weigh(tf.join(F.broadcast(idf), "token"))
        least = idf.select("df").orderBy(F.desc("df")).limit(COMMON + 1).agg(F.min("df")).first()[0]
        common = F.broadcast(idf.where(F.col("df") > least))
        others = tf.join(F.broadcast(common.select("token")), "token", "left_anti").join(idf.where(F.col("df") <= least).hint("merge"), "token")
        return weigh(tf.join(common, "token")).unionByName(weigh(others))

    def _weights(self) -> DataFrame:
        return self._weighed(self.tf)

    def _kept(self, name: str, rows) -> DataFrame:
        """rows(), written to the index's own folder once, or to a new one."""
        if self._folder is None:
            return written(rows())
        spark = self.tf.sparkSession
        path = f"{self._folder}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            rows().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    @property
    def norms(self) -> DataFrame:
        if self._norms is None:
            self._norms = self._kept("norms", lambda: self._weights().groupBy("path", "chunk").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
        return self._norms

    def _make_postings(self, some: DataFrame | None = None) -> DataFrame:
        """A chunk's counts move once, to its norm, as one row where they are held so. some: the tokens (few) that are wanted."""
        rows = self.tf if self._lists is None else self._lists
        if some is not None and self._lists is None:
            rows = rows.join(F.broadcast(some.select("token")), "token", "left_semi")
        normed = rows.join(self.norms.where("norm > 0"), ["path", "chunk"])
        flat = normed if self._lists is None else normed.select("path", "chunk", "norm", F.inline("tokens"))
        held = self._weighed(flat) if some is None else flat.join(F.broadcast(some.select("token", "idf")), "token").withColumn("w", F.col("tf") * F.col("idf"))
        return held.where("w <> 0").select("token", "path", "chunk", F.floor(F.log2("norm") * CLASSES).cast("int").alias("block"), (F.col("w") / F.col("norm")).alias("u"))

    def asked(self, terms: DataFrame, few: bool) -> Index:
        """The index for a retrieval by these tokens: where postings are not kept and the tokens are few, it has no others."""
        if self._folder is not None or self._postings is not None or not few:
            return self
        some = terms.select("token").distinct().join(self.idf, "token")
        out = Index(self.chunks, self.tf, self.idf, self.norms, self._lists)
        out._postings = written(self._make_postings(written(some)))
        return out

    def passages(self, found: DataFrame) -> DataFrame:
        """The chunks of the files in found (path; few rows): other files are not cut again."""
        if self._files is None:
            return self.chunks
        return chunks(self._files.join(found.select("path"), "path", "left_semi"))

    @staticmethod
    def _make_tops(postings: DataFrame) -> DataFrame:
        """A weight and the question's have the same sign, so the larger distance from 0 bounds their product."""
        return postings.groupBy("token", "block").agg(F.max(F.abs("u")).alias("top"))

    @property
    def postings(self) -> DataFrame:
        if self._postings is None:
            self._postings = self._kept("postings", self._make_postings)
        return self._postings

    @property
    def tops(self) -> DataFrame:
        if self._tops is None:
            self._tops = self._kept("tops", lambda: self._make_tops(self.postings))
        return self._tops

    def save(self, folder: str) -> None:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark, folder: str) -> Index:
        """Refuses tables that don't belong together: term counts of chunks that aren't there."""
        held = {n: spark.read.parquet(f"{folder}/{n}") for n in TABLES}
        if not held["tf"].join(held["chunks"], ["path", "chunk"], "left_anti").isEmpty():
            raise ValueError("term counts without their chunk")
        return cls(*(held[n] for n in TABLES))

    def save_weights(self, folder: str) -> None:
        """norms; idf must be there. Postings follow when a question is asked first."""
        self._folder = folder
        self.norms.count()

    @classmethod
    def with_weights(cls, chunk_rows: DataFrame, tf: DataFrame, folder: str, lists: DataFrame | None = None) -> Index:
        return cls(chunk_rows, tf, chunk_rows.sparkSession.read.parquet(f"{folder}/idf"), lists=lists, folder=folder)


def _asked(index: Index, questions: DataFrame) -> tuple[DataFrame, object]:
    """question, token, q (its share of the question's weight vector, of length 1) of every token that an index knows; how to send them."""
    wanted = written(term_counts(questions, ["question"]))
    few = F.broadcast if wanted.count() <= FEW_TOKENS else (lambda df: df)
    # Tokens that weigh nothing leave here, before anything is met.
    asked = few(wanted).join(index.idf.select("token", "idf"), "token").where("idf <> 0").select("question", "token", (F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("question")))
    return written(asked.select("question", "token", (F.col("w") / length).alias("q"))), few


def _met(index: Index, terms: DataFrame, few) -> DataFrame:
    """question, path, chunk, part: what the terms (question, token, q) add to the score of each chunk that holds one."""
    return index.postings.join(few(terms), "token").groupBy("question", "path", "chunk").agg(F.sum(F.col("q") * F.col("u")).alias("part"))


def _scores(index: Index, pairs: DataFrame, asked: DataFrame, few) -> DataFrame:
    """question, path, chunk, score of pairs (question, path, chunk), over all of the question's terms."""
    held = index.postings.join(pairs, ["path", "chunk"]).join(few(asked), ["question", "token"])
    return held.groupBy("question", "path", "chunk").agg(F.round(F.sum(F.col("q") * F.col("u")), 9).alias("score"))


def waves(index: Index, questions: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """The two waves of retrieve(): lead terms and needed terms (question, token, q, by block), candidates (question, path, chunk), asked terms.

    Wave one meets the LEAD heaviest terms of each question; the exact scores of the best chunks found so give a score that
    k chunks reach. Terms whose bounds in a block, smallest first, add up to less than that can't lift a chunk of the
    block to it alone: wave two meets the other ones only, and keeps a chunk if its part and the bounds of the rest reach
    the score. Nothing that could be among the k best is left out.
    """
    asked, few = _asked(index, questions)
    index = index.asked(asked, few is F.broadcast)
    by_question = Window.partitionBy("question")
    lead = asked.withColumn("place", F.row_number().over(by_question.orderBy(F.desc(F.abs("q")), "token"))).where(F.col("place") <= LEAD).select("question", "token", "q")
    first = _met(index, lead, few)
    probes = first.withColumn("place", F.row_number().over(by_question.orderBy(F.desc("part"), "path", "chunk"))).where(F.col("place") <= PROBES * k)
    probed = _scores(index, written(probes.select("question", "path", "chunk")), asked, few)
    placed = probed.withColumn("place", F.row_number().over(by_question.orderBy(F.desc("score")))).where(F.col("place") == k)
    reached = placed.select("question", (F.col("score") - SLACK).alias("reached"))
    terms = few(asked).join(index.tops, "token").select("question", "token", "q", "block", (F.abs("q") * F.col("top")).alias("bound"))
    in_block = Window.partitionBy("question", "block")
    under = F.sum("bound").over(in_block.orderBy("bound", "token").rowsBetween(Window.unboundedPreceding, 0))
    judged = terms.withColumn("under", under).join(reached, "question", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0)))
    judged = judged.withColumn("needed", F.col("under") >= F.col("reached"))
    judged = written(judged.withColumn("spare", F.coalesce(F.sum(F.when(~F.col("needed"), F.col("bound"))).over(in_block), F.lit(0.0))))
    needed = judged.where("needed").select("question", "token", "block", "q", "spare", "reached")
    sent = F.broadcast if few is F.broadcast and judged.count() <= FEW_TERMS else (lambda df: df)
    second = index.postings.join(sent(needed), ["token", "block"]).groupBy("question", "path", "chunk").agg(F.sum(F.col("q") * F.col("u")).alias("part"), F.first("spare").alias("spare"), F.first("reached").alias("reached"))
    candidates = second.where(F.col("part") + F.col("spare") >= F.col("reached")).select("question", "path", "chunk")
    return {"asked": asked, "lead": lead, "needed": needed, "candidates": candidates, "few": few, "index": index}


def retrieve(index: Index, questions: DataFrame, k: int = 5) -> DataFrame:
    """question, rank, path, chunk, score: for each question (question, content) the k most similar chunks with a score over 0.

    Exact, by two waves over bounded postings. Ties go by path and chunk.
    """
    found = waves(index, questions, k)
    scored = _scores(found["index"], written(found["candidates"]), found["asked"], found["few"])
    by = Window.partitionBy("question").orderBy(F.desc("score"), "path", "chunk")
    best = scored.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k).where("score > 0")
    return best.select("question", "rank", "path", "chunk", F.round("score", 6).alias("score"))


def context(found: DataFrame, chunk_rows: DataFrame, questions: DataFrame) -> DataFrame:
    """question, context: the found chunks as text, best first; a fixed sentence where nothing was found."""
    whole = found.join(chunk_rows, ["path", "chunk"])
    head = F.concat(F.lit("### "), "path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit("\n"), "content")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", head.alias("t")))), lambda x: x["t"]), "\n\n")
    got = whole.groupBy("question").agg(text.alias("context"))
    return questions.select("question").join(got, "question", "left").select("question", F.coalesce("context", F.lit("No matching passages were found.")).alias("context"))


#: Bytes of a run of lines, about.
RUN_BYTES = 1 << 20


def fingerprint(files: DataFrame, root: str) -> DataFrame:
    """One row: a digest of root and of every file's path, size and content digest, by path. 24 hex digits.

    Lines are sorted by range over the cluster; each range becomes numbered runs of about RUN_BYTES, and one task digests the
    runs by number, whatever order they come in. It holds one run at a time and refuses a gap.
    """
    line = F.concat(F.encode("path", "UTF-8"), F.encode(F.col("size").cast("string"), "UTF-8"), F.unhex(F.sha2("content", 256)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, part = [], 0, 0, None
        cut = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["part", "number", "run"])
        for batch in batches:
            for part, text in zip(batch.column("part").to_pylist(), batch.column("line").to_pylist(), strict=True):
                held.append(text)
                size += len(text)
                if size >= RUN_BYTES:
                    yield cut()
                    held, size, number = [], 0, number + 1
        if held:
            yield cut()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = hashlib.sha256(), (-1, -1)
        for batch in batches:
            for part, number, text in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "run")), strict=True):
                if (part, number) != (at[0], at[1] + 1) and not (part > at[0] and number == 0):
                    raise ValueError(f"run {number} of range {part} does not follow {at}")
                total.update(text)
                at = (part, number)
        yield pa.RecordBatch.from_arrays([pa.array([total.hexdigest()[:24]])], names=["fingerprint"])

    spark = files.sparkSession
    ranged = files.select("path", line.alias("line")).repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").sortWithinPartitions("path")
    runs = written(ranged.select(F.spark_partition_id().alias("part"), "line").mapInArrow(run, "part int, number long, run binary"))
    first = spark.range(1).select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("number"), F.encode(F.lit(root), "UTF-8").alias("run"))
    return first.unionByName(runs).repartition(1).sortWithinPartitions("part", "number").mapInArrow(digest, "fingerprint string")


def load_or_build(files: DataFrame, root: str, folder: str) -> Index:
    """The index of files (path, size, content) kept under folder by their fingerprint; built and saved if it isn't there or doesn't fit."""
    from pyspark.errors import AnalysisException

    spark = files.sparkSession
    at = f"{folder}/{fingerprint(files, root).first()[0]}"
    try:
        return Index.load(spark, at)
    except (AnalysisException, ValueError):
        Index.build(files).save(at)
        return Index.load(spark, at)
