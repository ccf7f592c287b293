"""Alignment of two tokenizers over the bytes of the same texts.

Tokens become intervals of bytes, laid end to end for a chunk of texts, and DuckDB works on them inside each task: an ASOF
join finds token pairs that end together (links), window sums over the marked ends number the groups between such ends, and
an ASOF join with a range join behind it gives the overlaps. How often two ids are linked is counted chunk by chunk; Spark
merges the partial counts and scores each document's links against the whole corpus.

A text longer than a chunk is cut into parts where tokens of both sides end, which no group crosses; so a part's tables are
bounded and the digest of a document's groups runs over its parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.llm.common import frugal, materialize, process_cache, salted_join, text_chunks, with_text
from siltworks.llm.packing import _ONE_MATCH, KEPT_BYTES, Encoder, piece_starts
from siltworks.llm.textcols import sum_by, text_bytes

#: Tokens of the left side in a part at most, or one group if that is longer.
PART_TOKENS = 400_000
#: Bytes of text in a chunk, about; a longer text stands alone.
CHUNK = 1 << 20
#: Pieces of text whose ids a process keeps of each side.
KEPT = 3 << 17
#: Distinct id pairs up to which their counts are sent to every task (a long, two longs and a hash entry each); beyond, they are joined by shuffle.
MOST_PAIRS = 1 << 20
SALTS = 32
TOLD = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, n long"
OVERLAPS = "doc_id long, a_index long, b_index long, a_id int, b_id int, start long, end long"


@dataclass
class Tokens:
    """Ids of texts, end to end, and how many each text has."""

    ids: np.ndarray
    counts: np.ndarray


class Vocabulary:
    """The bytes of each id."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.fromiter(map(len, entries), np.int64, len(entries))
        self.first = np.append(0, np.cumsum(self.sizes))[:-1]
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        return self.bytes[np.repeat(self.first[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Kept:
    """Ids of pieces of text. Each distinct piece of a chunk is looked up once; short ones stay for the next chunks."""

    def __init__(self, encode: Callable[[list[bytes]], list]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        """number: of each kept piece; first, flat: where its ids begin, and the ids of all, end to end."""
        self.number: dict[bytes, int] = {}
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def tokens(self, buf: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> Tokens:
        """starts: where the pieces begin, the texts' own starts (doc) among them."""
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf))), pa.py_buffer(buf)]).dictionary_encode()
        pieces = words.dictionary.to_pylist()
        if len(self.number) > KEPT:
            self.clear()
        number = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = sorted(np.flatnonzero(number < 0).tolist(), key=lambda i: len(pieces[i]) > KEPT_BYTES)
        found = self.encode([pieces[i] for i in new])
        number[new] = np.arange(len(self.first) - 1, len(self.first) - 1 + len(new))
        first = np.append(self.first, self.first[-1] + np.cumsum([len(f) for f in found], dtype=np.int64))
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32)])
        short = sum(len(pieces[i]) <= KEPT_BYTES for i in new)  # these come first
        self.number.update((pieces[i], int(number[i])) for i in new[:short])
        self.first = first[: len(self.first) + short]
        self.flat = flat[: self.first[-1]]
        codes = number[words.indices.to_numpy(zero_copy_only=False)]
        each = first[codes + 1] - first[codes]
        ids = flat[np.repeat(first[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        return Tokens(ids, sum_by(each, np.searchsorted(starts, doc)))


class ByteSide:
    """A byte-level file of the tokenizers library over space + text; strings of special tokens are plain text.

    Texts are cut where packing.Encoder cuts them, which gives whole texts' ids.
    """

    def __init__(self, path: str):
        self.inner = Encoder(path)
        self.inner.full.encode_special_tokens = True
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        entries = [b""] * self.inner.full.get_vocab_size()
        for entry, i in self.inner.full.get_vocab().items():
            entries[i] = bytes(shown[c] for c in entry) if all(c in shown for c in entry) else entry.encode()
        self.vocabulary, self.kept = Vocabulary(entries), Kept(self._encode)

    def _encode(self, pieces: list[bytes]) -> list:
        texts = [p.decode() for p in pieces]
        found = [[t.id for t in self.inner.model.tokenize(t.translate(self.inner.mapped))] if self.inner.cuts and _ONE_MATCH.fullmatch(t) else None for t in texts]
        rest = [k for k, f in enumerate(found) if f is None]
        for k, e in zip(rest, self.inner.full.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        return found

    def tokens(self, spaced: pa.Array) -> Tokens:
        buf, doc = text_bytes(spaced)
        return self.kept.tokens(buf, doc, piece_starts(buf, doc) if self.inner.cuts else doc[:-1])


class PieceSide:
    """A sentencepiece model over text, before which it puts a space itself.

    Texts are cut before each space that follows something else. That gives whole texts' ids where no entry of the model
    holds a space behind something else, so that no merge crosses such a cut; with another model whole texts are encoded.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = [self.model.piece_to_id("▁")]
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.kept = Kept(self._encode)

    def _encode(self, pieces: list[bytes]) -> list:
        """The model puts a space before each text, so the piece's own first one is left out; it puts none before an empty text."""
        return [ids or self.space for ids in self.model.encode([p[1:].decode() for p in pieces], num_threads=1)] if pieces else []

    def tokens(self, spaced: pa.Array) -> Tokens:
        buf, doc = text_bytes(spaced)
        blank = buf == 32
        start = np.zeros(len(buf) + 1, bool)
        if self.cuts and len(buf):
            start[1:-1] = blank[1:] & ~blank[:-1]
        start[doc[:-1]] = True
        return self.kept.tokens(buf, doc, np.flatnonzero(start[: len(buf)]))


def sides(left: str | None, right: str | None) -> tuple[ByteSide, PieceSide]:
    """By default the installed public vocabularies; each loaded once in a process."""
    import os

    import public_tokenizers as P

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    left, right = left or P.path("byte_bpe_50k.json"), right or P.path("piece_bpe_32k.model")
    return process_cache(f"align {left}", lambda: ByteSide(left)), process_cache(f"align {right}", lambda: PieceSide(right))


@dataclass
class Part:
    """Token ends and ids of both sides, and spans: (text, first byte, end, tokens left, tokens right, whether the text ends)."""

    ea: np.ndarray
    a: np.ndarray
    eb: np.ndarray
    b: np.ndarray
    spans: list[tuple]

    def tables(self, con) -> None:
        for name, ends, ids in (("a", self.ea, self.a), ("b", self.eb, self.b)):
            con.register("_in", pa.table({"i": np.arange(len(ids)), "s": np.append(self.spans[0][1], ends[:-1]), "e": ends, "id": ids.astype(np.int32)}))
            con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM _in")
        con.register("_in", pa.table({"doc": [x[0] for x in self.spans], "s": [x[1] for x in self.spans], "e": [x[2] for x in self.spans]}))
        con.execute("CREATE OR REPLACE TEMP TABLE d AS FROM _in")


def parts(texts: pa.Array, left: ByteSide, right: PieceSide, most: int = PART_TOKENS) -> Iterator[Part]:
    """The texts that both sides give back byte by byte, in order."""
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    buf, doc = text_bytes(spaced)
    ok, found = np.diff(doc) > 1, []
    for side in (left, right):
        told = side.tokens(spaced)
        of = np.repeat(np.arange(len(texts)), told.counts)
        sizes = side.vocabulary.sizes[told.ids]
        ok &= np.bincount(of, sizes, len(texts)).astype(np.int64) == np.diff(doc)
        found.append((side, told.ids, of))
    for side, ids, of in found:
        whole = np.repeat(ok, np.diff(doc))
        differ = np.zeros(len(buf), bool)
        differ[whole] = side.vocabulary.joined(ids[ok[of]]) != buf[whole]
        ok &= sum_by(differ, doc) == 0
    (_, a, of_a), (_, b, of_b) = ((side, ids[ok[of]], of[ok[of]]) for side, ids, of in found)
    ends = np.cumsum(np.diff(doc)[ok])
    ea, eb = np.cumsum(left.vocabulary.sizes[a]), np.cumsum(right.vocabulary.sizes[b])
    cuts = [0]
    if len(a) > most:
        common = np.intersect1d(ea, eb, assume_unique=True)
        while cuts[-1] < len(ea) and cuts[-1] + most < len(ea):
            cuts.append(int(np.searchsorted(ea, common[np.searchsorted(common, ea[cuts[-1] + most - 1])])) + 1)
    cuts = sorted({*cuts, len(ea)})
    numbers = np.flatnonzero(ok)
    for x, y in zip(cuts, cuts[1:], strict=False):
        low, high = int(ea[x - 1]) if x else 0, int(ea[y - 1])
        p, q = np.searchsorted(eb, [low, high], side="right")
        spans = []
        for k in range(int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(ends, high)) + 1):
            s, e = max(low, int(ends[k - 1]) if k else 0), min(high, int(ends[k]))
            (i, j), (u, v) = np.searchsorted(ea, [s, e], side="right"), np.searchsorted(eb, [s, e], side="right")
            spans.append((int(numbers[k]), s, e, int(j - i), int(v - u), e == int(ends[k])))
        yield Part(ea[x:y], a[x:y], eb[p:q], b[p:q], spans)


def _duck():
    import duckdb

    return process_cache("align duckdb", lambda: duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}))


LINKS = """
CREATE OR REPLACE TEMP TABLE links AS SELECT a.e, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.e >= b.e WHERE a.e = b.e;
CREATE OR REPLACE TEMP TABLE told AS SELECT d.doc, (l.a::BIGINT << 32) | l.b AS pair, count(*) AS n FROM links l ASOF JOIN d ON l.e <= d.e GROUP BY ALL
"""
#: A side's tokens in order: whether its group ends with it, and how many groups ended before. Without an order of its own
#: the window runs over the rows as they come, which they do in order; groups_text() checks that.
NUMBERED = """
SELECT e, id, cut, (sum(cut) OVER ({order}ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - cut AS g
FROM (SELECT t.e, t.id, (l.e IS NOT NULL)::INT AS cut FROM {side} t LEFT JOIN links l ON l.e = t.e ORDER BY t.e) t
"""
#: Decimal ids, each with room for what stands behind it.
_DECIMALS: dict[int, Vocabulary] = {}


def _decimals(most: int) -> Vocabulary:
    if most not in _DECIMALS:
        _DECIMALS[most] = Vocabulary([b"%d," % i for i in range(most)])
    return _DECIMALS[most]


def _numbered(con, side: str) -> dict[str, np.ndarray]:
    told = con.execute(NUMBERED.format(side=side, order="")).fetchnumpy()
    if (np.diff(told["e"]) <= 0).any():
        told = con.execute(NUMBERED.format(side=side, order="ORDER BY e ") + " ORDER BY e").fetchnumpy()
    return told


def groups_text(con, n_left: int, n_right: int) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The groups of a part as text, `a1,a2|b1;` one after the other; where each token begins there (tokens group by group, left before right), and its group."""
    left, right = (_numbered(con, side) for side in ("a", "b"))
    counts = [np.bincount(side["g"], minlength=int(left["g"][-1]) + 1) for side in (left, right)]
    before = [np.cumsum(c) - c for c in counts]
    n, place = len(left["g"]) + len(right["g"]), []
    place = [np.arange(len(left["g"])) + before[1][left["g"]], np.arange(len(right["g"])) + (before[0] + counts[0])[right["g"]]]
    size, group = np.empty(n, np.int64), np.empty(n, np.int64)
    words = [_decimals(n_left), _decimals(n_right)]
    for side, at, word in zip((left, right), place, words, strict=True):
        size[at], group[at] = word.sizes[side["id"]], side["g"]
    first = np.append(0, np.cumsum(size))
    out = np.empty(int(first[-1]), np.uint8)
    for side, at, word, end in zip((left, right), place, words, b"|;", strict=True):
        for x in range(0, len(at), 100_000):
            some, ids = at[x : x + 100_000], side["id"][x : x + 100_000]
            out[np.repeat(first[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())] = word.joined(ids)
        out[first[at[side["cut"] > 0] + 1] - 1] = end
    return memoryview(out), first, group


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_TOLD = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[k]) for n, k in (c.split() for c in TOLD.split(", "))])


def _told(part: pa.RecordBatch, left: ByteSide, right: PieceSide, most: int) -> Iterator[pa.RecordBatch]:
    """Of a chunk of rows: links by document (kind 1), by chunk (kind 2), then the documents (kind 0)."""
    con = _duck()
    n = part.num_rows
    count = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    digests, running = [""] * n, hashlib.sha256()
    rows = part.column("row").to_numpy()
    for piece in parts(part.column("text"), left, right, most):
        piece.tables(con)
        for sql in LINKS.split(";"):
            con.execute(sql)
        by_doc = con.execute("SELECT doc, pair, n FROM told ORDER BY doc").fetchnumpy()
        np.add.at(count["n_links"], by_doc["doc"], by_doc["n"])
        yield _batch({"kind": np.full(len(by_doc["n"]), 1), "row": rows[by_doc["doc"]], "pair": by_doc["pair"], "n": by_doc["n"]}, _TOLD)
        pairs = con.execute("SELECT pair, sum(n)::BIGINT AS n FROM told GROUP BY pair").fetchnumpy()
        yield _batch({"kind": np.full(len(pairs["n"]), 2), "pair": pairs["pair"], "n": pairs["n"]}, _TOLD)
        data, at, g = groups_text(con, len(left.vocabulary.sizes), len(right.vocabulary.sizes))
        first = 0
        for doc, _, _, n_a, n_b, ended in piece.spans:
            last = first + n_a + n_b
            running.update(data[at[first] : at[last] - ended])
            count["n_a"][doc] += n_a
            count["n_b"][doc] += n_b
            count["n_groups"][doc] += g[last - 1] - g[first] + 1
            if ended:
                digests[doc], running = running.hexdigest(), hashlib.sha256()
            first = last
    yield _batch({"kind": np.zeros(n, np.int32), "row": rows, "doc_id": part.column("doc_id"), **count, "groups_sha256": digests}, _TOLD)
    for name in ("a", "b", "d", "links", "told"):
        con.execute(f"DROP TABLE IF EXISTS {name}")


def _chunked(docs: DataFrame, left: str | None, right: str | None, work: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(left, right)
        for batch in batches:
            for part in text_chunks(batch, "text", CHUNK):
                yield from work(part, a, b)

    return with_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema)


def align(docs: DataFrame, left: str | None = None, right: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS, part_tokens: int = PART_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). pairs: a_id, b_id, links (how often the two ids end together in all docs), best (the most of its b_id).

    documents has a row for each of docs: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is its
    b_id's best, ties included), count_sum (links of the corpus over this document's), groups_sha256 (of its groups,
    `a1,a2|b1;a3|b2`). Texts that are null, empty or not given back by both tokenizers have zeros and no digest.
    Repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    told = materialize(_chunked(docs, left, right, lambda part, a, b: _told(part, a, b, part_tokens), TOLD, id_col, text_col), "aligned")
    merged = told.where("kind = 2").groupBy("pair").agg(F.sum("n").alias("links"))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # A right id has at most as many pairs as the left vocabulary has entries.
    counted = materialize(merged.withColumn("best", F.max("links").over(Window.partitionBy(b_id))), "pairs")
    of_docs = told.where("kind = 1").select("row", "pair", "n")
    if counted.count() <= most_pairs:
        met = of_docs.join(F.broadcast(counted), "pair")
    else:
        met = salted_join(of_docs, counted, "pair", ["row"], "inner", SALTS)
    scored = met.groupBy("row").agg(F.sum(F.when(F.col("links") == F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    documents = told.where("kind = 0").join(scored, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    pairs = counted.select(F.shiftright("pair", 32).cast("int").alias("a_id"), b_id.cast("int").alias("b_id"), "links", "best")
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), pairs


#: The first right token that a left one meets is that which holds its first byte; the others begin inside it.
MET = """
WITH met AS (SELECT a.i, b.i AS j, a.id AS a, b.id AS b, a.s, greatest(a.s, b.s) AS f, least(a.e, b.e) AS t FROM a ASOF JOIN b ON a.s >= b.s
  UNION ALL SELECT a.i, b.i, a.id, b.id, a.s, b.s, least(a.e, b.e) FROM a JOIN b ON b.s > a.s AND b.s < a.e)
SELECT d.doc, i, j, a, b, f - d.s AS f, t - d.s AS t FROM met JOIN d ON met.s >= d.s AND met.s < d.e ORDER BY i, j
"""


def overlaps(docs: DataFrame, left: str | None = None, right: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = PART_TOKENS) -> DataFrame:
    """Every pair of a left and a right token that share bytes: their numbers in the document, ids, and the bytes of space + text that they share."""
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64()}[k]) for n, k in (c.split() for c in OVERLAPS.split(", "))])

    def work(part: pa.RecordBatch, a: ByteSide, b: PieceSide) -> Iterator[pa.RecordBatch]:
        con, before, now = _duck(), np.zeros(3, np.int64), -1
        ids = part.column("doc_id").to_pylist()
        for piece in parts(part.column("text"), a, b, part_tokens):
            piece.tables(con)
            found = con.execute(MET).fetchnumpy()
            # Numbers and bytes of a part count from its start: bring them to their document's.
            at, shift = np.zeros(2, np.int64), {}
            for doc, s, e, n_a, n_b, _ in piece.spans:
                before = before if doc == now else np.zeros(3, np.int64)
                shift[doc], now = (before[0] - at[0], before[1] - at[1], before[2]), doc
                at, before = at + (n_a, n_b), before + (n_a, n_b, e - s)
            move = np.array([shift[x] for x in found["doc"].tolist()], np.int64).reshape(-1, 3)
            yield _batch({"doc_id": [ids[x] for x in found["doc"].tolist()], "a_index": found["i"] + move[:, 0], "b_index": found["j"] + move[:, 1], "a_id": found["a"], "b_id": found["b"], "start": found["f"] + move[:, 2], "end": found["t"] + move[:, 2]}, schema)

    return _chunked(docs, left, right, work, OVERLAPS, id_col, text_col)
