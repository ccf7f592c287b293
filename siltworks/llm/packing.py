"""Packing token sequences by best-fit decreasing.

A document's ids are cut into full windows; what remains is one shorter piece. Pieces are dealt into shards of about
SHARD_ROWS by a hash, so a shard's memory is bounded and a lost task repeats alone. Within a shard pieces go in order of
decreasing length to the open window with the least remaining room that still holds them; a segment tree over the
remaining room finds it in logarithmic time. Each shard leaves a few windows partly filled, whatever the corpus size.

Where documents have an order (a mix), shards are ranges of it instead, and sequences are numbered along it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import frugal, process_cache, text_chunks, with_text
from siltworks.llm.textcols import text_bytes

CAPACITY, END_ID = 2048, 1
SHARD_ROWS = 16_384
#: Documents whose pieces share a shard where their order counts: how far a piece may move from its place.
ORDERED_DOCS = 2048
PIECES = "doc_id long, piece long, start long, length long, doc_tokens long, ids binary"

#: Pieces of text whose ids a process keeps, the longest that it keeps in bytes, and bytes of text cut into pieces at once.
KEPT_PIECES, KEPT_BYTES, CUT_BYTES = 1 << 17, 64, 2 << 20
_BLANK, _LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BLANK[list(b"\x09\x0a\x0b\x0c\x0d\x20")] = True
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_SIGN[list(b".,;:!?\"')")] = True
#: Letters in every edition of Unicode. A piece of them, with a blank before it or not, is one match of the pattern.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_ONE_MATCH = re.compile(f" ?[{_LETTERS}]+")


def _after_other_blank(buf: np.ndarray) -> np.ndarray:
    """Offsets that follow a white-space character beyond ASCII (or the separators U+001C to U+001F)."""
    lead = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)) | ((buf >= 0x1C) & (buf <= 0x1F)))
    if not len(lead):
        return lead
    b0 = buf[lead]
    b1, b2 = buf[np.minimum(lead + 1, len(buf) - 1)], buf[np.minimum(lead + 2, len(buf) - 1)]
    two = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    three = ((b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)) | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)) | ((b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F))
    three |= (b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))
    return np.concatenate([lead[b0 < 0x20] + 1, lead[two] + 2, lead[three] + 3])


def piece_starts(buf: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Offsets at which texts may be cut without changing their ids: text starts, white space behind anything else, and
    .,;:!?"') behind A-Z or a-z.

    No match of a byte-level tokenizer's pattern holds white space behind another character or one of these signs behind
    a letter, none looks back, and the only one that looks ahead ends in white space. So each match lies within one
    piece and comes out the same there.
    """
    start = _BLANK[buf].copy()
    start[1:] &= ~_BLANK[buf[:-1]]
    start[1:] |= _SIGN[buf[1:]] & _LETTER[buf[:-1]]
    other = _after_other_blank(buf)
    start[other[other < len(buf)]] = False
    start[doc[:-1][doc[:-1] < len(buf)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of a tokenizers file. All ids are that library's; ids of short pieces of text are kept for the next time.

    Texts are cut into pieces (piece_starts) where the file has a byte-level pattern and no normalizer; each distinct
    piece is encoded once a batch, and one that is a single match by the file's model alone. With any other file, whole
    texts are encoded.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(0x180) if i == 32 or _ONE_MATCH.fullmatch(chr(i))}
        self.clear()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cut = told.get("pre_tokenizer") or {}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"""[\s.,;:!?"')]""", t["content"])) and re.search(f"[^{_LETTERS}]", t["content"]) for t in told.get("added_tokens", ()))
        self.cuts = plain and not told.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text]))[0]

    def clear(self) -> None:
        """kept: number of each kept piece; first, flat: where its ids begin, and the ids of all, end to end."""
        self.kept: dict[bytes, int] = {}
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _vocabulary(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where each piece's begin and how many they are."""
        if len(self.kept) > KEPT_PIECES:
            self.clear()
        number = np.fromiter(map(self.kept.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = sorted(np.flatnonzero(number < 0).tolist(), key=lambda i: len(pieces[i]) > KEPT_BYTES)
        texts = [pieces[i].decode() for i in new]
        found = [[t.id for t in self.model.tokenize(text.translate(self.mapped))] if _ONE_MATCH.fullmatch(text) else None for text in texts]
        rest = [k for k, f in enumerate(found) if f is None]
        for k, e in zip(rest, self.full.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        number[new] = np.arange(len(self.first) - 1, len(self.first) - 1 + len(new))
        first = np.append(self.first, self.first[-1] + np.cumsum([len(f) for f in found], dtype=np.int64))
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32)])
        short = sum(len(pieces[i]) <= KEPT_BYTES for i in new)  # these come first
        self.kept.update((pieces[i], int(number[i])) for i in new[:short])
        self.first = first[: len(self.first) + short]
        self.flat = flat[: self.first[-1]]
        return flat, first[number], first[number + 1] - first[number]

    def _cut_ids(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of buf, and the number of each piece's."""
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf))), pa.py_buffer(buf)]).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        flat, first, sizes = self._vocabulary(words.dictionary.to_pylist())
        each = sizes[codes]
        at = np.repeat(first[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return flat[at], each

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an array without nulls."""
        if not self.cuts:
            return [np.array(e.ids, np.uint32) for e in self.full.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        buf, doc = text_bytes(texts)
        starts = piece_starts(buf, doc)
        ids, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + CUT_BYTES)))
            end = int(starts[to]) if to < len(starts) else len(buf)
            some, each = self._cut_ids(buf[starts[at] : end], starts[at:to] - starts[at])
            ids.append(some)
            counts.append(each)
            at = to
        before = np.append(0, np.cumsum(np.concatenate(counts)))
        return np.split(np.concatenate(ids), before[np.searchsorted(starts, doc[1:-1])]) if len(doc) > 1 else []


def encoder(path: str | None = None) -> Encoder:
    """By default the installed public byte-level vocabulary; loaded once in each process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers as P

        path = P.path("byte_bpe_50k.json")
    return process_cache(f"encoder {path}", lambda: Encoder(path))


def tokenize(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """Pieces of every text: full windows, then the rest. ids: little-endian unsigned 32-bit; piece numbers rows of the input.

    Null and empty texts have the end id alone. Repeated rows have pieces of their own. carry: a column that pieces
    have too, as a string named carried. Other columns are ignored.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in text_chunks(batch, "text", CUT_BYTES):
                rows: list[tuple] = []
                carried = part.column("carried").to_pylist() if carry else [None] * part.num_rows
                for doc, row, extra, found in zip(part.column("doc_id").to_pylist(), part.column("piece").to_pylist(), carried, encode.batch(part.column("text")), strict=True):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        cut = ids[start : start + capacity]
                        rows.append((doc, row, start, len(cut), len(ids), cut.tobytes(), extra))
                cols = list(zip(*rows, strict=True))
                more = [pa.array(cols[6], pa.string())] if carry else []
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary()), *more], names=["doc_id", "piece", "start", "length", "doc_tokens", "ids", "carried"][: 6 + len(more)])

    texts = with_text(docs, id_col, text_col, F.col(carry).cast("string").alias("carried")) if carry else with_text(docs, id_col, text_col)
    return texts.withColumn("piece", F.monotonically_increasing_id()).mapInArrow(run, PIECES + (", carried string" if carry else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; lengths fall and lie within 1 to capacity."""
    leaves = 1 << (capacity).bit_length()
    tree = [0] * (2 * leaves)  # how many open windows have their remaining room in a node's range
    open_at: dict[int, list[int]] = {}
    used: list[int] = []
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def add(room: int, by: int) -> None:
        node = room + leaves
        while node:
            tree[node] += by
            node >>= 1

    for i, need in enumerate(lengths.tolist()):
        node = need + leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up to where a right neighbour has an open window
                node >>= 1
            node = node + 1 if node > 1 else 0
            while 0 < node < leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        if node:
            room = node - leaves
            w = open_at[room].pop()
            add(room, -1)
        else:
            room, w = capacity, len(used)
            used.append(0)
        window[i], offset[i] = w, used[w]
        used[w] += need
        if room > need:
            open_at.setdefault(room - need, []).append(w)
            add(room - need, 1)
    return window, offset


def pack(pieces: DataFrame, rows: int, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, order: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ...); other columns travel along.

    rows: about how many pieces there are; it sets the number of shards. Results depend on the pieces alone, not on
    their order, so that a repeated task gives the same. Pieces must be 1 to capacity long.

    order: a column with the gapless position (from 0) of the piece's document. Each ORDERED_DOCS documents in a row then
    make a shard, whatever rows and shard_rows are, and sequences are numbered by shard, then by their earliest document.
    """
    if {"sequence_id", "offset", "_shard"} & set(pieces.columns):
        raise ValueError("pieces already have sequence_id, offset or _shard")
    shards = max(1, -(-rows // shard_rows))
    shard = F.pmod(F.xxhash64("piece", "start"), F.lit(shards)) if order is None else F.floor(F.col(order) / ORDERED_DOCS).cast("bigint")
    dealt = pieces.withColumn("_shard", shard)
    names = [*pieces.columns, "sequence_id", "offset"]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch], shard: int) -> list[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            window, offset = best_fit(whole.column("length").to_numpy(), capacity)
            if order is not None:
                first = np.full(window.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(first, window, whole.column(order).to_numpy())
                number = np.empty(len(first), np.int64)
                number[np.argsort(first, kind="stable")] = np.arange(len(first))
                window = number[window]
            out = whole.drop_columns(["_shard"]).append_column("sequence_id", pa.array(window + (shard << 32))).append_column("offset", pa.array(offset))
            return out.select(names).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        now = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("_shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if ids[a] != now and held:
                    yield from done(held, now)
                    held = []
                now = int(ids[a])
                held.append(batch.slice(a, z - a))
        if held:
            yield from done(held, now)

    ordered = dealt.repartition(F.col("_shard")).sortWithinPartitions("_shard", F.desc("length"), "doc_id", "piece", "start")
    return ordered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")
