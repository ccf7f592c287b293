"""Column-at-a-time word splitting and n-gram hashing over Arrow text, in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _bytes_in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Separators of plain words, and those of bare words, which also end at ASCII punctuation.
SPACE = _bytes_in(b"\x20\x09\x0a\x0b\x0c\x0d")
PUNCTUATION = SPACE | _bytes_in(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'_"))


@dataclass
class Words:
    """Words of a chunk of texts.

    buf: bytes of all texts; doc: byte offsets of the texts (n + 1); start, size: byte span of each word in buf;
    bounds: word index where each text starts (n + 1); codes: index of each word in vocab; vocab: the distinct words.
    """

    buf: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    bounds: np.ndarray
    codes: np.ndarray
    vocab: pa.LargeBinaryArray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the byte offset of each text; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def lowered(buf: np.ndarray, ascii_only: bool = True) -> np.ndarray:
    """A-Z as a-z; also the capitals of U+00C0 to U+00DE unless ascii_only."""
    out = buf + np.where((buf >= 65) & (buf <= 90), 32, 0).astype(np.uint8)
    if not ascii_only and len(buf) > 1:
        high = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][high] += 32
    return out


def split_words(buf: np.ndarray, doc: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    solid = ~separators[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[doc] = True
    first, last = solid.copy(), solid.copy()
    if len(buf):
        first[1:] &= ~solid[:-1] | edge[1 : len(buf)]
        last[:-1] &= ~solid[1:] | edge[1 : len(buf)]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(buf[solid])])
    coded = words.dictionary_encode()
    return Words(buf, doc, start, size, np.searchsorted(start, doc), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; empty runs sum to 0. Of a mask: how often it is true."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each item, the index of the run it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def characters(buf: np.ndarray) -> np.ndarray:
    """Number of code points before each byte offset (length + 1)."""
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
    return total


def word_hashes(vocab: pa.LargeBinaryArray) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) for w in vocab.to_pylist()), np.uint32, len(vocab))


@dataclass
class Padded:
    """Distinct words with a start and an end mark each, laid end to end; at: n + 1 offsets."""

    buf: np.ndarray
    at: np.ndarray


def padded(vocab: pa.LargeBinaryArray) -> Padded:
    n = len(vocab)
    if not n:
        return Padded(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(vocab.buffers()[1], np.int64)[vocab.offset : vocab.offset + n + 1]
    data = np.frombuffer(vocab.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0] + 2 * np.arange(n + 1)
    out = np.empty(at[-1], np.uint8)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    out[at[:-1]], out[at[1:] - 1] = 2, 3
    out[inner] = data
    return Padded(out, at)


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def char_ngrams(words: Padded, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-byte gram within a padded word, and the bounds of each word's grams."""
    size = len(words.buf)
    if size < n:
        return np.zeros(0, np.int64), np.zeros(len(words.at), np.int64)
    h = np.full(size - n + 1, n, np.uint32)
    for j in range(n):
        h = h * np.uint32(16777619) ^ words.buf[j : size - n + 1 + j]
    whole = np.ones(size, bool)
    for j in range(min(n - 1, size)):
        whole[np.maximum(words.at[1:] - 1 - j, 0)] = False
    count = np.zeros(size + 1, np.int64)
    np.cumsum(whole, out=count[1:])
    return _mix(h, bits)[whole[: size - n + 1]], count[words.at]


def edge_grams(words: Padded, n: int, bits: int, tail: bool = False) -> np.ndarray:
    """Bucket of each padded word's first (or last) n bytes; -1 for words that are shorter."""
    long = np.diff(words.at) >= n
    h = np.full(len(words.at) - 1, n + 100 * tail, np.uint32)
    begin = np.where(long, words.at[1:] - n if tail else words.at[:-1], 0)
    for j in range(n):
        h = h * np.uint32(16777619) ^ (words.buf[np.minimum(begin + j, len(words.buf) - 1)] if len(words.buf) else h)
    return np.where(long, _mix(h, bits), -1)


def word_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return _mix(hashes, bits)


def pair_buckets(hashes: np.ndarray, codes: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each pair of neighbouring words within a text, and the text it belongs to."""
    h = hashes[codes]
    inside = np.ones(max(len(h) - 1, 0), bool)
    cut = bounds[1:-1]
    inside[cut[(cut > 0) & (cut < len(h))] - 1] = False
    both = _mix(h[:-1] * np.uint32(16777619) ^ (h[1:] + np.uint32(0x9E3779B9)), bits)
    return both[inside], owner(bounds)[:-1][inside]
