"""Quality rules: fixed base rules, then a hashed n-gram logistic regression.

Features of a text are the shares of hashed words, word pairs and character 1- to 4-grams (within words, with marks at
both ends) among its words. The model is linear in them, so a word's contribution is worked out once for each distinct
word of a chunk and then looked up. The raw score is calibrated on held-out rows; a document is kept if the calibrated
probability of good quality is at least KEEP_AT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltworks.llm.common import frugal, text_chunks, with_text
from siltworks.llm.textcols import Words, char_ngrams, owner, padded, pair_buckets, split_words, sum_by, text_bytes, word_buckets, word_hashes
from siltworks.llm.training import calibration_rows, fit_logistic, fit_platt, labelled_sample, sigmoid

#: Buckets of hashed features, as a power of two, for each of words, pairs and grams of one length.
BITS = 9
GRAMS = (1, 2, 3, 4)
#: Bound of the labelled sample: rows and characters a text.
TRAIN_ROWS, TRAIN_CHARS = 3000, 20_000
#: A document is kept from this probability on.
KEEP_AT = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """The base rules' counts of each text."""
    n = len(w.doc) - 1
    n_words = np.diff(w.bounds)
    solid = np.zeros(len(w.buf) + 1, np.int32)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.start + w.size, -1)
    inside = np.cumsum(solid[:-1]) > 0
    word_chars = sum_by(inside & ((w.buf & 0xC0) != 0x80), w.doc)
    n_symbols = sum_by(_SYMBOL[w.buf], w.doc)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": _dup_lines(w, n), "n_repeat_words": _repeat_words(w, n)}


def _dup_lines(w: Words, n: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    if not len(w.start):
        return np.zeros(n, np.int64)
    breaks = np.flatnonzero(w.buf == 10)
    begin = np.unique(np.concatenate([w.doc[:-1], breaks + 1]))
    begin = begin[begin < len(w.buf)]
    of = np.searchsorted(w.doc, begin, side="right") - 1
    end = np.minimum(np.append(begin[1:], len(w.buf)), w.doc[of + 1])
    end -= (end > begin) & (w.buf[np.maximum(end - 1, 0)] == 10)
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, of = begin[worded], end[worded], of[worded]
    data = w.buf.tobytes()
    codes = pa.array([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.unique(of * (codes.max(initial=0) + 1) + codes, return_index=True)[1]
    again = np.ones(len(of), bool)
    again[firsts] = False
    return np.bincount(of[again], minlength=n)


def _repeat_words(w: Words, n: int) -> np.ndarray:
    """Words inside 3-word windows that occur twice or more in their text."""
    total = len(w.codes)
    if total < 3:
        return np.zeros(n, np.int64)
    of = owner(w.bounds)
    at = np.flatnonzero(of[2:] == of[:-2])
    c = w.codes
    if len(w.vocab) < 1 << 21:
        key = (c[at] << 42) | (c[at + 1] << 21) | c[at + 2]
    else:
        pair = np.unique((c[at] << 32) | c[at + 1], return_inverse=True)[1]
        key = (pair << 32) | c[at + 2]
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_of = key[order], of[at][order]
    same = (sorted_key[1:] == sorted_key[:-1]) & (sorted_of[1:] == sorted_of[:-1])  # stable: windows of a text stay together
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(total, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    return sum_by(covered, w.bounds)


@dataclass
class QualityModel:
    """words, pairs: weights by bucket; grams: weights by length and bucket; a, b: calibration."""

    words: np.ndarray
    pairs: np.ndarray
    grams: dict
    bias: float
    a: float
    b: float

    def raw(self, w: Words) -> np.ndarray:
        hashes = word_hashes(w.vocab)
        each = self.words[word_buckets(hashes, BITS)]
        marked = padded(w.vocab)
        for n, weights in self.grams.items():
            buckets, bounds = char_ngrams(marked, n, BITS)
            each = each + sum_by(weights[buckets], bounds)
        total = sum_by(each[w.codes], w.bounds)
        buckets, of = pair_buckets(hashes, w.codes, w.bounds, BITS)
        total += np.bincount(of, weights=self.pairs[buckets], minlength=len(total))
        return self.bias + total / np.maximum(np.diff(w.bounds), 1)

    def probability(self, w: Words) -> np.ndarray:
        return sigmoid(self.a * self.raw(w) + self.b)


def _features(w: Words) -> np.ndarray:
    """Dense feature rows of the training texts."""
    n, size = len(w.doc) - 1, 1 << BITS
    out = np.zeros((n, size * (2 + len(GRAMS))), np.float32)
    hashes = word_hashes(w.vocab)
    of = owner(w.bounds)

    def put(block: int, rows: np.ndarray, buckets: np.ndarray) -> None:
        cells = np.bincount(rows * size + buckets, minlength=n * size)
        out[:, block * size : (block + 1) * size] = cells.reshape(n, size)

    put(0, of, word_buckets(hashes, BITS)[w.codes])
    buckets, rows = pair_buckets(hashes, w.codes, w.bounds, BITS)
    put(1, rows, buckets)
    marked = padded(w.vocab)
    for k, g in enumerate(GRAMS):
        buckets, bounds = char_ngrams(marked, g, BITS)
        counts = np.diff(bounds)[w.codes]
        first = np.repeat(bounds[:-1][w.codes] - np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64), counts)
        put(2 + k, np.repeat(of, counts), buckets[first + np.arange(len(first))])
    return out / np.maximum(np.diff(w.bounds), 1)[:, None].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS) -> QualityModel:
    """Fit on at most `rows` labelled texts; a fifth of them serves calibration only. Without labels every text is kept."""
    sample = labelled_sample(with_text(docs), labels, "quality", rows, max_chars)
    size = 1 << BITS
    if not sample.num_rows:
        return QualityModel(np.zeros(size), np.zeros(size), {g: np.zeros(size) for g in GRAMS}, 6.0, 1.0, 0.0)
    # Calibration rows last, so that both parts are views of one array.
    held = calibration_rows(sample)
    sample = sample.take(np.argsort(held, kind="stable"))
    y = sample.column("y").to_numpy().astype(float)
    x, at = np.zeros((len(y), size * (2 + len(GRAMS))), np.float32), 0
    for batch in sample.combine_chunks().to_batches():
        for part in text_chunks(batch, "text", 1 << 19):
            x[at : at + part.num_rows] = _features(split_words(*text_bytes(part.column("text"))))
            at += part.num_rows
    fit = len(y) - int(held.sum())
    w, bias = fit_logistic(x[:fit], y[:fit], 1e-5)
    w = w.astype(np.float64)
    a, b = fit_platt(x[fit:] @ w.astype(np.float32) + bias, y[fit:])
    return QualityModel(w[:size], w[size : 2 * size], {g: w[(2 + k) * size : (3 + k) * size] for k, g in enumerate(GRAMS)}, bias, max(a, 0.1), b)


def _judge(texts: pa.Array, model: QualityModel, keep_at: float) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base verdict, probability and verdict of each text."""
    w = split_words(*text_bytes(texts))
    counts = base_counts(w)
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    p = model.probability(w)
    return counts, failed, p, ~failed & (p >= keep_at)


def score(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, probability and verdict of every text.

    Null and empty texts have no words and fail the base rules. Repeated rows are scored each. Other columns are ignored.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                counts, failed, p, kept = _judge(part.column("text"), model, keep_at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(failed), pa.array(p), pa.array(kept)], names=["doc_id", *counts, "base_failed", "probability", "kept"])

    return with_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is kept, with all their columns; verdicts as in score()."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text_col):
                yield part.filter(pa.array(_judge(part.column(text_col), model, keep_at)[3]))

    return docs.mapInArrow(run, docs.schema)
