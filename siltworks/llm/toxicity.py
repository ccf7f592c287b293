"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training: the labels are of whole documents, so tokens are labelled first. A greedy cover picks the token features
(whole words, word beginnings and endings) that occur in toxic documents and hardly in others; tokens of toxic
documents with such a feature are labelled toxic, and all other tokens are not. The field learns from windows of these
labelled tokens. Scoring: forward-backward gives each token's probability of being toxic; a document's score is the
calibrated noisy-or over its tokens, and runs of tokens with probability >= 0.5 are the offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from siltworks.llm import chains
from siltworks.llm.chains import marginals
from siltworks.llm.common import text_chunks, with_text
from siltworks.llm.textcols import PUNCTUATION, Words, characters, edge_grams, lowered, owner, padded, split_words, sum_by, text_bytes, word_buckets, word_hashes
from siltworks.llm.training import calibration_rows, fit_platt, labelled_sample, sigmoid

#: Buckets of hashed token features, as a power of two.
BITS = 18
HEADS, TAILS = (3, 4, 5, 6, 7), (4,)
#: Bound of the labelled sample: rows and characters a text.
TRAIN_ROWS, TRAIN_CHARS = 4000, 20_000
#: A feature labels tokens if at least this share of the documents that hold it is toxic, and this many are.
MIN_PRECISION, MIN_DOCS = 0.95, 4
#: Features of so many toxic documents label tokens whether or not the cover needs them.
SURE_PRECISION, SURE_DOCS = 0.98, 12
#: Tokens below this probability do not count towards a document's score, so that long texts don't add up noise.
FLOOR = 0.05
WINDOW = 24

SCHEMA = "doc_id long, score double, predicted int, n_spans long, spans string"


def tokens(texts: pa.Array) -> Words:
    """Lower-cased words without ASCII punctuation."""
    buf, doc = text_bytes(texts)
    return split_words(lowered(buf, ascii_only=False), doc, PUNCTUATION)


def _vocab_features(w: Words) -> np.ndarray:
    """Feature buckets of each distinct word, -1 where the word is too short."""
    marked = padded(w.vocab)
    return np.stack([word_buckets(word_hashes(w.vocab), BITS), *(edge_grams(marked, n, BITS) for n in HEADS), *(edge_grams(marked, n, BITS, tail=True) for n in TAILS)], axis=1) if len(w.vocab) else np.zeros((0, 1 + len(HEADS) + len(TAILS)), np.int64)


@dataclass
class ToxicityModel:
    """emit: log-odds of the toxic state by feature bucket (ids maps buckets to rows); trans, start: of the field; a, b: calibration."""

    ids: np.ndarray
    emit: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    a: float
    b: float

    def token_probability(self, w: Words) -> np.ndarray:
        weights = np.append(self.emit, 0.0)
        each = weights[_lookup(self.ids, _vocab_features(w))].sum(axis=1) if len(w.vocab) else np.zeros(0)
        score = each[w.codes]
        first = np.zeros(len(score), bool)
        first[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
        return marginals(np.stack([np.zeros(len(score)), score], axis=1), self.trans, self.start, first)[:, 1]

    def document_score(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * evidence(p, bounds) + self.b)


def evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log-odds of a noisy-or over tokens, within [-10, 10]; -10 for texts without tokens."""
    none = sum_by(np.where(p >= FLOOR, np.log1p(-np.minimum(p, 1 - 1e-9)), 0.0), bounds)
    some = -np.expm1(np.minimum(none, -1e-12))
    return np.clip(np.log(some) - none, -10, 10)


def _lookup(ids: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Row of each feature in ids, or the row past the last for features unseen in training."""
    at = np.minimum(np.searchsorted(ids, features), len(ids) - 1) if len(ids) else np.zeros(features.shape, np.int64)
    return np.where(ids[at] == features, at, len(ids)) if len(ids) else np.zeros(features.shape, np.int64)


def _label_words(w: Words, features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which distinct words are toxic where they stand in a toxic text: a greedy cover of the toxic documents.

    features: _vocab_features(w). Works through the texts a few at a time, so memory follows the features, not the tokens.
    """
    size = 1 << BITS

    def cells(step: int = 100) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for at in range(0, len(y), step):
            to = min(at + step, len(y))
            codes, of = w.codes[w.bounds[at] : w.bounds[to]], owner(w.bounds[at : to + 1] - w.bounds[at])
            seen = np.unique((of[:, None] * size + features[codes])[features[codes] >= 0])
            yield at, seen // size, seen % size

    hits, seen = np.zeros(size), np.zeros(size)
    for at, doc, feat in cells():
        seen += np.bincount(feat, minlength=size)
        hits += np.bincount(feat, weights=y[at + doc], minlength=size)
    good = (hits >= MIN_DOCS) & (hits >= MIN_PRECISION * seen)
    parts = [(at + doc[keep], feat[keep]) for at, doc, feat in cells() for keep in [good[feat] & (y[at + doc] > 0)]]
    doc, feat = (np.concatenate(c) for c in zip(*parts, strict=True))
    chosen = (hits >= SURE_DOCS) & (hits >= SURE_PRECISION * seen)
    while len(doc):
        gain = np.bincount(feat, minlength=size)
        best = int(np.argmax(gain))
        if gain[best] < MIN_DOCS:
            break
        chosen[best] = True
        covered = np.zeros(len(y), bool)
        covered[doc[feat == best]] = True
        left = ~covered[doc]
        doc, feat = doc[left], feat[left]
    return np.where(features >= 0, chosen[features], False).any(axis=1)


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, rows: int = TRAIN_ROWS, max_chars: int = TRAIN_CHARS) -> ToxicityModel:
    """Fit on at most `rows` labelled texts; where: which rows of labels may be used. Without toxic labels all scores are low.

    A fifth of the texts serves calibration only, unless the others hold no toxic one.
    """
    sample = labelled_sample(with_text(docs), labels, "toxic", rows, max_chars, where)
    held = calibration_rows(sample)
    if not sample.column("y").to_numpy()[~held].any():
        held[:] = False
    spare = sample.filter(pa.array(held)) if held.any() else sample
    sample = sample.filter(pa.array(~held))
    y = sample.column("y").to_numpy().astype(np.int64)
    empty = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), np.zeros((2, 2)), np.array([0.0, -6.0]), 1.0, 0.0)
    if not y.any():
        return ToxicityModel(empty.ids, empty.emit, np.array([[0.0, -6.0], [0.0, -6.0]]), empty.start, 1.0, 0.0)
    w = tokens(sample.column("text").combine_chunks())
    features = _vocab_features(w)
    of = owner(w.bounds)
    toxic = _label_words(w, features, y)[w.codes] & (y[of] > 0)
    # Windows around toxic tokens, as many from texts that are not toxic, and others by a fixed stride.
    centre = np.concatenate([np.flatnonzero(toxic)[:: max(1, int(toxic.sum() // 2500))], np.flatnonzero(y[of] == 0)[:: max(1, int((y[of] == 0).sum() // 2500))]])
    centre = np.unique(centre // WINDOW) * WINDOW
    at = centre[:, None] + np.arange(WINDOW)
    inside = at < len(of)
    at = np.minimum(at, len(of) - 1)
    inside &= of[at] == of[at[:, :1]]
    ids = np.unique(features[w.codes[at[inside]]])
    ids = ids[ids >= 0]
    rows_of = np.where(inside[:, :, None], _lookup(ids, features[w.codes[at]]), len(ids))
    weights, trans, start = chains.train(np.where(rows_of == len(ids), -1, rows_of), toxic[at].astype(np.int64), inside, len(ids), 2, rounds=60)
    emit = weights[:-1, 1] - weights[:-1, 0]
    kept = np.abs(emit) > 1e-3
    model = ToxicityModel(ids[kept], emit[kept], trans, start, 1.0, 0.0)
    each = [evidence(model.token_probability(t), t.bounds) for batch in spare.combine_chunks().to_batches() for part in text_chunks(batch, "text", 1 << 20) for t in [tokens(part.column("text"))]]
    a, b = fit_platt(np.concatenate(each), spare.column("y").to_numpy().astype(float))
    model.a, model.b = max(a, 0.05), b
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score, verdict and offending spans (start:end in code points, comma-joined) of every text.

    Null and empty texts have no tokens and get the lowest score. Repeated rows are scored each. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                w = tokens(part.column("text"))
                p = model.token_probability(w)
                total = model.document_score(p, w.bounds)
                hot = np.flatnonzero(p >= 0.5)
                spans: list[list[str]] = [[] for _ in range(part.num_rows)]
                if len(hot):
                    chars, of = characters(w.buf), owner(w.bounds)
                    new = np.flatnonzero(np.append(True, (np.diff(hot) > 1) | (np.diff(of[hot]) > 0)))
                    for i, j in zip(new, np.append(new[1:], len(hot)) - 1, strict=True):
                        d, a, z = of[hot[i]], w.start[hot[i]], w.start[hot[j]] + w.size[hot[j]]
                        spans[d].append(f"{chars[a] - chars[w.doc[d]]}:{chars[z] - chars[w.doc[d]]}")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total), pa.array((total >= 0.5).astype(np.int32)), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(s) for s in spans], pa.string())], names=["doc_id", "score", "predicted", "n_spans", "spans"])

    return with_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
