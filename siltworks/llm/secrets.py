"""Secret scan: three base patterns, and a character convolutional network over every candidate with its context.

Base spans (leftmost, non-overlapping, failing matches dropped):

    assign  (password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)   group 2 of 6+ characters
    access  AKIA[A-Z0-9]+                                                                      20+ characters
    hex     [0-9a-f]+                                                                          24+ characters

Candidates are the base spans and every further run of 16+ characters [A-Za-z0-9+/_=-] that mixes letters and digits.
The network reads 48 characters of a candidate (for assign: of the value), 24 characters before them and 8 after the candidate.
Longer candidates are read in windows that begin every 24 characters, up to their end, and the largest probability counts.
It is trained on generated labelled findings (labelled_findings), calibrated on held-out ones, and its threshold is the highest that keeps MIN_RECALL
of the held-out secrets, all by first windows: further windows only add to what is found. Candidates that are no base span and reach the threshold are added as kind "cnn".
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from siltworks.llm.common import frugal, process_cache, text_chunks, with_text
from siltworks.llm.training import fit_platt, sigmoid

KINDS = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_confirmed long, n_added long"
BEFORE, INSIDE, AFTER = 24, 48, 8
#: Characters from one window of a long candidate to the next, and windows scored at once.
STEP, AT_ONCE = 24, 4096
WIDTH, FILTERS, CLASSES = 5, 16, 40
#: Share of held-out secrets that the threshold must keep, and size of the labelled table.
MIN_RECALL, FINDINGS = 0.98, 2400

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = 16
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Texts without a match of this have no base span and no candidate.
_ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA|[A-Za-z0-9+/_=-]{16}"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    found = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def more_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, bool, bool]]:
    """What of each run lies outside base spans: (start, end, whether a base span stands before, behind) of parts of LEAST
    characters or more with a letter and a digit.

    Signs at a cut are no part of what remains: they join it to the base span, whose own characters are no context.
    """
    starts, ends = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    out = []
    for m in _RUN.finditer(text):
        a, z = m.span()
        k = bisect_right(ends, a)
        while a < z:
            to = min(z, starts[k]) if k < len(starts) else z
            end = to
            while end < z and end > a and not text[end - 1].isalnum():
                end -= 1
            part = text[a:end]
            if end - a >= LEAST and any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
                out.append((a, end, a > m.start(), end < z))
            if to == z:
                break
            a = max(a, ends[k])
            k += 1
            while a < z and not text[a].isalnum():
                a += 1
    return out


# ---- the network ---------------------------------------------------------------------------------------------------
def _classes() -> np.ndarray:
    """Class of each character below 128: signs one by one where they matter, letters and digits in small groups."""
    table = np.full(129, 1, np.int64)  # 0: nothing there, 1: any other character
    for i, group in enumerate(("abcdef", "ghijklm", "nopqrstuvwxyz", "ABCDEF", "GHIJKLM", "NOPQRSTUVWXYZ", "01", "2345", "6789", " ", "\n\t\r", '"', "'", "=", ":", "+", "/", "_", "-", ".", ",", "@", "()", "[]", "{}", "<>", "#", "$", "%", "&|", "*", ";", "!?")):
        for c in group:
            table[ord(c)] = i + 2
    return table


_CLASS = _classes()


def encode(text: str, start: int, end: int) -> list[int]:
    """Character classes of the window; the three parts are padded each, so a part's positions mean the same everywhere."""
    code = lambda s: [int(_CLASS[min(ord(c), 128)]) for c in s]
    before, inside, after = text[max(0, start - BEFORE) : start], text[start : min(end, start + INSIDE)], text[end : end + AFTER]
    return [0] * (BEFORE - len(before)) + code(before) + code(inside) + [0] * (INSIDE - len(inside)) + code(after) + [0] * (AFTER - len(after))


def windows(text: str, start: int, end: int) -> Iterator[list[int]]:
    """encode() of each window of a candidate; together they hold all of its characters."""
    yield encode(text, start, end)
    while end - start > INSIDE:
        start += STEP
        yield encode(text, start, end)


@dataclass
class SecretModel:
    """conv: [WIDTH, CLASSES, FILTERS]; the dense layer sees each filter's maximum over the three parts and the share of the candidate filled."""

    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> tuple:
        n, length = x.shape
        ends = np.pad(x, ((0, 0), (WIDTH // 2, WIDTH // 2)))
        h = np.zeros((n, length, FILTERS)) + self.conv_bias
        for j in range(WIDTH):
            h += self.conv[j][ends[:, j : j + length]]
        parts = ((0, BEFORE), (BEFORE, BEFORE + INSIDE), (BEFORE + INSIDE, length))
        where = [p[0] + np.argmax(h[:, p[0] : p[1]], axis=1) for p in parts]
        top = np.concatenate([np.take_along_axis(h, w[:, None, :], axis=1)[:, 0] for w in where] + [h[:, BEFORE : BEFORE + INSIDE].clip(0).mean(axis=1)], axis=1)
        filled = (x[:, BEFORE : BEFORE + INSIDE] > 0).mean(axis=1, keepdims=True)
        seen = np.concatenate([np.maximum(top, 0), filled], axis=1)
        return seen @ self.dense + self.bias, seen, h, where, ends

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = [sigmoid(self.a * self.forward(x[i : i + 512])[0] + self.b) for i in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def highest(self, candidates: Iterable[tuple[str, int, int]]) -> np.ndarray:
        """The largest probability over each candidate's windows; candidates are (text, start, end)."""
        best: list[float] = []
        of: list[int] = []
        held: list[list[int]] = []

        def score() -> None:
            for i, p in zip(of, self.probability(np.array(held, np.int64).reshape(len(held), BEFORE + INSIDE + AFTER)).tolist(), strict=True):
                best[i] = max(best[i], p)
            of.clear()
            held.clear()

        for text, start, end in candidates:
            best.append(0.0)
            for window in windows(text, start, end):
                of.append(len(best) - 1)
                held.append(window)
                if len(held) == AT_ONCE:
                    score()
        score()
        return np.array(best)


def labelled_findings(size: int = FINDINGS, seed: int = 5) -> list[tuple[str, int, int, int]]:
    """The labelled table: (text, start, end, is a secret), from the rules below and a fixed seed."""
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    syllable = lambda: rng.choice(("an", "the", "er", "tion", "and", "ou", "ing", "st", "ea", "ble", "or", "on", "re", "ha", "get", "set", "user", "data", "item", "file"))
    word = lambda k=3: "".join(syllable() for _ in range(rng.randint(1, k)))
    prose = lambda n: " ".join(word() for _ in range(n))
    secrets = (
        lambda: pick("0123456789abcdef", rng.choice((32, 40, 48, 64))), lambda: pick(lower + upper + digit, rng.randint(20, 48)), lambda: pick(lower + upper + digit + "+/", rng.choice((32, 40, 44))) + rng.choice(("", "=", "==")),
        lambda: "AKIA" + pick(upper + digit, 16), lambda: "ghp_" + pick(lower + upper + digit, 36), lambda: "sk_live_" + pick(lower + upper + digit, 24), lambda: pick(lower + upper + digit, rng.randint(8, 14)) + pick(digit, 2), lambda: "xoxb-" + pick(digit, 11) + "-" + pick(lower + upper + digit, 24), lambda: "AIza" + pick(lower + upper + digit + "_-", 35),
    )
    plain = (
        lambda: pick(digit, rng.randint(16, 20)), lambda: f"{pick('0123456789abcdef', 8)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 4)}-{pick('0123456789abcdef', 12)}", lambda: f"{word()}_{word()}_{word()}_{word()}{pick(digit, 1)}", lambda: f"{word()}-{word()}-{word()}-20{pick(digit, 2)}-{pick(digit, 2)}",
        lambda: f"/{word()}/{word()}/{word()}{pick(digit, 3)}/{word()}", lambda: word(6) + word(6) + word(4) + pick(digit, 1), lambda: "your_" + rng.choice(("api_key", "token", "password")) + "_here" + pick(digit, 1), lambda: "x" * rng.randint(16, 30) + pick(digit, 1), lambda: "example_" + word(4) + "_123", lambda: "".join(word().capitalize() for _ in range(5)) + pick(digit, 2), lambda: "=" * rng.randint(16, 40) + "a1", lambda: f"v{pick(digit, 1)}_{pick(digit, 2)}_{pick(digit, 2)}-{word()}-release", lambda: f"20{pick(digit, 6)}T{pick(digit, 6)}Z-{word()}", lambda: rng.choice(("changeme123456", "placeholder_value_1", "test_password_123", "insert_token_here_1")),
    )
    names = ("token", "password", "secret", "api_key", "apikey", "passwd", "access_key", "auth", "Authorization: Bearer", "key")
    out = []
    for i in range(size):
        real = i % 2 == 0
        value = rng.choice(secrets if real else plain)()
        label = rng.choice(names)
        if real:
            lead = rng.choice((f'{label} = "', f"{label}={''}", f"{label}: ", f"export {label.upper().replace(' ', '_')}=", f'"{label}": "', f"{prose(3)} ", f"{prose(2)} {label} = \"", f"curl -H '{label}: "))
        else:
            lead = rng.choice((f"{prose(3)} ", f"{prose(4)} ", f"commit {word()} ", f'<a href="{word()}', f"id: ", f"{prose(1)} (", f'{label} = "' if rng.random() < 0.3 else f"{prose(2)} ", f"url={''}", f"{word()}("))
        head = (prose(3) + " " if rng.random() < 0.6 else "") + lead
        text = head + value + rng.choice(('"', " ", "\n", "", "'", ".", ")")) + prose(3)
        out.append((text, len(head), len(head) + len(value), int(real)))
    return out


def train() -> SecretModel:
    """Fit, calibrate and set the threshold. A fifth of the findings serves the latter two only; the result is the same each time."""
    rows = labelled_findings()
    x = np.array([encode(t, a, z) for t, a, z, _ in rows])
    y = np.array([r[3] for r in rows], float)
    held = (np.arange(len(y)) // 2) % 5 == 0
    rng = np.random.default_rng(7)
    model = SecretModel(rng.normal(size=(WIDTH, CLASSES, FILTERS)) * 0.1, np.zeros(FILTERS), rng.normal(size=4 * FILTERS + 1) * 0.2, 0.0)
    model.conv[:, 0] = 0
    fit = np.flatnonzero(~held)
    names = ("conv", "conv_bias", "dense")
    moments = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in names}
    step = 0
    for _ in range(8):
        rng.shuffle(fit)
        for at in range(0, len(fit), 96):
            step += 1
            xs, ys = x[fit[at : at + 96]], y[fit[at : at + 96]]
            z, seen, h, where, ends = model.forward(xs)
            dz = (sigmoid(z) - ys) / len(ys)
            grads = {"dense": seen.T @ dz + 1e-4 * model.dense}
            dseen = dz[:, None] * model.dense
            dh = np.zeros_like(h)
            for k, w in enumerate(where):
                part = dseen[:, k * FILTERS : (k + 1) * FILTERS] * (seen[:, k * FILTERS : (k + 1) * FILTERS] > 0)
                np.put_along_axis(dh, w[:, None, :], np.take_along_axis(dh, w[:, None, :], axis=1) + part[:, None, :], axis=1)
            dh[:, BEFORE : BEFORE + INSIDE] += (h[:, BEFORE : BEFORE + INSIDE] > 0) * dseen[:, None, 3 * FILTERS : 4 * FILTERS] / INSIDE
            grads["conv_bias"] = dh.sum(axis=(0, 1))
            grads["conv"] = np.zeros_like(model.conv)
            flat = dh.reshape(-1, FILTERS)
            for j in range(WIDTH):
                hot = np.eye(CLASSES)[ends[:, j : j + dh.shape[1]].ravel()]
                grads["conv"][j] = hot.T @ flat
            grads["conv"][:, 0] = 0
            model.bias -= 0.02 * dz.sum()
            for k in names:
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * grads[k]
                v *= 0.999
                v += 0.001 * grads[k] ** 2
                getattr(model, k)[...] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.a, model.b = fit_platt(model.forward(x[held])[0], y[held])
    p = np.sort(model.probability(x[held & (y > 0)]))
    model.threshold = float(p[int((1 - MIN_RECALL) * len(p))])
    return model


def scan(texts: pa.Array, model: SecretModel) -> tuple[dict[int, list], dict[int, list], np.ndarray]:
    """Of a string array without nulls: base spans and added spans by row (rows without any are absent), and the number
    of base spans that the network takes for secrets."""
    base: dict[int, list] = {}
    rows, spans, candidates = [], [], []
    for i in np.flatnonzero(pc.match_substring_regex(texts, _ANY).to_numpy(zero_copy_only=False)).tolist():
        text = texts[i].as_py()
        base[i] = base_spans(text)
        for s in base[i]:
            rows.append(i)
            spans.append(s)
            candidates.append((text, _ASSIGN.match(text, s[0]).start(2) if s[2] == "assign" else s[0], s[1]))
        for a, z, cut, cut_behind in more_candidates(text, base[i]):
            rows.append(i)
            spans.append((a, z, "cnn"))
            before, behind = " " if cut else text[max(0, a - BEFORE) : a], " " if cut_behind else text[z : z + AFTER]
            candidates.append((f"{before}{text[a:z]}{behind}", len(before), len(before) + z - a) if cut or cut_behind else (text, a, z))
    sure = model.highest(candidates) >= model.threshold
    confirmed, added = np.zeros(len(texts), np.int64), {}
    for i, s, ok in zip(rows, spans, sure, strict=True):
        if ok and s[2] == "cnn":
            added.setdefault(i, []).append(s)
        elif ok:
            confirmed[i] += 1
    return base, added, confirmed


def find(docs: DataFrame, model: SecretModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base spans and all spans ("kind:start:end", comma-joined, by start then kind) of every text.

    n_confirmed: base spans that the network also takes for secrets; n_added: spans of the network alone. Null and empty
    texts have no spans. Repeated rows are scanned each. Other columns are ignored.
    """
    model = model or process_cache("secret-model", train)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate((*KINDS, "cnn"))}
        show = lambda spans: ",".join(f"{k}:{a}:{z}" for a, z, k in spans)
        for batch in batches:
            for part in text_chunks(batch, "text"):
                n = part.num_rows
                base, added, confirmed = scan(part.column("text"), model)
                every = [show(sorted(base.get(i, []) + added.get(i, []), key=lambda s: (s[0], order[s[2]]))) for i in range(n)]
                counts = [pa.array([sum(s[2] == kind for s in base.get(i, ())) for i in range(n)], pa.int64()) for kind in KINDS]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array([show(base.get(i, [])) for i in range(n)], pa.string()), pa.array(every, pa.string()), pa.array(confirmed), pa.array([len(added.get(i, ())) for i in range(n)], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_confirmed", "n_added"])

    return with_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, model: SecretModel | None = None, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span that find() reports replaced by mark (overlapping spans by one) and length_col, if there, set anew.

    Rows and columns stay; texts without spans, null ones among them, are not touched.
    """
    model = model or process_cache("secret-model", train)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, text_col):
                at = part.schema.get_field_index(text_col)
                texts = pc.fill_null(part.column(at), "")
                base, added, _ = scan(texts, model)
                new: dict[int, str] = {}
                for i in {*base, *added}:
                    text, out, done = texts[i].as_py(), [], 0
                    for a, z, _kind in sorted(base.get(i, []) + added.get(i, [])):
                        if a >= done:
                            out += [text[done:a], mark]
                        done = max(done, z)
                    if done:
                        new[i] = "".join(out) + text[done:]
                if new:
                    rows = sorted(new)
                    mask = np.zeros(part.num_rows, bool)
                    mask[rows] = True
                    put = lambda col, values: pc.replace_with_mask(part.column(col), pa.array(mask), pa.array(values, part.schema.field(col).type))  # noqa: B023, E731
                    columns = {text_col: put(at, [new[i] for i in rows])}
                    if length_col in part.schema.names:
                        columns[length_col] = put(part.schema.get_field_index(length_col), [len(new[i]) for i in rows])
                    part = pa.RecordBatch.from_arrays([columns.get(n, c) for n, c in zip(part.schema.names, part.columns, strict=True)], names=part.schema.names)
                yield part

    return docs.mapInArrow(run, docs.schema)
