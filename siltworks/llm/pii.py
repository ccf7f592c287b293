"""Personal data: four base patterns, and a linear-chain conditional random field over word shapes.

Base spans come from anchored scans equal to the leftmost, non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)     each part at most 255
    card   [0-9]([\\x20-]?[0-9])+                      12 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                9 to 15 digits

but linear in the text. The field tags words of each line as name, mail (spelled-out addresses), tel (numbers without a
country prefix) or id (dashed identity numbers). It is trained from the labelled lines below and decoded by Viterbi.
Neighbouring words of one tag are a run, kept or dropped as a whole; its spans are the items of its lines.
Lines in which no tag can beat "none" by the largest possible gain are not decoded: their best path is known.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from siltworks.llm import chains
from siltworks.llm.chains import viterbi
from siltworks.llm.common import process_cache, text_chunks, with_text
from siltworks.llm.textcols import SPACE, Words, characters, lowered, split_words, text_bytes

KINDS = ("email", "ip", "card", "phone")
TAGS = ("none", "name", "mail", "tel", "id")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    found: list[tuple[int, int, str]] = []
    done = 0
    for m in _EMAIL_TAIL.finditer(text):
        at = m.start()
        while at > done and text[at - 1] in _LOCAL:
            at -= 1
        if at < m.start():
            found.append((at, m.end(), "email"))
            done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the labelled table -------------------------------------------------------------------------------------------
#: Labelled lines: {N} a name, {M} a spelled-out mail address, {T} a phone number without prefix, {I} an identity number,
#: {W} plain words, {C} a capitalised plain word, {S} a word with signs, {U} a shouted word, {R} one word again and again, {D} an unlabelled number.
LINES = (
    "My name is {N} and {W}", "my name is {N}.", "I am {N}, {W}", "Signed, {N}", "Sincerely, {N}", "Best regards, {N}", "Kind regards {N}",
    "Dear Mr. {N}, {W}", "Dear Mrs. {N}, {W}", "Mr. {N} {W}", "Ms. {N} {W}", "Dr. {N} {W}", "Prof. {N} {W}", "Contact: {N} {W}", "Contact {N} at {T}",
    "Patient: {N} {W}", "Customer: {N}, {T}", "Name: {N}", "Full name: {N} SSN: {I}", "Attention: {N}", "Author: {N}", "Call {N} on {T}", "Ask for Mr. {N}",
    "Call {T} {W}", "Call me at {T}.", "Phone: {T}", "Tel: {T} {W}", "tel. {T}", "Fax: {T}", "Mobile: {T} {W}", "{W} phone {T} {W}", "cell {T}", "Telephone {T}",
    "SSN: {I}", "ssn {I} {W}", "Social security number {I}", "Passport no. {I}", "{W} SSN {I} {W}", "Tax id: {I}", "ID number: {I} {W}",
    "Email: {M}", "mail me: {M}", "e-mail {M} {W}", "Write to {M} {W}", "{W} email {M}", "reach me at {M}", "Contact: {M}",
    "{C} {W}", "{C} {W}, {W}.", "{C} {W}. {C} {W}", "{W} {D} {W}", "{C} {W} {D}", "{C} {C} {W}", "{W} {C} {W}", "{C}. {C}. {W}", "{C} {W} {D} {D} {W}", "{D} {C} {W}",
    "This is {N} from {W}", "{W} this is {N} {W}", "written by {N}", "Hello {N}, {W}", "Hi {N}, {W}", "Thanks, {N}", "From: {N}", "Employee: {N} {W}", "ring {N} at {T} {W}", "spoke with {N} {W}", "Cheers, {N}", "Regards, {N}",
    "{W} {T} {W}", "{W} at {T} {W}", "{W} is {T}", "{T} {W}", "{W} on {T}.", "{W} {I} {W}", "{W} is {I}, {W}", "{W} was {I} {W}", "{I} {W}", "{W} is {I}", "{W} me at {M}", "{W} to {M} for {W}",
    "{W}", "{W}, {W} {W}", "{C} the {W} of {W} is {W}", "and {W} at {W} the {W}", "{C} my {W} is {W}", "{C} call {W}", "name {W} and {W}", "the phone {W} {W}", "{C} I am {W}",
    "contact {W} {W}", "{W} email {W}", "{C} mail {W}", "{C} id {W}", "{W} (at) {W}", "{W} dot {W}", "At {W} dot {W}", "{W} is {D}", "call {D} {W}", "{C} was {W}",
    "{C}. {C}. {C}. {W}", "{W}. {C}. {C}. {C} {W}", "{C}.", "{C}. {C}.", "{W}. {C}. {W}. {C}", "{C} {W}. {C}. {C} {W}", "{C} {C} {C} {C}", "{C}. The {W}", "of {W}. {C}. {C}.",
    "{C} | {W} | {C} | {W}", "{W} | {C} | {C} |", "| {C} |", "{S} {S} {S} {S}", "{S} {S} {S} {S} {S} {S}", "{S} {W} {S}", "{U} {U} {U} {U}", "{U} {U} {U}", "{C}{W} {S}", "{U}",
    "for {W}. {C}. {C}", "to {C} {W}", "am {W}. {C}", "is {C}. {W}", "was {C}. {C} of {W}", "of {C} {C}", "{C} for {C} {W}", "is {W} {D} of {C}",
    "{W}.\nIs. {C} {W}", "Is. In {W}", "{W}. Is. {C}. {W}", "For. {C} {W}", "Of. {C}", "To {C} {W}", "Was {C} {W}", "Am {W}. I {C} {W}", "I {W} {C}. {W}", "No. {C} {W}", "is{S} {S}", "to{S} of{S} in.{S} {C}{S}",
    "{W}. This. {C}. Of {W}", "{W}. Of {W}, {W}", "{W} me. {C} {W}", "{W}. To {W} {C}. From {W}", "Hello {W}", "From {W} to {W}", "by {C}. {W}", "{W} from. {C} {C} {W}", "{W} with {W} {C} {W}", "this {C} {W}", "This is {W}",
    "{R}", "{R}", "{R} {R} {W}", "{R} {W}", "{W} {R} {R}", "{R} {R} {C} {W}",
)
GIVEN = ("Anna", "James", "Maria", "John", "Wei", "Fatima", "Carlos", "Julia", "Ahmed", "Olga", "Peter", "Sofia", "David", "Ingrid", "Luca", "Priya", "Hugo", "Emma", "Omar", "Nina")
FAMILY = ("Smith", "Garcia", "Müller", "Nguyen", "Kowalski", "Rossi", "Dubois", "Jones", "Khan", "Sato", "Petrov", "Silva", "O'Brien", "Meyer", "Johnson", "Lopez", "Keller", "Brown")
SYLLABLES = ("an", "the", "er", "tion", "and", "ou", "ing", "st", "ea", "ble", "or", "on", "re", "ha", "wh", "in", "at", "sh", "ly", "ed", "lo", "mi", "ra", "é", "ü", "ch", "ge", "que", "la", "de")


def labelled_lines(copies: int = 20, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The labelled table: each of LINES `copies` times with other fillers, as (words, tags)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3))))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def fill(slot: str) -> tuple[list[str], int]:
        if slot == "N":
            parts = [rng.choice(GIVEN), rng.choice(FAMILY)] if rng.random() < 0.8 else [rng.choice(GIVEN), rng.choice("ABCDEFGHJ") + ".", rng.choice(FAMILY)]
            return (parts if rng.random() < 0.7 else [p if len(p) < 3 else word().capitalize() for p in parts]), 1
        if slot == "M":
            host = rng.choice(("mail", "example", "post", word()))
            return rng.choice(([word(), "at", host, "dot", rng.choice(("com", "org", "net"))], [word(), "(at)", host, "(dot)", "com"], [word(), "[at]", host, "[dot]", "org"])), 2
        if slot == "T":
            return rng.choice(([f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"], [digits(3), digits(3), digits(4)])), 3
        if slot == "I":
            return rng.choice(([f"{digits(3)}-{digits(2)}-{digits(4)}"], [rng.choice("ABCXZ") + digits(8)], [f"{digits(2)}-{digits(7)}"])), 4
        if slot == "D":
            return [rng.choice((digits(1), digits(2), digits(4), f"{digits(2)}.{digits(2)}", f"{digits(2)},{digits(3)}", f"{digits(1)}.{digits(1)}.{digits(2)}", digits(16), f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(2)}", f"{word()}.{digits(2)}@mail{digits(1)}.example.com"))], 0
        if slot == "C":
            return [word().capitalize() + rng.choice(("", "", ","))], 0
        if slot == "R":
            return [rng.choice((word(), word().capitalize(), word().capitalize() + ".", "Is", "For", "to", "at", "This", "this", "from", "From", "me"))] * rng.randint(4, 12), 0
        if slot == "S":
            return [rng.choice((word(), word().capitalize())) + rng.choice(("", "", ",", ".")) + rng.choice(("&&&", "$$$", "%%%", "###", "***"))], 0
        if slot == "U":
            return [word().upper() + rng.choice(("", ",", ".")) + "!!" * rng.randint(0, 1)], 0
        return [word() + rng.choice(("", "", "", "", ",", ".")) for _ in range(rng.randint(1, 6))], 0

    out = []
    for _ in range(copies):
        for line in LINES:
            words: list[str] = []
            tags: list[int] = []
            for piece in re.split(r"(\{\w\}[.,]?)", line):
                if m := re.fullmatch(r"\{(\w)\}([.,]?)", piece):
                    got, tag = fill(m[1])
                    got = [*got[:-1], got[-1] + m[2]]
                    words, tags = words + got, tags + [tag] * len(got)
                else:
                    words, tags = words + piece.split(), tags + [0] * len(piece.split())
            if rng.random() < 0.3:
                before, _ = fill("W")
                words, tags = before + words, [0] * len(before) + tags
            out.append((words, tags))
    return out


# ---- features -----------------------------------------------------------------------------------------------------
#: Positions, relative to a word, whose spelling and shape count.
AROUND = (0, -1, 1, -2)
#: Runs whose words' scores exceed those of "none" by less than a margin in total are dropped: the highest margin that
#: keeps this share of the rightly tagged runs of held-out lines. An item has at most MAX_WORDS words; longer runs are split.
MIN_RECALL, MAX_WORDS = 0.98, 12
#: Signs that end an item of a list, and digits from which a number is whole.
_ENDS, _WHOLE = ".,;:!?|/&", {"tel": 10, "id": 8}
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 88, 120, 100, 120


def _bare_and_shape(vocab: pa.LargeBinaryArray) -> tuple[pa.Array, pa.Array]:
    """Each word in lower case without ASCII punctuation, and its shape: X, x, d or the sign itself; runs of X and x collapse."""
    n = len(vocab)
    offsets = np.frombuffer(vocab.buffers()[1], np.int64)[vocab.offset : vocab.offset + n + 1]
    buf = np.frombuffer(vocab.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]

    def cut(data: np.ndarray, keep: np.ndarray) -> pa.Array:
        before = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(before[offsets]), pa.py_buffer(data[keep])])

    small = lowered(buf, ascii_only=False)
    letters = (_CLASS[buf] == 88) | (_CLASS[buf] == 120) | (_CLASS[buf] == 100)
    shape = _CLASS[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] == 100)
    keep[offsets[:-1]] = True
    return cut(small, letters), cut(shape, keep)


def _coarse(shape: bytes) -> bytes:
    """Shapes with more than 12 digits fold their digits; long odd shapes are cut to a common one."""
    if shape.count(b"d") > 12:
        shape = re.sub(rb"d+", b"D", shape)
    return shape if len(shape) <= 16 else b"~"


@dataclass
class PiiModel:
    """spellings, shapes: what training saw; tables: for each of AROUND, scores [ids, tags] of spellings then shapes; trans, start: of the field; margin: see MIN_RECALL."""

    spellings: pa.Array
    shapes: dict
    tables: list
    trans: np.ndarray
    start: np.ndarray
    margin: float = -np.inf

    def word_ids(self, vocab: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        bare, shape = _bare_and_shape(vocab)
        spelled = pc.fill_null(pc.index_in(bare, value_set=self.spellings), len(self.spellings)).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = shape.dictionary_encode()
        known = np.array([self.shapes.get(_coarse(s), len(self.shapes)) for s in coded.dictionary.to_pylist()], np.int64)
        return spelled, known[coded.indices.to_numpy(zero_copy_only=False)]

    def _open(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Lines whose best path may have a run that is kept: one of a tag whose words' leads reach the margin, and of which
        leaving "none" may pay.

        Leaving "none" for a run of words gains at most an entry, the words' leads, a step between each two and an exit;
        the best run of a line follows from prefix sums.
        """
        flat = self.trans - self.trans[0, 0]
        enter, inner, leave = max(flat[0, 1:].max(), (self.start - self.start[0])[1:].max()), flat[1:, 1:].max(), max(0.0, flat[1:, 0].max())
        lines, starts = np.cumsum(first) - 1, np.flatnonzero(first)

        def best(gain: np.ndarray) -> np.ndarray:
            """The largest sum of a run of words in each line."""
            total = np.append(0.0, np.cumsum(gain))
            apart = 2 * (total.max() - total.min() + 1)
            low = np.minimum.accumulate(total[:-1] - apart * lines)
            return np.maximum.reduceat(total[1:] - apart * lines - low, starts)

        lead = emit[:, 1:] - emit[:, :1]
        kept = best(lead[:, 0]) >= self.margin - 0.01
        for t in range(1, lead.shape[1]):
            kept |= best(lead[:, t]) >= self.margin - 0.01
        return kept & (best(lead.max(axis=1) + inner) - inner + enter + leave > -0.01)

    def tag(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Tag of each word, and by how much its own score exceeds that of "none"; lines are the sequences."""
        n = len(w.codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        breaks = np.append(np.flatnonzero(w.buf == 10), len(w.buf))
        line = np.searchsorted(breaks, w.start) + np.searchsorted(w.doc, w.start, side="right") * (len(breaks) + 1)
        first = np.append(True, line[1:] != line[:-1])
        spelled, shaped = self.word_ids(w.vocab)
        emit = np.zeros((n, len(TAGS)))
        for offset, (words, shapes) in zip(AROUND, self.tables, strict=True):
            each = (words[spelled] + shapes[shaped])[w.codes]
            if offset == 0:
                emit += each
            elif offset < 0:
                same = line[-offset:] == line[:offset]
                emit[-offset:] += each[:offset] * same[:, None]
            else:
                same = line[offset:] == line[:-offset]
                emit[:-offset] += each[offset:] * same[:, None]
        pick = np.flatnonzero(self._open(emit, first)[np.cumsum(first) - 1])
        tags = np.zeros(n, np.int64)
        tags[pick] = viterbi(emit[pick], self.trans, self.start, first[pick])
        return tags, emit[np.arange(n), tags] - emit[:, 0]


def train() -> PiiModel:
    """Fit the field to labelled_lines(). Takes a few seconds; the result is the same each time."""
    lines = labelled_lines()
    words = pa.array([w.encode() for line, _ in lines for w in line], pa.large_binary())
    bare, shape = _bare_and_shape(words)
    counted = bare.value_counts()
    # Spellings of cue words: those that many lines share. Names and fillers stay unknown, so shape and context decide.
    spelled = sorted(v for v, c in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True) if c >= 20 and v and v.decode() not in {x.lower() for x in (*GIVEN, *FAMILY)} and v.decode() not in SYLLABLES)
    shapes = {s: i for i, s in enumerate(sorted({_coarse(s) for s in shape.to_pylist()}))}
    model = PiiModel(pa.array(spelled, pa.large_binary()), shapes, [], np.zeros((5, 5)), np.zeros(5))
    spelled_id, shaped_id = model.word_ids(words)
    ns, nh = len(spelled), len(shapes)
    block = ns + nh
    longest = max(len(line) for line, _ in lines)
    features = np.full((len(lines), longest, 2 * len(AROUND)), -1)
    tags, mask = np.zeros((len(lines), longest), np.int64), np.zeros((len(lines), longest), bool)
    at = 0
    for i, (line, gold) in enumerate(lines):
        n = len(line)
        tags[i, :n], mask[i, :n] = gold, True
        for k, offset in enumerate(AROUND):
            for j in range(n):
                if 0 <= j + offset < n:
                    s, h = spelled_id[at + j + offset], shaped_id[at + j + offset]
                    features[i, j, 2 * k] = k * block + s if s < ns else -1
                    features[i, j, 2 * k + 1] = k * block + ns + h if h < nh else -1
        at += n
    weights, trans, start = chains.train(features, tags, mask, block * len(AROUND), len(TAGS), rounds=80)
    weights = weights[:-1]
    zero = np.zeros((1, len(TAGS)))
    for k in range(len(AROUND)):
        part = weights[k * block : (k + 1) * block]
        model.tables.append((np.concatenate([part[:ns], zero]), np.concatenate([part[ns:], zero])))
    model.trans, model.start = trans, start
    kept = []
    for line, gold in labelled_lines(copies=4, seed=12):
        got, lead = model.tag(split_words(*text_bytes(pa.array([" ".join(line)]))))
        cuts = [0, *(np.flatnonzero(np.diff(got)) + 1).tolist(), len(got)]
        kept += [lead[a:z].sum() for a, z in zip(cuts, cuts[1:], strict=False) if z > a and got[a] and (np.array(gold[a:z]) == got[a]).mean() > 0.5]
    kept.sort()
    model.margin = float(kept[int((1 - MIN_RECALL) * len(kept))])
    return model


def _items(words: list[str], lines: list[int], tag: str) -> list[tuple[int, int]]:
    """First and last word of each item in a run of words with one tag. No item crosses a line or is longer than MAX_WORDS.

    Items end at signs of lists, names also at a full stop, numbers when they have their digits, mail addresses with
    the word behind the last dot of their host.
    """
    out, first, digits, at = [], 0, 0, False
    bare = [re.sub(r"\W", "", w).lower() for w in words] if tag == "mail" else words
    for k, word in enumerate(words):
        digits += sum(c.isdigit() for c in word)
        at |= bare[k] == "at"
        last = k + 1 == len(words)
        ends = last or lines[k + 1] != lines[k] or k - first + 1 == MAX_WORDS or word[-1] in ",;|/&"
        if tag == "name":
            ends |= word[-1] == "." and len(word) > 4
        elif tag == "mail":
            ends |= not last and at and k > first and bare[k - 1] == "dot" and bare[k + 1] != "dot"
        else:
            ends |= digits >= _WHOLE[tag] or (not last and digits >= 7 and words[k + 1][0] == "(")
        if ends:
            out.append((first, k))
            first, digits, at = k + 1, 0, False
    return out


def _union(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that spans, sorted by start, cover."""
    starts, ends = [], []
    for a, z, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)
    return starts, ends


def _outside(a: int, z: int, covered: tuple[list[int], list[int]], text: str) -> list[tuple[int, int]]:
    """What of a to z lies outside the intervals, without signs at the cuts; parts without a letter or digit go."""
    starts, ends = covered
    out, k = [], bisect_right(ends, a)
    while a < z:
        to = min(z, starts[k]) if k < len(starts) else z
        while a < to and not text[a].isalnum():
            a += 1
        end = to
        while end > a and not text[end - 1].isalnum():
            end -= 1
        if a < end:
            out.append((a, end))
        if to == z:
            break
        a, k = ends[k], k + 1
    return out


def find(docs: DataFrame, model: PiiModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base spans and all spans ("kind:start:end", comma-joined, by start then kind) of every text.

    Spans of the field are items within a line; what of them lies in a base span is cut off. Null and empty texts have no spans. Repeated rows are
    scanned each. Other columns are ignored.
    """
    model = model or process_cache("pii-model", train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, "text"):
                texts = part.column("text")
                n = part.num_rows
                base: list[list] = [[] for _ in range(n)]
                for i in np.flatnonzero(pc.match_substring_regex(texts, r"@[A-Za-z0-9-]|[0-9]\.[0-9]|[0-9][ -]?[0-9]|\+[0-9]").to_numpy(zero_copy_only=False)):
                    base[i] = base_spans(texts[int(i)].as_py())
                added: dict[int, list] = {}
                w = split_words(*text_bytes(texts), SPACE)
                tags, lead = model.tag(w)
                hits = np.flatnonzero(tags)
                if len(hits):
                    chars = characters(w.buf)
                    of = np.searchsorted(w.doc, w.start[hits], side="right") - 1
                    new = np.flatnonzero(np.append(True, (np.diff(hits) > 1) | (np.diff(of) > 0) | (np.diff(tags[hits]) != 0)))
                    line = np.searchsorted(np.flatnonzero(w.buf == 10), w.start[hits])
                    covered: dict[int, tuple] = {}
                    for i, j in zip(new, np.append(new[1:], len(hits)) - 1, strict=True):
                        d, tag = int(of[i]), TAGS[tags[hits[i]]]
                        if lead[hits[i] : hits[j] + 1].sum() < model.margin:
                            continue
                        starts = w.start[hits[i] : hits[j] + 1].tolist()
                        ends = (w.start[hits[i] : hits[j] + 1] + w.size[hits[i] : hits[j] + 1]).tolist()
                        words = [w.buf[a:z].tobytes().decode(errors="replace") for a, z in zip(starts, ends, strict=True)]
                        for first, last in _items(words, line[i : j + 1].tolist(), tag):
                            a, z = starts[first], ends[last]
                            while z > a + 1 and chr(w.buf[z - 1]) in _ENDS:
                                z -= 1
                            a, z = int(chars[a] - chars[w.doc[d]]), int(chars[z] - chars[w.doc[d]])
                            if d not in covered:
                                covered[d] = _union(base[d])
                            k = bisect_right(covered[d][1], a)
                            touched = k < len(covered[d][0]) and covered[d][0][k] < z
                            parts = _outside(a, z, covered[d], texts[d].as_py()) if touched else [(a, z)]
                            added.setdefault(d, []).extend((x, y, tag) for x, y in parts)
                order = {k: i for i, k in enumerate((*KINDS, *TAGS))}
                show = lambda spans: ",".join(f"{k}:{a}:{z}" for a, z, k in spans)
                counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS]
                both = [show(sorted(base[i] + added.get(i, []), key=lambda s: (s[0], order[s[2]]))) for i in range(n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array([show(s) for s in base], pa.string()), pa.array(both, pa.string()), pa.array([len(added.get(i, [])) for i in range(n)], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"])

    return with_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
