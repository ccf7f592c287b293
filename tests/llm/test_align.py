"""Alignment against whole-text encodings and plain Python."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siltworks.llm import align

ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b   c ", "x\n y\t\tz", "é日本 語", "is <|endoftext|> plain", "</s> <s> <unk> <0x41>", "a▁b", "▁", "\x00\x01", "🦊 foxes", "word " * 300, "x" * 5000, "é ́x", "ﬁ ligature", "\r\n\r\n", "   \n"]
SCHEMA = "doc_id long, text string, pair long, n long, kind int, a string, row string"


def encoders():
    import public_tokenizers as P

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def ends_of(text, a, b):
    """[(id, start, end)] of both sides over the bytes of space + text, or none if either gives other bytes."""
    from tokenizers import decoders

    whole = (" " + text).encode()
    if not text:
        return [], []
    out = []
    shown = {}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for i, byte in enumerate(printable + [x for x in range(256) if x not in printable]):
        shown[chr(byte) if i < len(printable) else chr(256 + i - len(printable))] = byte
    assert decoders.ByteLevel() is not None
    for side in (0, 1):
        at, tokens, data = 0, [], b""
        for i in a.encode(" " + text, add_special_tokens=False).ids if side == 0 else b.encode(text):
            if side == 0:
                piece = bytes(shown[c] for c in a.id_to_token(i))
            else:
                p = b.id_to_piece(i)
                piece = bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
            tokens.append((i, at, at + len(piece)))
            at, data = at + len(piece), data + piece
        if data != whole:
            return [], []
        out.append(tokens)
    return tuple(out)


def brute(rows):
    a, b = encoders()
    docs, links = [], Counter()
    for i, text in rows:
        x, y = ends_of(text or "", a, b)
        left, right = {e: t for t, _, e in x}, {e: t for t, _, e in y}
        cuts = sorted(set(left) & set(right))
        pairs = [(left[e], right[e]) for e in cuts]
        links.update(pairs)
        shown, before = [], 0
        for e in cuts:
            shown.append("|".join(",".join(str(t) for t, _, z in side if before < z <= e) for side in (x, y)))
            before = e
        docs.append((i, len(x), len(y), len(cuts), pairs, hashlib.sha256(";".join(shown).encode()).hexdigest() if x else ""))
    best = {}
    for (_, r), n in links.items():
        best[r] = max(best.get(r, 0), n)
    out = [(i, n, m, g, len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), sha) for i, n, m, g, p, sha in docs]
    return sorted(out, key=str), links, best


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "token", "izers", "über", "naïve", "日本", "\n", "  ", "1234", "don't", "é", "…", "AKIA", "\t"]
    return [(i, rng.choice(("", " ")).join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(80)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "clash", "clash") for i, t in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize(("most_pairs", "part_tokens"), [(align.MOST_PAIRS, align.PART_TOKENS), (0, 7), (10, 1)])
def test_align(spark, most_pairs, part_tokens):
    """Also with the counts joined by shuffle, and with texts cut into many parts."""
    rows = texts(5) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(3, "a row twice"), (3, "a row twice"), (None, "no id")]
    want, links, best = brute(rows)
    documents, pairs = align.align(frame(spark, rows), most_pairs=most_pairs, part_tokens=part_tokens)
    assert sorted((tuple(r) for r in documents.collect()), key=str) == want
    assert {(r.a_id, r.b_id): r.links for r in pairs.collect()} == links
    assert {r.b_id: r.best for r in pairs.collect()} == best


def test_empty(spark):
    documents, pairs = align.align(frame(spark, []))
    assert documents.collect() == pairs.collect() == []


def test_pieces_are_whole_texts_ids():
    left, right = align.sides(None, None)
    a, b = encoders()
    every = [t for _, t in texts(8)] + [t for t in ODD if t]
    for _ in range(2):  # the second time from what was kept
        spaced = pa.array([" " + t for t in every])
        for side, whole in ((left, [a.encode(" " + t, add_special_tokens=False).ids for t in every]), (right, [b.encode(t) for t in every])):
            told = side.tokens(spaced)
            assert told.ids.tolist() == [i for ids in whole for i in ids]
            assert told.counts.tolist() == [len(ids) for ids in whole]


@pytest.mark.parametrize("part_tokens", [align.PART_TOKENS, 5])
def test_overlaps(spark, part_tokens):
    a, b = encoders()
    rows = texts(6)[:30] + [(500 + i, t) for i, t in enumerate(ODD)]
    want = []
    for i, text in rows:
        x, y = ends_of(text or "", a, b)
        for m, (p, s, e) in enumerate(x):
            want += [(i, m, n, p, q, max(s, u), min(e, v)) for n, (q, u, v) in enumerate(y) if u < e and s < v]
    got = align.overlaps(frame(spark, rows), part_tokens=part_tokens)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
