import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltworks.llm.packing import best_fit, encoder, pack, tokenize


def test_best_fit_equals_a_plain_scan():
    rng = np.random.default_rng(0)
    for capacity in (1, 7, 16, 100):
        lengths = np.sort(rng.integers(1, capacity + 1, 300))[::-1]
        window, offset = best_fit(lengths, capacity)
        rooms, total = [], 0
        for n, w, o in zip(lengths, window, offset, strict=True):
            fits = [r for r in rooms if r >= n]
            assert (w < len(rooms)) == bool(fits)
            if fits:
                assert rooms[w] == min(fits)
            else:
                rooms.append(capacity)
            assert o == capacity - rooms[w]
            rooms[w] -= n
            total += n
        assert sum(capacity - r for r in rooms) == total


def test_encoder_equals_the_tokenizers_file():
    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in ("", "The and attion.\n\n  x", "üß éàç ñ 12,3", "a" * 5000, "日本語 text", "<|endoftext|> a", "tab\t\r\n 's don't", " nb", "x" * 990 + " ¼½"):
        assert encoder()(text).tolist() == full.encode(text, add_special_tokens=False).ids


def test_pieces_hold_every_id_once(spark):
    rows = [(1, "word " * 5000), (2, None), (3, ""), (4, "a b c"), (4, "a b c"), (5, "é" * 3000)]
    docs = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, text string, length string, offset int")
    got = pack(tokenize(docs), 6).toPandas()
    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for _, g in got.groupby("piece"):
        g = g.sort_values("start")
        text = dict(rows)[g.doc_id.iloc[0]] or ""
        assert np.frombuffer(b"".join(g.ids), "<u4").tolist() == [*full.encode(text, add_special_tokens=False).ids, 1]
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert len(got.groupby("piece")) == 6
    crc = pack(tokenize(docs), 6).select(F.crc32("ids").alias("c"), "ids").collect()
    assert all(r.c == zlib.crc32(bytes(r.ids)) for r in crc)


def test_empty(spark):
    assert pack(tokenize(spark.createDataFrame([], "doc_id long, text string")), 0).count() == 0
