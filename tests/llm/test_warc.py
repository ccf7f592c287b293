import base64
import gzip
import hashlib

from siltworks.llm.warc import chunked, read, records, summary, write


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_round_trip(spark, tmp_path):
    big = ("x\r\nWARC/1.1\r\n" * 30_000)
    rows = [(1, "http://a/ b\n", "hello"), (2, None, "hello"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "\r\n\r\n"), (8, "ü", "é"), (8, "ü", "é")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, data string").repartition(3)
    manifest = write(chunked(records(pages), chunk=1000), f"file://{tmp_path}/w")
    chunks = read(manifest, chunk=1000)
    got = sorted(tuple(r) for r in summary(chunks).collect())
    want = []
    for p, _, t in rows:
        t = (t or "").encode()
        top = max(q for q, _, u in rows if (u or "").encode() == t)
        want.append((p, len(t), b32(t), "response" if top == p else "revisit", None if top == p else top))
    assert got == sorted(want)
    body = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.archive, r.record_no, r.chunk_no)):
        assert len(r.data) <= 1000
        body.setdefault((r.archive, r.record_no), [r.page_id, r.record_type, b""])[2] += bytes(r.data)
        assert b32(body[(r.archive, r.record_no)][2]) == r.sha1
    assert {p: d for p, k, d in body.values() if k == "response"} == {p: (t or "").encode() for p, _, t in rows if p in (2, 4, 6, 7, 8)}
    first = next(r.path for r in manifest.collect())
    assert gzip.open(first.removeprefix("file://")).read().startswith(b"WARC/1.1\r\nWARC-Type: ")
    small = summary(read(write(chunked(records(pages, min_bytes=3))), with_data=False)).collect()
    assert sorted((r.page_id, r.record_type) for r in small) == [(1, "revisit"), (2, "response"), (3, "response"), (4, "response"), (5, "revisit"), (6, "response"), (7, "response"), (8, "response"), (8, "response")]


def test_empty(spark):
    assert summary(read(write(chunked(records(spark.createDataFrame([], "page_id long, url string, html string")))))).count() == 0


def test_repeated_page_ids_with_different_payloads(spark):
    rows = [(1, "u", "A"), (1, "u", "BB"), (2, "u", "A"), (3, "u", "A"), (3, "u", "CCC"), (4, "u", "CCC"), (3, "u", "A"), (None, "u", "A")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in summary(read(write(chunked(records(pages))), with_data=False)).collect())
    want = []
    for p, _, t in rows:
        top = max(q for q, _, u in rows if u == t and q is not None)
        response = p is None or p == top
        want.append((str(p), len(t), b32(t.encode()), "response" if response else "revisit", None if response else top))
    assert got == sorted(want, key=lambda r: r[:4])
