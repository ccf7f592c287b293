"""WARC archives as chunked record tables.

A payload travels as rows of (record, chunk number, at most CHUNK bytes), so no step beyond the input cell holds a whole
record. Writers append chunks to per-record gzip members while they check the running SHA-1 against the record's
header; readers stream the archives back into chunk rows that carry the digest so far. Files are written under a
temporary name and renamed, so a repeated task leaves one archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import materialize, salted_join, shared_dir

CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:siltworks:page:"
MANIFEST = "path string, n_records long, n_bytes long"
CHUNKS = "archive string, record_no long, page_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk_no long, last boolean, payload_bytes long, sha1 string, data binary"


def records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, body (binary), sha1 (hex), record_type, refers_to.

    Of records with equal payloads of at least min_bytes that with the largest page_id is the response and the others
    revisit it. A null body is empty. Rows that repeat the response's page_id and payload are responses too, and so are
    rows without a page_id; a page_id may come with several payloads, each decided by itself. Other columns are ignored.
    Only digests are grouped; bodies move once, by page_id and digest, unless the table of revisits is small enough for Spark to broadcast it (its size is known, as it is written first).
    """
    body = F.col(body_col).cast("binary")
    whole = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(body, F.lit(b"")).alias("body")).withColumn("sha1", F.sha1("body"))
    narrow = whole.where(F.octet_length("body") >= min_bytes).select("page_id", "sha1")
    shared = narrow.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("page_id").alias("_n")).where("_n > 1").drop("_n")
    revisits = salted_join(narrow, shared, "sha1", ["page_id"], "inner").where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct()
    revisits = materialize(revisits, "revisits")
    return whole.join(revisits, ["page_id", "sha1"], "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of records(): a revisit and an empty payload have one, without data. A record's chunks stay together, in order."""
    n = F.greatest(F.lit(1), F.when(F.col("record_type") == "revisit", 1).otherwise(F.ceil(F.octet_length("body") / chunk).cast("int")))
    each = rows.withColumn("n_bytes", F.octet_length("body").cast("long")).withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    data = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return each.select("page_id", "url", "record_type", "refers_to", "sha1", "n_bytes", "n_chunks", "chunk_no", data.alias("data"))


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _head(page_id: int | None, url: str | None, kind: str, refers_to: int | None, sha1: str, n_bytes: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{base32(sha1)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (n_bytes if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write(rows: DataFrame, folder: str | None = None, level: int = 1) -> DataFrame:
    """Write the archives of chunked() rows, one .warc.gz a partition, and return their manifest (path, n_records, n_bytes).

    folder: a URI that all executors can write to; by default a new one in the shared folder. The write happens here.
    """
    folder = folder or f"{shared_dir(rows.sparkSession)}/warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        temporary = f"{name}.{task.taskAttemptId()}.tmp"
        out = member = digest = None
        n_records = 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i].as_py() for k in ("page_id", "url", "record_type", "refers_to", "sha1", "n_bytes", "n_chunks", "chunk_no")}
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(temporary, compression=None)
                if r["chunk_no"] == 0:
                    member, digest = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    out.write(member.compress(_head(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["sha1"], r["n_bytes"])))
                data = batch.column("data")[i].as_buffer()
                digest.update(data)
                out.write(member.compress(data))
                if r["chunk_no"] == r["n_chunks"] - 1:
                    if r["record_type"] == "response" and digest.hexdigest() != r["sha1"]:
                        raise ValueError(f"page {r['page_id']}: its chunks don't have the digest {r['sha1']}")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    n_records += 1
        if out is not None:
            size = out.tell()
            out.close()
            system.move(temporary, name)
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name.rpartition('/')[2]}", "n_records": n_records, "n_bytes": size}], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


class _Members:
    """Bytes of a gzip file of many members, decompressed piece by piece."""

    def __init__(self, source, block: int = 1 << 18):
        self.source, self.block, self.raw, self.inflate, self.held = source, block, b"", None, bytearray()

    def _more(self) -> bool:
        while True:
            if self.inflate is None or self.inflate.eof:
                self.raw = (self.inflate.unused_data if self.inflate is not None else b"") or self.raw
                if not self.raw:
                    self.raw = self.source.read(self.block)
                if not self.raw:
                    return False
                self.inflate = zlib.decompressobj(31)
            raw, self.raw = self.raw or self.inflate.unconsumed_tail or self.source.read(self.block), b""
            if not raw:
                if self.inflate.eof:
                    return False
                raise ValueError("an archive ends inside a record")
            got = self.inflate.decompress(raw, self.block)
            if got:
                self.held += got
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        at = self.held.find(b"\r\n")
        while at < 0:
            if not self._more():
                if self.held:
                    raise ValueError("an archive ends inside a line")
                return None
            at = self.held.find(b"\r\n")
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def some(self, most: int) -> bytes:
        """At least one and at most `most` bytes."""
        if not self.held and not self._more():
            raise ValueError("an archive ends inside a record")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out


def _headers(source: _Members) -> dict[str, str]:
    out = {}
    while line := source.line():
        key, _, value = line.decode().partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def stream(source, archive: str, chunk: int, with_data: bool) -> Iterator[dict]:
    """Chunk rows of one archive; memory stays near one chunk."""
    members, number = _Members(source), 0
    while (version := members.line()) is not None:
        if not version.startswith(b"WARC/"):
            raise ValueError(f"{archive}: a record begins with {version[:20]!r}")
        head = _headers(members)
        left = int(head["content-length"])
        status = members.line()
        left -= len(status) + 2
        http: dict[str, str] = {}
        while True:
            line = members.line()
            left -= len(line) + 2
            if not line:
                break
            key, _, value = line.decode().partition(":")
            http[key.strip().lower()] = value.strip()
        ident = lambda k: int(v) if (v := head.get(k, "").strip("<>").removeprefix(RECORD_ID)) else None
        row = {"archive": archive, "record_no": number, "page_id": ident("warc-record-id"), "record_type": head["warc-type"], "refers_to": ident("warc-refers-to"), "declared_bytes": int(http["content-length"]), "declared_digest": head["warc-payload-digest"].removeprefix("sha1:")}
        digest, size, chunk_no = hashlib.sha1(), 0, 0
        while True:
            parts, room = [], min(left, chunk)
            while room:
                got = members.some(room)
                digest.update(got)
                size, left, room = size + len(got), left - len(got), room - len(got)
                if with_data:
                    parts.append(got)
            yield row | {"chunk_no": chunk_no, "last": not left, "payload_bytes": size, "sha1": base64.b32encode(digest.digest()).decode(), "data": b"".join(parts)}
            chunk_no += 1
            if not left:
                break
        if members.line() or members.line():
            raise ValueError(f"{archive}: record {number} is longer than it says")
        number += 1


def read(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives in a manifest (see CHUNKS). payload_bytes and sha1 (base32) run up to and with the chunk.

    with_data=False leaves data empty; sizes and digests are still taken from the payloads.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(CHUNKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with system.open_input_stream(at, compression=None) as source:
                    for row in stream(source, path, chunk, with_data):
                        held.append(row)
                        size += len(row["data"]) + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives, "path").mapInArrow(run, CHUNKS)


def summary(chunks: DataFrame) -> DataFrame:
    """One row a record from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response must have the size and digest that its headers declare; a revisit holds no payload and reports those of
    the payload it stands for.
    """
    revisit = F.col("record_type") == "revisit"
    wrong = ~revisit & ((F.col("payload_bytes") != F.col("declared_bytes")) | (F.col("sha1") != F.col("declared_digest")))
    size = F.when(wrong, F.raise_error(F.lit("a payload differs from its headers")).cast("long")).when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes"))
    return chunks.where("last").select("page_id", size.alias("payload_bytes"), F.when(revisit, F.col("declared_digest")).otherwise(F.col("sha1")).alias("payload_digest"), "record_type", "refers_to")
