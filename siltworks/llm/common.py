"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker. Temporaries of a scan are a small multiple of it.
CHUNK_BYTES = 2 << 20
#: Bits of bitmap an id in likely(), the fewest (one row of bitmap_construct_agg) and the most, which are 16 MB.
BITS_AN_ID, FEWEST_BITS, MOST_BITS = 32, 1 << 15, 1 << 27
#: Rows of a few numbers each (counted) up to which a table is broadcast, beyond it is joined by a shuffle.
FEW = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="siltworks-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (tests on one machine) a temporary folder takes its place;
    on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = process_cache("local-shared", _own_folder)
    return f"{base.rstrip('/')}/silt-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def process_cache(key: str, build):
    """A value built once in each Python process. Worker code is sent anew with each task, so it can't keep module globals."""
    store = sys.__dict__.setdefault("_siltworks_cache", {})
    if key not in store:
        store[key] = build()
    return store[key]


def _give_back():
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it

    def now() -> None:
        pa.default_memory_pool().release_unused()
        if trim is not None:
            trim(0)

    return now


def frugal(run):
    """For functions over Arrow batches: at the end of a task, memory that is free again goes back to the system.

    Spark keeps a worker's process for the next task, idle ones for a minute; without this each holds its highest level.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            process_cache("give back", _give_back)()

    return wrapped


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch holding about limit bytes of text each; a longer text stands alone, whole."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def with_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """The id as long and the text with null read as empty, then more; other columns are left out, so none can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread, how: str = "left", salts: int = 32, rows: int | None = None) -> DataFrame:
    """Equi-join whose left side may hold a third of its rows under one key.

    Left rows are dealt by (key, hash of spread mod salts); each right row is repeated once per salt.
    Use it where right has one small row a key. It is always a merge join: Spark's size check does not see the repeats.
    rows: right's number of rows or a bound of it, where known; up to FEW of them are broadcast and nothing is dealt.
    """
    if rows is not None and rows <= FEW:
        return left.join(F.broadcast(right), key, how)
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b.hint("merge"), [key, "_salt"], how).drop("_salt")


def likely(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in ids (one long column), and a few others; an exact join must follow.

    A bitmap of hashed ids is broadcast, so rows that the join would drop are dropped where they are read and do not
    move. It grows with the number of ids up to MOST_BITS; beyond, more others pass, but never fewer of those in ids.
    ids is read twice.
    """
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_AN_ID * ids.count()).bit_length()))

    def place(of: str) -> list:
        at = F.pmod(F.xxhash64(F.col(of).cast("long")), F.lit(bits))
        return [F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")]

    marks = ids.select(*place(ids.columns[0])).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    met = rows.select("*", *place(key)).join(F.broadcast(marks), "_bucket")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)
