"""A key-value stream whose entries expire: a bucketed table is the keyed state, with the newest value of each key and whether it is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.sources.buckets import BucketTable

COLUMNS = ("key", "value", "at", "tie", "us", "gone", "step")


def _clock(us: Column, lateness: str) -> Column:
    """The latest time less the lateness, in milliseconds."""
    return F.floor(F.unix_micros(F.timestamp_micros(F.max(us)) - F.expr(f"INTERVAL {lateness}")) / 1000)


def changes(puts: DataFrame, held: DataFrame | None, ttl_seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """What a micro-batch of puts (key, value, at, tie) changes in the entries held: rows as the table has them.

    Time is the latest `at` of all puts less the lateness: puts older than it was before the batch are passed over, and an
    entry is gone when it lies more than ttl_seconds before what it is now (in milliseconds). Rows are worked on as columns,
    not key by key in Python, so a batch costs what an aggregation of it and a scan of the entries cost.
    """
    came = puts.where("key is not null and at is not null").select("key", "value", "at", F.coalesce("tie", F.lit(0)).cast("long").alias("tie"), F.unix_micros("at").alias("us"))
    if held is not None:
        before = held.agg(_clock(F.col("us"), lateness)).first()[0]
        if before is not None:
            came = came.where(F.col("us") >= F.lit(before * 1000))
    times = came.select("us") if held is None else came.select("us").union(held.select("us"))
    clock = times.agg(_clock(F.col("us"), lateness)).first()[0]
    gone = F.floor(F.col("us") / 1000) + ttl_seconds * 1000 < F.lit(clock)
    rows = came.withColumn("gone", gone)
    if held is not None:
        rows = rows.unionByName(held.where(~F.col("gone") & gone).select(*came.columns, F.lit(True).alias("gone")))
    return rows.withColumn("gone", F.coalesce("gone", F.lit(False))).withColumn("step", F.col("gone").cast("int")).select(*COLUMNS)


def run_expiring(spark: SparkSession, puts: DataFrame, table: BucketTable, checkpoint: str, ttl_seconds: int, lateness: str = "0 seconds") -> list[dict]:
    """Bring table (keyed by key) to the puts that have arrived since the last call; gone entries stay marked as gone.

    Gives, by micro-batch, how many rows came in and how many keys are live after it.
    """
    told = []

    def merge(rows: DataFrame, number: int) -> None:
        # us is at again: upsert does not compare the columns that it orders by, and a newer put of an equal value must count.
        table.upsert(changes(rows, table.read(), ttl_seconds, lateness), ("us", "tie", "step"), (checkpoint, number))
        held = live(table)
        told.append({"rows": rows.count(), "state": 0 if held is None else held.count()})

    puts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return told


def live(table: BucketTable) -> DataFrame | None:
    held = table.read()
    return None if held is None else held.where("not gone").select("key", "value", "at")
