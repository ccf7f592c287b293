"""Incremental re-indexing of documents that arrive as Parquet drops: appended, or merged so that a changed one stands once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.functions.columns import content_hash
from siltworks.sources.buckets import BucketTable


def index_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, content_hash, n_lines of documents (doc_id, text), and more of their columns."""
    return docs.select("doc_id", *more, content_hash(F.col("text")).alias("content_hash"), (F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))


def run_available(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> None:
    """Index what has arrived in `source` since the last call and append it to `target`; each file counts once."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = index_rows(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_upserts(spark: SparkSession, source: str, table: BucketTable, checkpoint: str, schema, prepare: Callable[[DataFrame], DataFrame], order: tuple[str, ...], stream: str | None = None) -> list[dict]:
    """Merge what has arrived in `source` since the last call into table, one row a key, the greatest order winning.

    Each micro-batch is one version of the table, which also records the batch's number; so a batch that runs again after a
    failure, whether its version was written or not, comes to the same table. stream names the checkpoint (by default its
    path): a new checkpoint counts its batches anew and needs a new name. Gives BucketTable.upsert's counts by batch.
    """
    counts: list[dict] = []

    def merge(rows: DataFrame, number: int) -> None:
        counts.append(table.upsert(prepare(rows), order, (stream or checkpoint, number)))

    arriving = spark.readStream.schema(schema).parquet(source)
    arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts
