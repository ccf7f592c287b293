"""Key-value tables with expiry, and incremental page plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.sources.buckets import BucketTable

DEFAULT_TTL_DAYS = 365
#: Folders that a bucket of a Store may have before a put merges them.
MOST_FOLDERS = 8


def latest(kv: DataFrame, tie: str | None = None) -> DataFrame:
    """The newest row of each key (key, value, created_at); an aggregate, so hot keys are combined before they move."""
    order = F.struct("created_at", *([tie] if tie else []))
    return kv.groupBy("key").agg(F.max_by("value", order).alias("value"), F.max("created_at").alias("created_at"))


def fresh(kv: DataFrame, now: Column, ttl_seconds: float = DEFAULT_TTL_DAYS * 86400, tie: str | None = None) -> DataFrame:
    """latest() without expired rows and without values that are no JSON."""
    return latest(kv, tie).where((now - F.col("created_at") <= ttl_seconds) & F.try_parse_json("value").isNotNull())


def probe(wanted: DataFrame, kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their value, misses) of wanted keys."""
    return wanted.join(kv, "key"), wanted.join(kv.select("key"), "key", "left_anti")


def put(kv: DataFrame, path: str) -> None:
    """Append rows; readers take the newest of a key."""
    kv.write.mode("append").parquet(path)


def clear(spark: SparkSession, path: str) -> int:
    """Empty the table and say how many rows it held."""
    from pyspark.errors import AnalysisException

    try:
        held = spark.read.parquet(path)
    except AnalysisException:  # nothing was put yet
        return 0
    n = held.count()
    spark.createDataFrame([], held.schema).write.mode("overwrite").parquet(path)
    return n


class Store:
    """A key-value table (key, value, created_at) that is put to often: rows are appended to the buckets of their keys, and
    buckets of more than MOST_FOLDERS folders are merged, the newest row of a key staying. Readers of an earlier version
    are not disturbed by that."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, most_folders: int = MOST_FOLDERS):
        self.table, self.most_folders = BucketTable(spark, path, ("key",), buckets), most_folders

    def put(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """rows: key, value, created_at. A batch (stream, number) that was put before changes nothing."""
        self.table.append(rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("created_at").cast("double").alias("created_at")), batch)
        self.table.compact(("created_at",), most_folders=self.most_folders)

    def rows(self) -> DataFrame:
        """The newest row of each key."""
        held = self.table.read()
        return latest(held if held is not None else self.table.spark.createDataFrame([], "key string, value string, created_at double"))

    def fresh(self, now: Column | None = None, ttl_seconds: float = DEFAULT_TTL_DAYS * 86400) -> DataFrame:
        return fresh(self.rows(), F.unix_micros(F.current_timestamp()) / 1e6 if now is None else now, ttl_seconds)

    def expire(self, now: Column, ttl_seconds: float = DEFAULT_TTL_DAYS * 86400) -> None:
        """Merge every bucket, leaving expired rows out, and delete what no longer counts."""
        self.table.compact(("created_at",), now - F.col("created_at") <= ttl_seconds, most_folders=0)
        self.table.vacuum()

    def clear(self) -> int:
        """Empty the table and say how many keys it held."""
        n = self.rows().count()
        if n:
            self.table.clear()
        return n


def save_project(spark: SparkSession, path: str, project_id: str, data: str, now: float) -> None:
    put(spark.createDataFrame([(project_id, data, now)], "key string, value string, created_at double"), path)


def load_project(spark: SparkSession, path: str, project_id: str) -> str | None:
    found = latest(spark.read.parquet(path).where(F.col("key") == project_id)).first()
    return found.value if found else None


def page_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """page_id, action: kept (same inputs), written (new or changed) or removed; both sides have page_id, inputs."""
    a, b = old.select("page_id", F.col("inputs").alias("was"), F.lit(True).alias("had")), new.select("page_id", F.col("inputs").alias("now"), F.lit(True).alias("has"))
    action = F.when(F.col("has").isNull(), "removed").when(F.col("had").isNull(), "written").when(F.col("was").eqNullSafe(F.col("now")), "kept").otherwise("written")
    return a.join(b, "page_id", "full_outer").select("page_id", action.alias("action"))
