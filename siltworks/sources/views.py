"""Corpus views: the relational tables presented as files, graphs and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.operators import ranges

EXTENSIONS = (".py", ".rs", ".ts", ".go", ".java", ".md", ".txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size, content of each document; the extension goes by doc_id."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))


def synth_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports between suppliers' modules, repeated ones included."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 500 = 0").select("l_suppkey", "l_partkey")
    return lines.crossJoin(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.col("n")).alias("dst"))


def files_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python module a supplier: its imports, a function, a class with a method, a private function."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    to = s.select(F.col("k").alias("dst"), F.col("nation").alias("to"))
    heads = synth_edges(spark, sf_dir).join(to, "dst").groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", "to"))), lambda e: F.concat(F.lit("import n"), e["to"], F.lit(".s"), e["dst"])), "\n").alias("head"))
    k = F.col("k").cast("string")
    near, after = F.floor(F.col("k") / 4).cast("string"), F.floor((F.col("k") + 4) / 4).cast("string")
    body = (
        "\n\n# module s", k, "\ndef get_", near, "(x: int, y=1) -> int:\n    if x > ", (F.col("k") % 9).cast("string"), " and x < 100:\n        return x\n    return 0\n\nclass Box", k,
        ":\n    def fill_", near, "(self, size=get_", after, "(2)):\n        self.size = size\n        self.kind = 'k'\n\ndef _hide_", k, "(y):\n    for i in range(3):\n        y = y + i\n    return y\n",
    )
    content = F.concat(F.coalesce("head", F.lit("")), *(x if not isinstance(x, str) else F.lit(x) for x in body))
    return s.join(heads, s.k == heads.src, "left").select("k", F.concat(F.lit("src/n"), "nation", F.lit("/s"), k, F.lit(".py")).alias("path"), content.alias("content"))


def graph_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: nations of supplier and customer of each line that crosses a border, repeated."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    joined = line.join(order, line.l_orderkey == order.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def graph_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: the user of each error event and of the event after it."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return ranges.with_next(e, ["ts", "event_id"], "user_id", "dst").where("event_type = 'error' and user_id <> dst").select(F.col("user_id").alias("src"), "dst")


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), F.col("props").alias("value"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("created_at"), "event_id")
