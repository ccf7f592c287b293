"""Exact duplicates by skew-safe combining.

Equal texts meet in three steps, each an aggregate whose keys hold the whole text, so content is compared in full every
time: rows of one partition (before anything moves), rows of one salt (the partition's number modulo SALTS), and the winners
of the salts. A text that a third of all rows repeat thus reaches its last task as at most SALTS rows, after tasks that get
one row from each partition. Digests only say where a text goes and, once it is known that a digest has one text, which
group a row is in; digests with several texts are settled by content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm.common import materialize

SALTS = 32
#: Groups that may be sent to every task: each has more than 1 / MOST_HOT of all rows, so there are fewer than that.
MOST_HOT = 4096


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, text, keep_id, group_size of each distinct text of rows (doc_id, digest, text), dealt by digest."""
    dealt = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = dealt.groupBy("digest", "text", "_salt").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    return salted.repartition("digest").groupBy("digest", "text").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))


def groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of each row of docs.

    Null texts are empty ones. Of equal texts the row with the largest doc_id stays; null ids lose to others, and a group
    without any id keeps the null. Rows that repeat the id that stays are kept all (keep() leaves one). Other columns are
    ignored, an empty table gives no rows. Any digest gives the same groups.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), text.alias("text"))
    winners = combine(rows, salts).groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    known = materialize(winners, "winners")
    single, several = known.where("texts = 1").drop("texts"), known.where("texts > 1").select("digest")
    found = _placed(rows.select("doc_id", "digest"), single)
    if not several.isEmpty():
        shared = materialize(rows.join(several, "digest", "left_semi"), "shared-digests")
        found = found.unionByName(shared.join(combine(shared, salts), ["digest", "text"]).select(*found.columns))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def _placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Inner join by digest. Groups with more than 1 / MOST_HOT of all rows go to every task, the others are shuffled."""
    total = known.agg(F.sum("group_size")).first()[0] or 0
    hot = known.where(F.col("group_size") > total / MOST_HOT).select(F.col("digest").alias("_hot"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    cold = known.where(F.col("group_size") <= total / MOST_HOT)
    marked = rows.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")
    # Rows that have met their group travel on by a key of their own, so that no task gets them all.
    own = F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot "), F.coalesce(F.col("doc_id").cast("string"), F.rand(1).cast("string"))).cast("binary"))
    met = marked.withColumn("_key", own).join(cold.withColumnRenamed("digest", "_key"), "_key", "left")
    placed = met.select("doc_id", "digest", F.coalesce("keep_id", "_keep").alias("keep_id"), F.coalesce("group_size", "_size").alias("group_size"))
    return placed.where(F.col("group_size").isNotNull())


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each text. Of rows with equal id and text, one stays."""
    found = groups(docs, id_col=id_col, text_col=text_col).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_n"))
    found = materialize(found, "kept")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (sha256(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_digest"))
    once = docs.join(found.where("_n = 1"), same, "left_semi")
    repeated = found.where("_n > 1")
    if repeated.isEmpty():
        return once
    # Null and empty texts are equal; which of such rows stays does not matter.
    rows = docs.join(repeated, same).withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).dropDuplicates(["_id", "_digest", "_text"])
    return once.unionByName(rows.select(*docs.columns))
