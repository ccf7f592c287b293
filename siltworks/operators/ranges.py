"""Numbers, neighbours and leading rows of a whole table's order, without one task that holds it.

Rows are sorted by range over the cluster and written with their partition and place. What partitions must know of each other
is one row each (how many rows, the first one), so a window over those is bounded by the number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.operators.graph import written


def _placed(df: DataFrame, order: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """(rows with _part and _place in it, from 0; one row a partition: _part, _before: rows of the partitions before)."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The number is the partition's, shifted by 33 bits, and the row's in it.
    numbered = written(ranged.withColumn("_id", F.monotonically_increasing_id()))
    rows = numbered.withColumn("_part", F.shiftright("_id", 33).cast("int")).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, parts.withColumn("_before", before)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "ord") -> DataFrame:
    """df with each row's place (long, from 0) in the order, which should leave no ties."""
    rows, parts = _placed(df, order)
    return rows.join(F.broadcast(parts.select("_part", "_before")), "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The n first rows. Partitions beyond the one in which the n-th lies are not read again."""
    rows, parts = _placed(df, order)
    return rows.join(F.broadcast(parts.where(F.col("_before") < n).select("_part", "_before")), "_part").where(F.col("_before") + F.col("_place") < n).select(*df.columns)


def with_next(df: DataFrame, order: Sequence[Column | str], column: str, name: str) -> DataFrame:
    """df with the column's value in the row after, null in the last one."""
    rows, parts = _placed(df, order)
    inside = F.lead(F.struct(F.col(column).alias("v"))).over(Window.partitionBy("_part").orderBy("_place"))
    firsts = rows.where("_place = 0").select("_part", F.struct(F.col(column).alias("v")).alias("_first"))
    after = firsts.withColumn("_next", F.lead("_first").over(Window.orderBy("_part")))
    joined = rows.withColumn("_inside", inside).join(F.broadcast(after.select("_part", "_next")), "_part")
    return joined.select(*df.columns, F.coalesce("_inside", "_next")["v"].alias(name))
