"""Places of rows in a total order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch


def places(scratch: Scratch, df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with at (place from 0 within its ``group``, a column that is never null) and n (rows of the group).

    ``order`` must begin with the group; rows that tie must be equal.  Rows are dealt out by ranges of the order, so a
    hot group lies in many of them; a row for each range and group holds how many rows come before.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    saved = scratch.save(dealt.withColumn("place", F.monotonically_increasing_id()), name)
    part = F.shiftright("place", 33)
    counts = saved.groupBy(F.col(group).alias("of_group"), part.alias("of_part")).agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    of, so_far = W.partitionBy("of_group"), W.partitionBy("of_group").orderBy("of_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("of_group", "of_part", (F.coalesce(F.sum("rows").over(so_far), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(of).alias("n"))
    placed = saved.join(starts, (F.col(group) == F.col("of_group")) & (part == F.col("of_part")))
    return placed.select(*df.columns, (F.col("place") + F.col("shift")).alias("at"), "n")
