"""Changes in time: states as intervals, and refreshes that wait until changes have stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def intervals(log: DataFrame, keys: list[str], state: str, at: str, tie: str) -> DataFrame:
    """keys, the state, van and tot (null: still so) of each key's states in order of ``at``, then ``tie``; equal ones in a row are one.

    A null state is a state, too.  What came in between and was undone at the same instant leaves no interval.
    """
    order = W.partitionBy(*keys).orderBy(at, tie)
    last = log.withColumn("_later", F.lead(at).over(order)).filter(F.col("_later").isNull() | (F.col("_later") > F.col(at)))
    order = W.partitionBy(*keys).orderBy(at)
    first = F.row_number().over(order) == 1
    new = last.withColumn("_new", first | ~F.col(state).eqNullSafe(F.lag(state).over(order))).filter("_new")
    return new.select(*keys, state, F.col(at).alias("van"), F.lead(at).over(order).alias("tot"))


def companions(names: Column) -> Column:
    """A snapshot of who comes along: each once, in order."""
    return F.array_sort(F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))))


def settled(changes: DataFrame, wait: str, at: str = "ts", by: str = "user") -> DataFrame:
    """by, begin, einde, n, stand and inhoud of each run of changes after which nothing came for longer than ``wait``.

    changes: user, ts, stand, inhoud; the latest change of the highest stand counts.  The same for tables and streams:
    a stream with a watermark gives a run when the watermark has passed its end (append mode).
    """
    window = F.session_window(at, wait)
    found = changes.groupBy(by, window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("stand", at, "inhoud")).alias("x"))
    return found.select(by, F.col("w.start").alias("begin"), F.col("w.end").alias("einde"), "n", F.col("x.stand").alias("stand"), F.col("x.inhoud").alias("inhoud"))


def writes(runs: DataFrame, by: str = "user") -> DataFrame:
    """The runs of ``settled`` that are written, and why the others are not: uitkomst is geschreven, ouder or gelijk.

    A copy is never replaced by an older stand; one of equal content to the last that was written needs no write.
    """
    order = W.partitionBy(by).orderBy("begin")
    before = F.max("stand").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = runs.withColumn("_ouder", F.coalesce(F.col("stand") < before, F.lit(False)))
    # the last content that stood after the run before this one, older runs left aside
    stood = F.last(F.when(~F.col("_ouder"), F.struct("inhoud")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_stond", stood)
    same = F.coalesce(F.col("_stond.inhoud").eqNullSafe(F.col("inhoud")) & F.col("_stond").isNotNull(), F.lit(False))
    return rows.withColumn("uitkomst", F.when(F.col("_ouder"), "ouder").when(same, "gelijk").otherwise("geschreven")).drop("_ouder", "_stond")
