"""An index of people by the hash of their name, kept up by a feed of changes.

A change sets one of two things of a person: the name of the profile (null: there is none) or whether the person may
be found.  Of each the change with the highest ``seq`` counts, so the index is the same in whatever order changes come,
and a change that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import publish
from ..functions import text as X
from .social import name_key

#: Fixed: characters of the longest normal name that is indexed, and the outcomes of a change.
LONGEST = 60
SET, REMOVED, UNCHANGED = "gezet", "verwijderd", "ongewijzigd"
STATE = "uid string, profiel struct<seq:bigint,naam:string>, voorkeur struct<seq:bigint,vindbaar:boolean>"


def newest(changes: DataFrame) -> DataFrame:
    """State of each person in ``changes``: uid, soort (profiel, voorkeur), seq, naam, vindbaar."""
    of = lambda kind, value: F.max(F.when(F.col("soort") == kind, F.struct(F.col("seq").cast("bigint").alias("seq"), F.col(value))))
    return changes.groupBy("uid").agg(of("profiel", "naam").alias("profiel"), of("voorkeur", "vindbaar").alias("voorkeur"))


def merged(*states: DataFrame) -> DataFrame:
    rows = states[0]
    for more in states[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("uid").agg(F.max("profiel").alias("profiel"), F.max("voorkeur").alias("voorkeur"))


def with_key(state: DataFrame) -> DataFrame:
    """``state`` with sleutel: where the person stands in the index; null without a full name or leave to be found."""
    found = F.coalesce(F.col("voorkeur.vindbaar"), F.lit(False)) & (F.length(X.normal_title(F.coalesce(F.col("profiel.naam"), F.lit("")))) <= LONGEST)
    return state.withColumn("sleutel", F.when(found, name_key(F.col("profiel.naam"))))


def outcomes(held: DataFrame, changes: DataFrame) -> DataFrame:
    """uid, oud, sleutel and uitkomst of each person in ``changes``, given the state before them."""
    new = newest(changes)
    before = with_key(held.join(new.select("uid"), "uid", "left_semi"))
    after = with_key(merged(before.select("uid", "profiel", "voorkeur"), new))
    rows = after.join(before.select("uid", F.col("sleutel").alias("oud")), "uid", "left")
    outcome = F.when(F.col("oud").eqNullSafe(F.col("sleutel")), UNCHANGED).when(F.col("sleutel").isNotNull(), SET).otherwise(REMOVED)
    return rows.select("uid", "profiel", "voorkeur", "oud", "sleutel", outcome.alias("uitkomst"))


def index(spark: SparkSession, at: str) -> DataFrame:
    """uid and sleutel of everybody in the index at ``at``."""
    return with_key(state(spark, at)).filter("sleutel IS NOT NULL").select("sleutel", "uid")


def state(spark: SparkSession, at: str) -> DataFrame:
    """The last compacted state with the batches that came since."""
    base = publish.current(spark, f"{at}/stand", STATE)
    log = _log(spark, at)
    return base if log is None else merged(base, log)


def _log(spark: SparkSession, at: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/log")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
    whole = [p.toString() for p in batches if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return spark.read.schema(STATE).parquet(*whole) if whole else None


def apply_batch(changes: DataFrame, at: str, number: int) -> None:
    """Takes a batch of changes into the index at ``at``.

    What is written grows with the batch, not with the index: the state of the people in it, in a folder of the batch's
    own.  A batch that is run again replaces what it wrote, or, once compacted, adds what is there already.
    """
    newest(changes).write.mode("overwrite").parquet(f"{at}/log/{number:012d}")


def compact(spark: SparkSession, at: str, stand: int) -> None:
    """Writes the whole state as one table and deletes the batches that are in it; nothing is lost if it breaks off."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/log")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
    publish.publish(state(spark, at), f"{at}/stand", stand)
    for p in old:
        files.delete(p, True)
    publish.clean(spark, f"{at}/stand")


def follow(stream: DataFrame, at: str, every: int = 20) -> None:
    """Keeps the index at ``at`` up with a stream of changes, as far as it goes now, and compacts it after ``every`` batches."""
    spark = stream.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        apply_batch(batch, at, number)
        if number % every == every - 1:
            compact(spark, at, number)

    job = stream.writeStream.option("checkpointLocation", f"{at}/voortgang").trigger(availableNow=True)
    job.foreachBatch(take).start().awaitTermination()
