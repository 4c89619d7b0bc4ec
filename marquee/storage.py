"""The folder that driver and executors share: cut lineage, results of streams, streams' own checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session (tests on one machine) may name none: a temporary folder is set then."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marquee-")
    if not held.isDefined():
        sc.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read from there, so that later joins know its size and columns."""
    at = new_folder(df.sparkSession, "table")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def new_folder(spark: SparkSession, name: str) -> str:
    """A place for one table or stream below ``<shared folder>/<application>``; ``clear`` deletes them all."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has put into the shared folder through ``new_folder``; DataFrames that read it are of no use after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
