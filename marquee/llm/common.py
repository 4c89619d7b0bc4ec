"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as the inside of a character class.
SPACE = "\\x20\\x09-\\x0D"
#: A character of a word.
WORD = f"[^{SPACE}]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master (tests on one machine) may that be unset: a temporary folder is made and set then.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marquee-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_holders: list[list[str]] = []


class Scratch:
    """Tables written below the shared folder, so that later steps do not depend on executors' memory or disks.

    ``save`` writes a DataFrame as Parquet and returns it as read back.  On leaving the ``with`` block all
    tables but those saved with ``keep=True`` are deleted.  These are what a returned DataFrame still reads:
    who has used it up can have them deleted by ``held``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", []

    def __enter__(self) -> "Scratch":
        return self

    def path(self, name: str, keep: bool = False) -> str:
        at = f"{self.root}/{name}"
        if not keep:
            self.paths.append(at)
        elif _holders:
            _holders[-1].append(at)
        return at

    def save(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        at = self.path(name, keep)
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.root}/{name}")

    def __exit__(self, *exc) -> None:
        for at in self.paths:
            delete(self.spark, at)


@contextmanager
def held(spark: SparkSession) -> Iterator[None]:
    """Deletes, on leaving, what the operators called within have kept below the shared folder."""
    _holders.append([])
    try:
        yield
    finally:
        for at in _holders.pop():
            delete(spark, at)


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as a struct, whatever signs are in their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def row_key() -> Column:
    """Tells rows of ``doc_id`` and ``text`` apart, also where they share or lack an id; equal rows have equal keys."""
    return F.xxhash64("doc_id", "text")


def same_row(left: str, right: str) -> Column:
    """Whether rows of two aliased tables with doc_id and row (see ``row_key``) are the same."""
    return F.expr(f"{left}.row = {right}.row AND ({left}.doc_id = {right}.doc_id OR ({left}.doc_id IS NULL AND {right}.doc_id IS NULL))")


def give_back() -> None:
    """Returns what a Python worker has freed to the system, so that idle workers leave memory to others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has its own ways
        pass


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sampled(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and text of up to ``n`` documents: of each of n buckets of hashed ids the one with the least hash.

    The ids are found by an aggregate of n rows, so neither a task nor the driver holds more than that however large
    ``docs`` is.  Rows without doc_id are not taken; of rows that repeat one the least text is.
    """
    h = F.xxhash64("doc_id")
    least = docs.filter("doc_id is not null").groupBy(F.pmod(h, F.lit(n)).alias("bucket")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("x"))
    ids = [r["x"]["doc_id"] for r in least.collect()]
    return docs.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text"))
