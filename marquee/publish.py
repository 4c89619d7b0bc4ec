"""Tables that are replaced whole: a new version is written beside the old one and then switched to.

A version is a Parquet folder of its own; a small file names it as current.  That file is put in place by one rename,
after all rows are there, so a write that breaks off leaves the version before it as it was, and readers see one or the
other.  Versions that are older than the current one (by ``stand``) or fail the caller's check are never switched to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATUS = "versie bigint, stand bigint, rijen bigint, uitkomst string"
PLACED, OLDER, TOO_FEW = "geplaatst", "ouder", "te-weinig"


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pointers(spark: SparkSession, at: str) -> list[dict]:
    """What is said of each version that was tried, by its number."""
    files, path = _files(spark, f"{at}/versies")
    if not files.exists(path):
        return []
    names = sorted(s.getPath().toString() for s in files.listStatus(path) if s.getPath().getName().endswith(".json"))
    return [json.loads(r["value"]) for r in spark.read.text(names, wholetext=True).collect()] if names else []


def _say(spark: SparkSession, at: str, said: dict) -> None:
    files, path = _files(spark, f"{at}/versies/{said['versie']:012d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_ontwerp-{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    files.mkdirs(path.getParent())
    if files.exists(path) or not files.rename(draft, path):
        files.delete(draft, False)
        raise RuntimeError(f"version {said['versie']} of {at} was published by another writer")


def publish(df: DataFrame, at: str, stand: int, least: int = 0) -> dict:
    """Writes ``df`` as the next version of the table at ``at`` and says what became of it.

    It becomes current unless the current version has a higher ``stand`` (an equal one is replaced: the last write
    wins) or it has fewer than ``least`` rows.
    """
    spark = df.sparkSession
    tried = _pointers(spark, at)
    held = [x for x in tried if x["uitkomst"] == PLACED]
    number = max((x["versie"] for x in tried), default=0) + 1
    if held and stand < max(x["stand"] for x in held):
        said = {"versie": number, "stand": stand, "rijen": 0, "uitkomst": OLDER, "map": None}
    else:
        folder = f"{at}/data/{number:012d}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        rows = spark.read.schema(df.schema).parquet(folder).count()
        said = {"versie": number, "stand": stand, "rijen": rows, "uitkomst": PLACED if rows >= least else TOO_FEW, "map": folder}
    _say(spark, at, said)
    return said


def current(spark: SparkSession, at: str, schema: str | T.StructType) -> DataFrame:
    """The current version, or the last one before it whose files are whole; an empty table of ``schema`` where there is none."""
    for said in sorted(_pointers(spark, at), key=lambda x: -x["versie"]):
        if said["uitkomst"] == PLACED:
            files, done = _files(spark, f"{said['map']}/_SUCCESS")
            if files.exists(done):
                return spark.read.schema(schema).parquet(said["map"])
    return spark.createDataFrame([], schema)


def status(spark: SparkSession, at: str) -> DataFrame:
    """versie, stand, rijen, uitkomst of every version that was tried."""
    return spark.createDataFrame([(x["versie"], x["stand"], x["rijen"], x["uitkomst"]) for x in _pointers(spark, at)], STATUS)


def clean(spark: SparkSession, at: str, keep: int = 2) -> None:
    """Deletes the data of all but the last ``keep`` versions that were current; what is said of them stays."""
    placed = sorted((x for x in _pointers(spark, at) if x["uitkomst"] == PLACED), key=lambda x: -x["versie"])
    stay = {x["map"].rstrip("/").rsplit("/", 1)[1] for x in placed[:keep]}
    files, data = _files(spark, f"{at}/data")
    for s in files.listStatus(data) if files.exists(data) else []:
        if s.getPath().getName() not in stay:
            files.delete(s.getPath(), True)

