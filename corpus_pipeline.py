"""The corpus pipeline: documents to stored token ids, in five stages.

Each stage takes what the one before kept.  All but the last return rows of ``documents``; the mix draws some
documents twice, and the last stage returns the digest of what it stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm import decontaminate, mixing, neardup, quality, tokens
from marquee.llm.common import WORD, Scratch, held, row_key, same_row, table, whole_row


def _rows(docs: DataFrame) -> DataFrame:
    """of (the whole row), doc_id and row (see ``row_key``) of each row: rows are told apart where they share or lack an id."""
    return docs.select(whole_row(docs).alias("of"), "doc_id", row_key().alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the quality rules reject."""
    return quality.quality(docs, carry=True).filter("kept").select("row.*")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates (five words, similarity 0.8), that of smallest doc_id.

    Rows without doc_id come after all others.  Rows without words are in no group and stay.
    """
    found = neardup.near_duplicates(docs, percent=80).filter("component IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("of")
    stays = found.groupBy("component").agg(least).select("of.doc_id", "of.row")
    rows, worded = _rows(docs), F.coalesce(F.col("of.text"), F.lit("")).rlike(WORD)
    one = rows.filter(worded).alias("d").join(stays.alias("s"), same_row("d", "s"), "left_semi")
    # equal rows are one document
    one = one.withColumn("n", F.row_number().over(W.partitionBy("row", "doc_id").orderBy("row"))).filter("n = 1").drop("n")
    return one.unionByName(rows.filter(~worded)).select("of.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that overlap with an item of the benchmark."""
    found = decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "row").distinct()
    return _rows(docs).alias("d").join(found.alias("f"), same_row("d", "f"), "left_anti").select("of.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws rows by tempered source weights: every one once, those of small sources up to twice."""
    return mixing.mix(docs, carry=True).select("row.*")


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores the ids of all drawn documents and returns, for each, what the stored files hold."""
    return tokens.stored_digest(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token ids", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again; only the last one's rows and stored ids are left."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for i, (_, stage) in enumerate(STAGES[:-1]):
            with held(spark):
                docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        return scratch.save(STAGES[-1][1](spark, docs, sf_dir), "stored", keep=True)


#: The tokenizer's ids are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
