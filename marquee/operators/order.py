"""Order of names as Dutch readers expect it: accents and case count only between names that are otherwise equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dutch(name: Column | str) -> Column:
    """``name`` as it sorts in Dutch; for orders, windows and min only, as its equality is that of the plain text."""
    return F.collate(name, "nl")


def by_title(items: DataFrame, owner: str = "user", title: str = "titel") -> DataFrame:
    """``items`` with plaats, from 1: each owner's list by title; titles that are equal stand in order of their key (sleutel)."""
    return items.withColumn("plaats", F.row_number().over(W.partitionBy(owner).orderBy(dutch(title), "sleutel")))


def venues_by_name(venues: DataFrame, names: DataFrame, within: str = "stad") -> DataFrame:
    """theaterId, naam, and plaats of venues by their display name, by id where they have none."""
    named = venues.join(names.select("theaterId", F.col("naam").alias("_toon")), "theaterId", "left").withColumn("naam", F.coalesce("_toon", "theaterId")).drop("_toon")
    return named.withColumn("plaats", F.row_number().over(W.partitionBy(within).orderBy(dutch("naam"), "theaterId")))


def first_by_name(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The first name of each key."""
    return rows.groupBy(*keys).agg(F.min_by(name, F.struct(dutch(name), name)).alias(name))
