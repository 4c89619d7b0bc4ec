"""Loading users' lists: everything that may have changed since they were saved, in one round that tells what it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lists import from_favourites
from .state import ITEM_INFO, fill_info, merge_watchlist, rekey

ITEM = ("user", "sleutel", "titel", "theaterId", "op", *ITEM_INFO)


def load_round(saved: DataFrame, saved_gone: DataFrame, extra: DataFrame, extra_gone: DataFrame, favourites: DataFrame, known: DataFrame, mapping: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, tombstones, users): all users' lists after a load; users has user and gewijzigd (differs from what was saved).

    saved and extra (a second source, with seq): user, sleutel, titel, theaterId, op, maker, genre; ..._gone: user, sleutel, op.
    Old favourites (user, waarde) become items of instant 0, keys are brought up to date (mapping: oud, nieuw, whose new
    keys are not old ones), all is merged, and maker and genre are filled from the agenda (info: sleutel, maker, genre).
    Loading what a load gave changes nothing, so it needs no mark of having been done.
    """
    old = from_favourites(favourites, known).select("user", "sleutel", "titel", "theaterId", "op", *[F.lit(None).cast("string").alias(c) for c in ITEM_INFO], F.concat(F.lit("2|"), "sleutel").alias("seq"))
    adds = saved.select(*ITEM, F.concat(F.lit("0|"), "sleutel").alias("seq")).unionByName(extra.select(*ITEM, F.concat(F.lit("1|"), F.lpad(F.col("seq").cast("string"), 20, "0")).alias("seq"))).unionByName(old)
    gone = saved_gone.select("user", "sleutel", "op").unionByName(extra_gone.select("user", "sleutel", "op"))
    items, tombstones = merge_watchlist(rekey(adds, mapping), rekey(gone, mapping))
    items = fill_info(items, info).select(*ITEM)
    users = adds.select("user").unionByName(gone.select("user")).distinct()
    touched = _differs(saved, items, ITEM[2:]).unionByName(_differs(saved_gone, tombstones, ("op",))).distinct().withColumn("_anders", F.lit(True))
    return items, tombstones, users.join(touched, "user", "left").select("user", F.coalesce("_anders", F.lit(False)).alias("gewijzigd"))


def _differs(before: DataFrame, after: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Users with a key that only one of two states has, or has otherwise."""
    state = lambda df, name: df.select("user", "sleutel", F.struct(*fields).alias(name))
    both = state(before, "_was").join(state(after, "_nu"), ["user", "sleutel"], "full_outer")
    return both.filter(~F.col("_was").eqNullSafe(F.col("_nu"))).select("user")
