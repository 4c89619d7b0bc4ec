"""Older forms of users' lists, and copies that are shared: keys of new versions, favourites, moves, visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import is_cancelled

VERSION = 4


def upgrade_keys(items: DataFrame, version: int = VERSION) -> DataFrame:
    """Items (titel, theaterId, op, v, sleutel) with the key of the present version.

    Where the title has become bound to a venue and the item knows none, it keeps its key if it was added by hand and
    is dropped if it came from a migration (op 0): that makes it again, with its venue.
    """
    old = F.coalesce("v", F.lit(1)) < version
    bound = X.wide_title(F.col("titel")).isin(*X.VENUE_BOUND_TITLES) & (F.coalesce("theaterId", F.lit("")) == "")
    kept = items.filter(~(old & bound & (F.coalesce("op", F.lit(0)) == 0)))
    key = F.when(old & ~bound, X.production_key(F.col("titel"), F.col("theaterId"))).otherwise(F.col("sleutel"))
    return kept.withColumn("sleutel", key).withColumn("v", F.greatest(F.coalesce("v", F.lit(1)), F.lit(version)))


def from_favourites(favourites: DataFrame, known: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """user, sleutel, titel, theaterId, op (0), variant of old favourites (user, waarde).

    "venue::title" is taken as it is.  An old id "venue-slug-words-2026-01-31-2000" is read in four ways (as it stands,
    without a number at its end, without "de musical", without both); the first whose key is in ``known`` (sleutel,
    titel) counts, else the first.  Other values are left out.
    """
    f = favourites
    if renames is not None:
        f = f.join(renames.select(F.col("oud").alias("waarde"), "nieuw"), "waarde", "left").withColumn("waarde", F.coalesce("nieuw", "waarde")).drop("nieuw")
    at = F.instr("waarde", "::")
    direct = f.filter(at > 1).select("user", F.expr("substring(waarde, instr(waarde, '::') + 2)").alias("titel"), F.substring_index("waarde", "::", 1).alias("theaterId"))
    direct = direct.select("user", X.production_key(F.col("titel"), F.col("theaterId")).alias("sleutel"), "titel", "theaterId", F.lit(0).cast("bigint").alias("op"), F.lit("favoriet").alias("variant"))
    pattern = "^([a-z0-9]+)-(.+)-[0-9]{4}-[0-9]{2}-[0-9]{2}-(?:[0-9]{4}|tbd)(?:-[0-9]+)?$"
    slug = f.filter((at <= 1) & F.col("waarde").rlike(pattern)).select("user", "waarde", F.regexp_extract("waarde", pattern, 1).alias("theaterId"), F.replace(F.regexp_extract("waarde", pattern, 2), F.lit("-"), F.lit(" ")).alias("letterlijk"))
    bare = F.regexp_replace("letterlijk", "\\s+[0-9]+$", "")
    forms = F.array_distinct(F.array("letterlijk", bare, F.regexp_replace("letterlijk", "\\s+de musical$", ""), F.regexp_replace(bare, "\\s+de musical$", "")))
    tried = slug.select("user", "waarde", "theaterId", "letterlijk", F.posexplode(forms).alias("pos", "vorm")).withColumn("sleutel", X.production_key(F.col("vorm"), F.col("theaterId")))
    hits = tried.join(known.select("sleutel", F.col("titel").alias("_t")), "sleutel", "left")
    first = hits.groupBy("user", "waarde", "theaterId", "letterlijk").agg(F.min_by(F.struct("sleutel", "_t", "pos", "vorm"), F.struct(F.col("_t").isNull().alias("n"), "pos")).alias("x"))
    old = first.select("user", "x.sleutel", F.coalesce("x._t", "letterlijk").alias("titel"), "theaterId", F.lit(0).cast("bigint").alias("op"), F.when(F.col("x.pos") == 0, "letterlijk").otherwise(F.col("x.vorm")).alias("variant"))
    return direct.unionByName(old)


def rename_favourites(favourites: DataFrame, renames: DataFrame) -> DataFrame:
    """favourites (user, waarde) under their new names (oud, nieuw); where both were there, one stays."""
    m = renames.select(F.col("oud").alias("waarde"), "nieuw")
    return favourites.join(m, "waarde", "left").select("user", F.coalesce("nieuw", "waarde").alias("waarde")).distinct()


def move_favourites(favourites: DataFrame, live: DataFrame, moves: DataFrame) -> DataFrame:
    """favourites "venue::title" of a venue that moved (van, naar), where the title is gone there and plays at the new one.

    ``live`` are theaterId and titel of the present agenda; without any, nothing moves.
    """
    keys = live.select(F.concat_ws("::", "theaterId", "titel").alias("k")).distinct()
    parts = favourites.withColumns({"van": F.substring_index("waarde", "::", 1), "_t": F.expr("substring(waarde, instr(waarde, '::') + 2)")}).join(moves, "van", "left")
    parts = parts.withColumn("_n", F.when(F.contains("waarde", F.lit("::")), F.concat_ws("::", "naar", "_t")))
    there = keys.select(F.col("k").alias("waarde"), F.lit(True).alias("_oud"))
    gone = parts.join(there, "waarde", "left").join(keys.select(F.col("k").alias("_n"), F.lit(True).alias("_nieuw")), "_n", "left")
    moved = F.col("naar").isNotNull() & F.col("_oud").isNull() & F.coalesce("_nieuw", F.lit(False))
    return gone.select("user", F.when(moved, F.col("_n")).otherwise(F.col("waarde")).alias("waarde")).distinct()


def visit_of(plans: DataFrame, shows: DataFrame) -> DataFrame:
    """The visit that a plan becomes: date, time and venue of the plan; title, maker, genre and place of the live row (seq) if it has one."""
    live = shows.select("seq", *[F.col(c).alias(f"_{c}") for c in ("titel", "maker", "genre", "stad", "podiumpas")])
    out = plans.join(live, "seq", "left")
    either = lambda c: F.coalesce(f"_{c}", c)
    shown = X.display_title(F.coalesce("_titel", "titel"), F.when(F.col("_titel").isNotNull(), F.col("_maker")).otherwise(F.col("maker")))
    passed = F.when(F.col("_titel").isNotNull(), F.coalesce("_podiumpas", F.lit(False))).otherwise(F.col("podiumpas"))
    return out.select("plan", "theaterId", "datum", "tijd", shown.alias("titel"), either("maker").alias("maker"), either("genre").alias("genre"), either("stad").alias("stad"), passed.alias("podiumpas"))


def shared_watchlist(items: DataFrame, live: DataFrame) -> DataFrame:
    """user, sleutel, titel, maker, genre to be shared: the live title, maker and genre where there are some."""
    l = live.select("sleutel", F.col("titel").alias("_t"), F.col("maker").alias("_m"), F.col("genre").alias("_g"))
    return items.select("user", "sleutel", "titel").join(l, "sleutel", "left").select("user", "sleutel", F.coalesce("_t", "titel").alias("titel"), F.col("_m").alias("maker"), F.col("_g").alias("genre"))


def shared_seen(items: DataFrame, live: DataFrame) -> DataFrame:
    """user, sleutel, titel, maker, genre, beoordeling, laatsteBezoek, aantal to be shared.

    Maker and genre: live, else of the newest visit that has one, else the item's; at least one visit is counted.
    """
    l = live.select("sleutel", F.col("titel").alias("_t"), F.col("maker").alias("_m"), F.col("genre").alias("_g"))
    newest = F.reverse(F.array_sort("bezoeken"))
    of = lambda c: F.get(F.filter(newest, lambda b: F.coalesce(b[c], F.lit("")) != ""), F.lit(0))[c]
    out = items.join(l, "sleutel", "left")
    return out.select(
        "user", "sleutel", F.coalesce("_t", "titel").alias("titel"), F.coalesce(F.col("_m"), of("maker"), F.col("maker")).alias("maker"), F.coalesce(F.col("_g"), of("genre"), F.col("genre")).alias("genre"),
        "beoordeling", F.get(newest, F.lit(0))["datum"].alias("laatsteBezoek"), F.greatest(F.size("bezoeken"), F.lit(1)).alias("aantal"),
    )


def in_seen_order(items: DataFrame, by_rating: bool = False) -> DataFrame:
    """Adds plaats: seen items of a user by last visit, newest first (without one by the instant they were added, ``op``), or by rating before that."""
    # in milliseconds: an ``op`` may lie beyond the last timestamp
    at = F.coalesce(F.unix_millis(F.col("laatsteBezoek").cast("timestamp")), "op", F.lit(0).cast("bigint"))
    rating = [F.coalesce("beoordeling", F.lit(0.0)).desc()] if by_rating else []
    return items.withColumn("plaats", F.row_number().over(W.partitionBy("user").orderBy(*rating, at.desc(), "sleutel")))


def last_action(items: DataFrame, deletes: DataFrame, columns: tuple[str, ...] = ("op", "gewijzigd", "beoordeeldOp")) -> DataFrame:
    """user and stand: the last instant of any action on a list."""
    zero = F.lit(0).cast("bigint")
    acts = items.select("user", F.greatest(zero, *[F.coalesce(c, zero) for c in columns if c in items.columns]).alias("at")).unionByName(deletes.select("user", F.coalesce("op", zero).alias("at")))
    return acts.groupBy("user").agg(F.max("at").alias("stand"))


def newest_known(visits: Column, field: str, own: Column) -> Column:
    """A field of the newest visit that has it, else the item's."""
    sorted_ = F.reverse(F.array_sort(visits))
    return F.coalesce(F.get(F.filter(sorted_, lambda b: F.coalesce(b[field], F.lit("")) != ""), F.lit(0))[field], own)


def upcoming_plans(plans: DataFrame, today) -> DataFrame:
    """Plans from today on with those of the same evening: plan, datum, tijd, zelfde (number of others of the user)."""
    coming = plans.filter(F.col("datum") >= F.lit(today))
    n = coming.groupBy("user", "datum").agg(F.count(F.lit(1)).alias("_n"))
    return coming.join(n, ["user", "datum"]).select("user", "plan", "datum", "tijd", (F.col("_n") - 1).alias("zelfde"))


def gone_plans(links: DataFrame, shows: DataFrame) -> DataFrame:
    """plan and vervallen of plans whose linked performance is cancelled."""
    return links.join(shows.select("seq", "beschikbaarheid"), "seq").filter(is_cancelled(F.col("beschikbaarheid"))).select("plan", F.col("beschikbaarheid").alias("vervallen"))
