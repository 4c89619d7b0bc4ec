"""Groups of productions that are probably one under several titles: candidates for the alias list.

Productions meet on the parts of their titles and makers ("anchors").  What else a production says is a cast, a slogan,
a name or something other; an anchor with two other things, or with names of two makers, is no group.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# Where titles are cut, what is dropped before, anchors that say nothing, slogans, casts, and small words of names.
SPLIT = "\\s+[–—-]\\s+|\\s+\\|\\s+|:\\s+|,\\s+"
DROPPED = ("(?i)\\s*\\((?:\\d+(?:[.,]\\d)?\\+|\\d+\\s*-\\s*\\d+\\s*jaar|try-?out|reprise|premi[eè]re)\\)", "\\s+\\d+\\+\\s*$")
GENERIC = (
    "oudejaarsconference( \\d{4})?", "(nieuw|nieuwe) (programma|voorstelling)", "kerstconcert", "nieuwjaarsconcert", "in concert", "concert", "theaterconcert", "de musical", "the musical", "live", "reprise",
    "try ?outs?", "premiere", "finalistentour(nee)?( \\d{4})?", "(halve )?finale", "jubileumconcert", "najaarsconcert", "voorjaarsconcert", "lunchconcert", "matinee", "cabaret", "muziek", "special", "open podium",
    "sinterklaas", "kerst", "best of", "tribute", "the show", "de show", "theatertour", "tour", "koffieconcert", "familievoorstelling", "voorstelling", "theatercollege", "lezing", "workshop",
)
SLOGANS = (
    "!", "officiële", "officiele", "\\bmusical\\b", "de voorstelling", "\\btour\\b", "theatershow", "\\bshow\\b", "\\bconcert\\b", "\\blive\\b", "jubileum", "afscheid", "de enige", "het origineel", "spektakel", "beleving",
    "avond vol", "een avond", "voor het hele gezin", "wereldberoemd", "\\bhits?\\b", "succesvol", "\\bin concert\\b", "\\bthe musical\\b",
)
CASTS = ("\\be\\.\\s?a\\.?\\s*$", "\\ben anderen\\b", "\\bmet o\\.?a\\.?\\b", "\\bals\\s+\\p{Lu}")
SMALL_WORDS = ("van", "de", "der", "den", "la", "le", "ten", "ter", "von", "di", "da", "&", "en", "y")

_WORD = "\\p{Lu}[\\p{L}'’.-]*"
NAME = f"^{_WORD}(?:\\s+(?:{_WORD}|{'|'.join(SMALL_WORDS)}))*$"
#: Days between first performances that make it doubtful that they are of one tour.
APART_DAYS = 400


def parts_of(title: Column) -> Column:
    out = F.coalesce(title, F.lit(""))
    for pattern in DROPPED:
        out = F.regexp_replace(out, pattern, " ")
    return F.filter(F.transform(F.split(out, SPLIT, -1), X.strip), lambda p: p != "")


def kind_of(part: Column) -> Column:
    """cast, slogan, naam or ander: what a part besides the anchor is."""
    slogan = part.rlike(f"(?iu){'|'.join(SLOGANS)}")
    # the last alternative asks for a capital, whatever the case of the others
    cast = part.rlike(f"(?iu){'|'.join(CASTS)}")
    return F.when(cast, "cast").when(slogan, "slogan").when(part.rlike(NAME) & (F.size(F.split(part, "\\s+")) <= 5), "naam").otherwise("ander")


def _fits(a: Column, b: Column) -> Column:
    """Normal names of one maker: equal, one begins the other, or two edits apart at most."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit(" "))) | F.startswith(b, F.concat(a, F.lit(" "))) | (F.levenshtein(a, b) <= 2)


def several_makers(names: Column) -> Column:
    """Whether names, normal and in order, fall into more than one cluster: each joins the first cluster with a name that fits.

    A name founds a cluster where none before it fits, so a second cluster is there as soon as one such name is.
    """
    founds = lambda i: ~F.exists(F.slice(names, F.lit(1), i), lambda before: _fits(F.get(names, i), before))
    return (F.size(names) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), founds)


def productions(shows: DataFrame, today: date) -> DataFrame:
    """theaterId, titel, maker, sleutel, n, eerste (date), genres, plaats (order of first sight) and delen of what is still to come."""
    coming = shows.filter(F.col("datum") >= F.lit(today))
    genre = F.when(F.col("genre") != "Overig", F.col("genre"))
    rows = coming.groupBy("theaterId", "titel", "maker", "sleutel").agg(F.count(F.lit(1)).alias("n"), F.min("datum").alias("eerste"), F.array_sort(F.collect_set(genre)).alias("genres"), F.min("seq").alias("plaats"))
    maker = F.when(F.coalesce("maker", F.lit("")) != "", F.array(X.strip(F.col("maker")))).otherwise(F.array().cast("array<string>"))
    delen = F.transform(F.concat(parts_of(F.col("titel")), maker), lambda p: F.struct(p.alias("ruw"), X.normal_title(p).alias("norm")))
    return rows.withColumn("delen", delen)


def members(shows: DataFrame, today: date) -> DataFrame:
    """anker, namen, theaterId, titel, maker, sleutel, n, eerste, genres, rest of the productions of each group, a row each.

    A production is in the group of its longest anchor (of equally long ones the first seen); a group needs two keys.
    """
    by_part = productions(shows, today).select("*", F.posexplode(F.array_distinct(F.filter(F.transform("delen", lambda d: d["norm"]), lambda x: x != ""))).alias("plek", "anker"))
    said = ~F.col("anker").rlike(f"^(?:{'|'.join(GENERIC)})$") & ((F.contains("anker", F.lit(" "))) | (F.length("anker") >= 5))
    rest = F.transform(F.filter("delen", lambda d: d["norm"] != F.col("anker")), lambda d: F.struct(d["ruw"].alias("ruw"), d["norm"].alias("norm"), kind_of(d["ruw"]).alias("soort")))
    rows = by_part.filter(said).withColumn("rest", rest).drop("delen")
    # counts first: only of anchors that pass them are names put together
    other = F.explode_outer(F.filter("rest", lambda d: d["soort"] == "ander"))
    others = rows.select("anker", other.alias("d")).groupBy("anker").agg(F.countDistinct("d.norm").alias("anders"))
    seen = rows.groupBy("anker").agg(F.countDistinct("sleutel").alias("sleutels"), F.min(F.struct("plaats", "plek")).alias("eerst"))
    fine = seen.filter("sleutels >= 2").join(others.filter("anders <= 1"), "anker").select("anker", "eerst")
    named = rows.join(fine, "anker", "left_semi").select("anker", F.struct("plaats", "plek").alias("om"), F.posexplode(F.filter("rest", lambda d: d["soort"] == "naam")).alias("k", "d"))
    named = named.groupBy("anker", F.col("d.ruw").alias("naam"), F.col("d.norm").alias("norm")).agg(F.min(F.struct("om", "k")).alias("om"))
    names = named.groupBy("anker").agg(F.array_sort(F.collect_list(F.struct("om", "naam", "norm"))).alias("x"))
    names = names.select("anker", F.transform("x", lambda x: x["naam"]).alias("namen"), F.transform("x", lambda x: x["norm"]).alias("_norm"))
    fine = fine.join(names, "anker", "left").filter(~F.coalesce(several_makers(F.col("_norm")), F.lit(False))).select("anker", "eerst", F.coalesce("namen", F.array().cast("array<string>")).alias("namen"))
    rows = rows.join(fine, "anker")
    place = F.row_number().over(W.partitionBy("theaterId", "titel", "maker").orderBy(F.length("anker").desc(), "eerst"))
    own = rows.withColumn("_k", place).filter("_k = 1").drop("_k")
    kept = own.groupBy("anker").agg(F.countDistinct("sleutel").alias("_n"), F.array_join(F.array_sort(F.collect_set("sleutel")), "|").alias("_id"), F.min("eerst").alias("_e")).filter("_n >= 2")
    # groups of the same keys are one: that of the first anchor
    one = kept.groupBy("_id").agg(F.min_by("anker", F.struct("_e", "anker")).alias("anker")).select("anker")
    return own.join(one, "anker").select("anker", "namen", "theaterId", "titel", "maker", "sleutel", "n", "eerste", "genres", "rest")


def groups(members_: DataFrame) -> DataFrame:
    """anker, sleutels, namen, n, soorten and twijfel (doubts) of each group of ``members``.

    Kinds: a slogan, b cast, c a further part after a comma or colon, d spellings of the maker, e the maker is missing in some.
    """
    has = lambda kind: F.exists("rest", lambda d: d["soort"] == kind)
    excluded = F.col("anker").isin(*X.VENUE_BOUND_TITLES) | F.col("sleutel").isin(*X.VENUE_BOUND_TITLES)
    one = members_.withColumn("_genre", F.when(F.size("genres") == 1, F.get("genres", 0)))
    out = one.groupBy("anker", "namen").agg(
        F.array_sort(F.collect_set("sleutel")).alias("sleutels"), F.sum("n").alias("n"), F.bool_or(has("slogan")).alias("a"), F.bool_or(has("cast")).alias("b"), F.bool_or(F.col("titel").rlike(",\\s+|:\\s+")).alias("c"),
        (F.bool_or(has("naam")) & F.bool_or(~has("naam"))).alias("e"), F.bool_and(F.size("genres") <= 1).alias("_een"), F.array_sort(F.collect_set("_genre")).alias("_genres"), F.bool_or(excluded).alias("_uit"),
        F.datediff(F.max("eerste"), F.min("eerste")).alias("_dagen"),
    )
    kinds = F.filter(F.array(*[F.when(c, name) for name, c in (("a", F.col("a")), ("b", F.col("b")), ("c", F.col("c")), ("d", F.size("namen") > 1), ("e", F.col("e")))]), lambda x: x.isNotNull())
    doubts = F.array(
        F.when(F.col("_een") & (F.size("_genres") > 1), F.concat(F.lit("ander genre: "), F.array_join("_genres", " / "))),
        F.when(~F.contains("anker", F.lit(" ")), F.concat(F.lit('korte titel "'), "anker", F.lit('": meer producties met die naam mogelijk'))),
        F.when(F.col("_uit"), "op de uitsluitlijst (bekend als verschillende producties)"),
        F.when(F.size("namen") > 1, F.concat(F.lit("makernamen: "), F.array_join("namen", " / "))),
        F.when(F.col("_dagen") > APART_DAYS, "speeldata ruim een jaar uit elkaar"),
    )
    return out.select("anker", "sleutels", "namen", "n", F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("overig"))).alias("soorten"), F.filter(doubts, lambda x: x.isNotNull()).alias("twijfel"))


def for_proposals(members_: DataFrame) -> DataFrame:
    """Members as ``curation.proposals`` takes them."""
    return members_.select(F.col("anker").alias("groep"), "sleutel", "titel", "maker", "theaterId", "n")
