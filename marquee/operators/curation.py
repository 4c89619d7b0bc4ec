"""Curation of the alias list: proposals for groups of keys, and merging what a reviewer chose into the list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .linkage import SEPARATOR


def variant_fits(variant, canonical, maker):
    """Do all parts of a variant stand in the proposal or are they its maker, and does the proposal add the maker only?"""
    bare = lambda t: F.array_distinct(F.filter(F.transform(X.cut(t, X.RAW_SEPARATOR), X.normal_part), lambda p: p != ""))
    v, c, m = bare(variant), bare(canonical), X.normal_part(F.coalesce(maker, F.lit("")))
    extra = F.array_except(c, v)
    return (F.size(F.array_except(F.array_except(v, c), F.array(m))) == 0) & (F.forall(extra, lambda d: d == m) | ((F.size(v) == 1) & F.array_contains(v, m)))


def proposals(members: DataFrame) -> DataFrame:
    """groep, canoniek, sleutels, makers, twijfel of groups: members are groep, sleutel, titel, maker, theaterId, n.

    The canonical title is the one (without slogan and cast parts) of most venues, then the longest; a title that is the
    maker more often than a title comes last.  Doubts: different makers, or a key that another group has, too.
    """
    parts = F.filter(X.raw_parts(F.col("titel")), lambda p: ~F.coalesce(X.slogan_kind(p).isin("officieel", "cast"), F.lit(False)))
    rows = members.withColumn("schoon", F.when(F.size(parts) > 0, F.array_join(parts, SEPARATOR)).otherwise(F.col("titel"))).withColumn("wie", F.when(X.slogan_kind(F.col("maker")).isNull(), F.nullif(F.col("maker"), F.lit(""))))
    titles = rows.groupBy("groep", "schoon").agg(F.countDistinct("theaterId").alias("venues"), F.count(F.lit(1)).alias("als_titel")).withColumn("k", X.normal_title(F.col("schoon")))
    makers = rows.filter("wie is not null").groupBy("groep", X.normal_title(F.col("wie")).alias("k")).agg(F.count(F.lit(1)).alias("als_maker"))
    ranked = titles.join(makers, ["groep", "k"], "left").withColumn("is_maker", F.coalesce(F.col("als_maker") > F.col("als_titel"), F.lit(False)))
    best = ranked.groupBy("groep").agg(F.min_by("schoon", F.struct(F.col("is_maker").cast("int").alias("a"), (-F.col("venues")).alias("b"), (-F.length("schoon")).alias("c"), F.col("schoon").alias("d"))).alias("canoniek"))
    sums = rows.groupBy("groep").agg(F.array_sort(F.collect_set("sleutel")).alias("sleutels"), F.array_sort(F.collect_set("wie")).alias("makers"))
    shared = rows.select("groep", "sleutel").distinct().withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("sleutel"))).groupBy("groep").agg(F.max("_n").alias("_n"))
    out = best.join(sums, "groep").join(shared, "groep")
    none = F.array().cast("array<string>")
    doubt = F.concat(F.when(F.size("makers") > 1, F.array(F.lit("verschillende makers"))).otherwise(none), F.when(F.col("_n") > 1, F.array(F.lit("conflict met een andere groep"))).otherwise(none))
    return out.select("groep", "canoniek", "sleutels", "makers", doubt.alias("twijfel"))


def accept_proposals(proposed: DataFrame, members: DataFrame, aliases: DataFrame, never: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias list, conflicts): aliases of rule R2 from proposals without doubts, besides those that a reviewer chose.

    A source with a choice keeps it; a group with a key that is never to be merged is left out, and so is a variant whose
    parts do not fit.  A source with two targets is a conflict and gets none.
    """
    chosen = aliases.filter("regel = 'keuze'")
    parts = X.cut(F.col("canoniek"), SEPARATOR)
    counted = members.filter("coalesce(maker, '') <> ''").groupBy("groep", "maker").agg(F.sum("n").alias("n"))
    most = counted.groupBy("groep").agg(F.min_by("maker", F.struct((-F.col("n")).alias("n"), "maker")).alias("_veld"))
    fine = proposed.filter("size(twijfel) = 0").join(most, "groep", "left")
    maker = F.when(F.size(parts) > 1, F.when(X.slogan_kind(F.element_at(parts, -1)).isNull(), F.element_at(parts, -1))).otherwise(F.col("_veld"))
    fine = fine.withColumn("_m", maker).filter("_m is not null").withColumn("_doel", X.production_key(F.col("canoniek"), F.lit(None).cast("string")))
    barred = members.select("groep", "sleutel").join(never.select("sleutel").distinct(), "sleutel", "left_semi").select("groep").distinct()
    fine = fine.join(barred, "groep", "left_anti").join(chosen.select(F.col("sleutel").alias("_doel")), "_doel", "left_anti")
    sources = members.groupBy("groep", "sleutel").agg(F.min("titel").alias("_bron")).join(fine, "groep").filter(F.col("sleutel") != F.col("_doel"))
    sources = sources.filter(variant_fits(F.col("_bron"), F.col("canoniek"), F.col("_m"))).join(chosen.select("sleutel"), "sleutel", "left_anti")
    per = sources.groupBy("sleutel").agg(F.countDistinct("canoniek").alias("_n"), F.min_by(F.struct("canoniek", "_m", "groep"), "groep").alias("x"))
    new = per.filter("_n = 1").select("sleutel", F.col("x.canoniek").alias("titel"), F.col("x._m").alias("maker"), F.lit(False).alias("makerVast"), F.col("x.groep").alias("groep"), F.lit("R2").alias("regel"))
    return chosen.select(*new.columns).unionByName(new), per.filter("_n > 1").select("sleutel")


def merge_choices(aliases: DataFrame, choices: DataFrame, never: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias list, conflicts) after a reviewer's choices: groep, bron, titel, maker.

    aliases are sleutel, titel, maker, makerVast, groep, regel.  Old choices of reviewed groups are replaced; sources of
    such a group that were not mentioned keep the group's new target.  Groups of equal normal title with one maker at
    most get one target: the one with a maker.  A source with two targets is a conflict and gets none.  Keys never to be
    merged get no alias that was not chosen.
    """
    keyed = choices.withColumn("_kern", X.normal_title(F.col("titel"))).withColumn("_m", F.nullif(X.normal_title(F.coalesce("maker", F.lit(""))), F.lit("")))
    one = keyed.groupBy("_kern").agg(F.countDistinct("_m").alias("_makers"), F.min_by(F.struct("titel", "maker"), F.struct(F.col("maker").isNull().alias("a"), "groep")).alias("x"))
    targets = keyed.join(one, "_kern").select("groep", "bron", F.when(F.col("_makers") <= 1, F.col("x.titel")).otherwise(F.col("titel")).alias("titel"), F.when(F.col("_makers") <= 1, F.col("x.maker")).otherwise(F.col("maker")).alias("maker"))
    per = targets.groupBy("bron").agg(F.countDistinct("titel").alias("_n"), F.min_by(F.struct("titel", "maker", "groep"), "groep").alias("x"))
    fixed = lambda d, key: d.select(F.col(key).alias("sleutel"), F.col("x.titel").alias("titel"), F.col("x.maker").alias("maker"), F.lit(False).alias("makerVast"), F.col("x.groep").alias("groep"), F.lit("keuze").alias("regel"))
    new = fixed(per.filter("_n = 1"), "bron")
    reviewed = choices.select("groep").unionByName(never.select("groep")).distinct()
    old = aliases.filter("regel = 'keuze'").join(reviewed, "groep", "left_semi")
    goal = targets.groupBy("groep").agg(F.min(F.struct("titel", "maker")).alias("t"))
    kept = old.select("sleutel", "groep").join(goal, "groep").select("sleutel", F.struct("t.titel", "t.maker", "groep").alias("x"))
    kept = fixed(kept.join(choices.select(F.col("bron").alias("sleutel")).distinct(), "sleutel", "left_anti").join(never.select("sleutel").distinct(), "sleutel", "left_anti"), "sleutel")
    rest = aliases.filter("regel = 'keuze'").join(reviewed, "groep", "left_anti").select(*new.columns)
    ruled = aliases.filter("regel <> 'keuze'").join(never.select("sleutel").distinct(), "sleutel", "left_anti").join(choices.select(F.col("bron").alias("sleutel")).distinct(), "sleutel", "left_anti").select(*new.columns)
    return new.unionByName(kept).unionByName(rest).unionByName(ruled), per.filter("_n > 1").select("bron")
