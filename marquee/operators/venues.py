"""What differs between venues, as data: rules that leave rows out, and one scan that serves several venues."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import new_folder


class Rule(NamedTuple):
    """A row of a venue is left out where ``field`` meets ``kind``; ``reason`` may hold {waarde}, the field's text.

    woord: one of ``values`` (patterns) as a word; begin: the text begins with one, as a word; een-van: the whole text is one
    of them, without case; geen-van: it is none of them; boven: the number is above the value; leeg: there is none.
    """

    venue: str
    field: str
    kind: str
    values: tuple[str, ...]
    reason: str


def _broken(rule: Rule) -> Column:
    text = X.strip(F.coalesce(F.col(rule.field).cast("string"), F.lit("")))
    any_ = "|".join(rule.values)
    if rule.kind == "woord":
        return text.rlike(f"(?i){X.WORD_START}(?:{any_}){X.WORD_END}")
    if rule.kind == "begin":
        return text.rlike(f"(?i)^(?:{any_}){X.WORD_END}")
    if rule.kind in ("een-van", "geen-van"):
        one = F.lower(text).isin(*[v.lower() for v in rule.values])
        return one if rule.kind == "een-van" else ~one
    if rule.kind == "boven":
        return F.coalesce(F.col(rule.field) > float(rule.values[0]), F.lit(False))
    if rule.kind == "leeg":
        return text == ""
    raise ValueError(f"a rule of {rule.venue} has the unknown kind {rule.kind!r}")


def left_out(rules: Iterable[Rule], venue: str = "theaterId") -> Column:
    """The reason of the first of its venue's rules, in order, that a row meets; null where it stays.

    Rules are few (they are kept by hand), so they become one expression, evaluated where the rows are read.
    """
    by: dict[str, list[Rule]] = {}
    for rule in rules:
        by.setdefault(rule.venue, []).append(rule)
    out = F.lit(None).cast("string")
    for name, own in by.items():
        one = F.lit(None).cast("string")
        for rule in reversed(own):
            value = X.strip(F.coalesce(F.col(rule.field).cast("string"), F.lit("")))
            said = F.lit("").cast("string")
            for k, part in enumerate(rule.reason.split("{waarde}")):
                said = F.concat(said, *([F.when(value == "", "(leeg)").otherwise(value)] if k else []), F.lit(part))
            one = F.when(_broken(rule), said).otherwise(one)
        out = F.when(F.col(venue) == name, one).otherwise(out)
    return out


class Shared(NamedTuple):
    """What a shared scan gave: each member's rows and how many they are, or the error that all members share."""

    rows: dict[str, DataFrame]
    counts: dict[str, int]
    error: str | None


def shared_scan(scan: Callable[[], DataFrame], members: tuple[str, ...], by: str = "theaterId") -> Shared:
    """Runs ``scan`` once for all ``members``, each of which gets the rows in which ``by`` is its name.

    The rows are written once, a folder for each member, and counted on the way; members read their own folder only.
    If the scan fails or breaks off, no member gets rows.
    """
    try:
        df = scan()
        seen = Observation()
        counted = df.observe(seen, *[F.count(F.when(F.col(by) == m, 1)).alias(f"n{k}") for k, m in enumerate(members)])
        at = new_folder(df.sparkSession, "scan")
        counted.filter(F.col(by).isin(*members)).withColumn("_lid", F.col(by)).write.partitionBy("_lid").parquet(at)
        counts = seen.get
    except Exception as e:  # whatever it was, all members are told
        return Shared({}, {m: 0 for m in members}, str(e).strip().splitlines()[0][:200] if str(e).strip() else type(e).__name__)
    with_member = df.withColumn("_lid", F.lit(""))
    read = df.sparkSession.read.schema(with_member.schema).parquet(at) if any(counts.values()) else with_member.limit(0)
    return Shared({m: read.filter(F.col("_lid") == m).drop("_lid") for m in members}, {m: counts[f"n{k}"] for k, m in enumerate(members)}, None)
