"""Dates of lists that leave the year, the month or the whole day out.

Lists are rows (list, pos, text).  What depends on the row before only is a window; what depends on its own result is a
fold over the list in order, batch by batch, which holds a year and a month.
"""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..functions.values import first_time


def _order(by: str):
    return W.partitionBy(by).orderBy("pos")


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, null where the calendar has none.  Years may have more than four digits: a long list goes on for ever."""
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "y-MM-dd")


def carry_forward(rows: DataFrame, column: str, by: str = "lijst") -> DataFrame:
    """``column`` of rows without one from the last row before that has it."""
    known = F.nullif(F.col(column), F.lit(""))
    return rows.withColumn(column, F.coalesce(known, F.last(known, ignorenulls=True).over(_order(by).rowsBetween(W.unboundedPreceding, -1))))


def long_dates(rows: DataFrame, today: date, by: str = "lijst") -> DataFrame:
    """Adds datum from labels such as "Zondag 23 augustus (2026)", "Vandaag" and "Morgen".

    The year is that of ``today``, one more each time that the month is before that of the label before; an explicit
    year starts anew from itself.  Today and tomorrow leave that alone; other labels are null.
    """
    t = F.lower(X.strip(F.coalesce("label", F.lit(""))))
    pattern = "([0-9]{1,2})\\s+([a-zé]+)(?:\\s+([0-9]{4}))?"
    month = D.place_in(D.MONTHS, F.regexp_extract(t, pattern, 2))
    out = rows.withColumns({"_t": t, "_m": F.when(~t.isin("vandaag", "morgen"), month), "_d": F.regexp_extract(t, pattern, 1), "_y": F.nullif(F.regexp_extract(t, pattern, 3), F.lit("")).cast("int")})
    upto = _order(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.coalesce(F.last("_m", ignorenulls=True).over(_order(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(today.month))
    out = out.withColumn("_y", F.when(F.col("_m").isNotNull(), F.col("_y")))
    out = out.withColumn("_up", F.when(F.col("_m").isNotNull() & F.col("_y").isNull() & (F.col("_m") < before), 1).otherwise(0))
    out = out.withColumn("_ups", F.sum("_up").over(upto))
    start = F.last(F.when(F.col("_y").isNotNull(), F.struct("_y", "_ups")), ignorenulls=True).over(upto)
    out = out.withColumn("_start", start)
    year = F.coalesce(F.col("_start._y") - F.col("_start._ups"), F.lit(today.year)) + F.col("_ups")
    named = F.when(F.col("_t") == "vandaag", F.lit(today)).when(F.col("_t") == "morgen", F.date_add(F.lit(today), 1)).otherwise(F.when(F.col("_m").isNotNull(), _date(year, F.col("_m"), F.col("_d"))))
    return out.withColumn("datum", named).drop("_t", "_m", "_d", "_y", "_up", "_ups", "_start")


def month_rollover(rows: DataFrame, by: str = "lijst") -> DataFrame:
    """Adds datum and tijd to rows of dag ("za 10-10"), uur and eerste (the first known start, or today).

    The year is that of ``eerste``, one more each time that the month goes back; rows without a date are left out.
    """
    pattern = "([0-9]{1,2})-([0-9]{1,2})"
    out = rows.filter(F.col("dag").rlike(pattern)).withColumns({"_d": F.regexp_extract("dag", pattern, 1), "_m": F.regexp_extract("dag", pattern, 2).cast("int")})
    back = F.when(F.col("_m") < F.coalesce(F.lag("_m").over(_order(by)), F.month("eerste")), 1).otherwise(0)
    year = F.year("eerste") + F.sum("_back").over(_order(by).rowsBetween(W.unboundedPreceding, W.currentRow))
    return out.withColumn("_back", back).withColumn("datum", _date(year, F.col("_m"), F.col("_d"))).withColumn("tijd", first_time(F.col("uur"))).drop("_d", "_m", "_back")


#: Weekday, from 0, of the first of each month in the 400 years after which the calendar comes again.
_FIRST_DAYS = tuple(date(2000 + y, m, 1).weekday() for y in range(400) for m in range(1, 13))


def _weekday(year: int, month: int, day: int) -> int:
    """ISO weekday of a day, counted on from the first of the month for days that the month has not."""
    return (_FIRST_DAYS[year % 400 * 12 + month - 1] + day - 1) % 7 + 1


def _fold(rows: DataFrame, by: str, parsed: Column, step, today: date) -> DataFrame:
    """lijst, pos, datum: ``step(year, month, row's month, day, weekday)`` gives (year kept, month kept, year of this row) in order of pos.

    Lists come in order, batch by batch; what is held of one is its year and month, so a list may be of any length.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def fold(batches):
        at, year, last = object(), today.year, today.month
        for batch in batches:
            own = []
            for key, month, day, wd in zip(*(batch.column(n).to_pylist() for n in (by, "maand", "dag", "wd"))):
                if key != at:
                    at, year, last = key, today.year, today.month
                if month is None:
                    own.append(None)
                else:
                    year, last, y = step(year, last, month, day, wd)
                    own.append(y)
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("pos"), pa.array(own, pa.int32()), batch.column("maand"), batch.column("dag")], [by, "pos", "jaar", "maand", "dag"])

    order = ["pos", "maand", "dag", "wd"]
    listed = rows.select(by, "pos", parsed.alias("p")).select(by, "pos", "p.maand", "p.dag", "p.wd").repartition(by).sortWithinPartitions(by, *order)
    folded = listed.mapInArrow(fold, f"`{by}` {kinds[by]}, pos {kinds['pos']}, jaar int, maand int, dag int")
    return folded.select(by, F.col("pos").cast("bigint").alias("pos"), F.when(F.col("jaar").isNotNull(), _date(F.col("jaar"), F.col("maand"), F.col("dag"))).alias("datum"))


def short_dates(rows: DataFrame, today: date, by: str = "lijst") -> DataFrame:
    """lijst, pos, datum of labels such as "wo 9 sep": a weekday decides between a year and the next.

    A date that lies before the one before it, as its weekday says, does not move the year on.
    """
    t = F.lower(X.strip(F.coalesce("label", F.lit(""))))
    pattern = "([0-9]{1,2})\\s+([a-zé]+)"
    month, wd = D.place_in(D.SHORT_MONTHS, F.regexp_extract(t, pattern, 2)), D.place_in(D.SHORT_WEEKDAYS, F.regexp_extract(t, f"^(zo|ma|di|wo|do|vr|za){X.WORD_END}", 1))
    parsed = F.when(month.isNotNull(), F.struct(month.cast("int").alias("maand"), F.regexp_extract(t, pattern, 1).cast("int").alias("dag"), wd.cast("int").alias("wd")))

    def step(year, last, month, day, wd):
        y = year + 1 if month < last else year
        other = year + 1 if y == year else year
        own = other if wd is not None and _weekday(y, month, day) != wd and _weekday(other, month, day) == wd else y
        return max(year, own), month if own > year or month >= last else last, own

    return _fold(rows, by, parsed, step, today)


def numeric_dates(rows: DataFrame, today: date, by: str = "lijst") -> DataFrame:
    """lijst, pos, datum of labels such as "Zo 27.09": the year may go up for the month and once more for the weekday."""
    t = F.lower(X.strip(F.coalesce("label", F.lit(""))))
    pattern = "(?:([a-z]{2})[a-z0-9_]*\\s+)?([0-9]{1,2})\\.([0-9]{1,2})"
    day, month = F.regexp_extract(t, pattern, 2).try_cast("int"), F.regexp_extract(t, pattern, 3).try_cast("int")
    wd = D.place_in(D.SHORT_WEEKDAYS, F.regexp_extract(t, pattern, 1))
    parsed = F.when(day.between(1, 31) & month.between(1, 12), F.struct(month.alias("maand"), day.alias("dag"), wd.cast("int").alias("wd")))

    def step(year, last, month, day, wd):
        y = year + 1 if month < last else year
        own = y + 1 if wd is not None and _weekday(y, month, day) != wd and _weekday(y + 1, month, day) == wd else y
        return own, month, own

    return _fold(rows, by, parsed, step, today)


def date_list(text: Column, today: date) -> Column:
    """Dates of a text such as "4 t/m 7 & 11, 12 nov, 3 jan": months fill in from the right, years roll on from the left.

    A run over the end of a month goes up to its last day.  What is neither a day nor a run is left out.
    """
    months = F.array(*map(F.lit, D.SHORT_MONTHS))
    clean = F.regexp_replace(text, "[^\\p{L}\\p{N}\\s,&/–-]", " ")
    clean = F.regexp_replace(clean, f"(?i){X.WORD_START}((?:jan|feb|mrt|maa|apr|mei|jun|jul|aug|sep|okt|nov|dec)[a-zé]*)\\s+([0-9])", "$1, $2")
    tokens = F.filter(F.transform(F.split(F.regexp_replace(clean, "\\s*&\\s*", ", "), ",", -1), X.strip), lambda t: t != "")
    token = "(?i)^([0-9]{1,2})(?:\\s+([a-zé]+))?(?:\\s*(?:t/m|tot en met|–|-)\\s*([0-9]{1,2})(?:\\s+([a-zé]+))?)?$"

    def month(word: Column) -> Column:
        w = F.substring(F.lower(word), 1, 3)
        return F.nullif(F.array_position(months, F.when(w == "maa", "mrt").otherwise(w)), F.lit(0)).cast("int")

    part = lambda t, g: F.regexp_extract(t, token, g)
    parsed = F.transform(
        F.filter(tokens, lambda t: t.rlike(token)),
        lambda t: F.struct(part(t, 1).cast("int").alias("van"), month(part(t, 2)).alias("m1"), part(t, 3).try_cast("int").alias("tot"), month(part(t, 4)).alias("m2")),
    )
    run = "struct<van:int,begin:int,tot:int,eind:int>"

    def leftwards(s, t):
        # the month that a day or the end of a run names counts for what stands before it, too
        known = F.coalesce(t["m2"], F.when(t["tot"].isNull(), t["m1"]), s["m"])
        begin = F.when(t["tot"].isNotNull(), F.coalesce(t["m1"], known)).otherwise(known)
        made = F.struct(t["van"].alias("van"), begin.alias("begin"), t["tot"].alias("tot"), known.alias("eind"))
        after = F.when(known.isNotNull() & t["tot"].isNotNull() & t["m1"].isNotNull(), t["m1"]).otherwise(known)
        return F.struct(after.alias("m"), F.when(known.isNotNull(), F.concat(F.array(made), s["uit"])).otherwise(s["uit"]).alias("uit"))

    runs = F.aggregate(F.reverse(parsed), F.struct(F.lit(None).cast("int").alias("m"), F.array().cast(f"array<{run}>").alias("uit")), leftwards, lambda s: s["uit"])
    day = "array<struct<jaar:int,maand:int,dag:int>>"

    def days(year, m, a, b):
        return F.when(a <= b, F.transform(F.sequence(a, b), lambda d: F.struct(year.cast("int").alias("jaar"), m.cast("int").alias("maand"), d.cast("int").alias("dag")))).otherwise(F.array().cast(day))

    def rightwards(s, r):
        year = F.when(r["begin"] < s["m"], s["jaar"] + 1).otherwise(s["jaar"])
        last = F.dayofmonth(F.last_day(F.make_date(year, r["begin"], F.lit(1))))
        later = F.when(r["eind"] < r["begin"], year + 1).otherwise(year)
        crossing = r["begin"] != r["eind"]
        new = F.when(r["tot"].isNull(), days(year, r["begin"], r["van"], r["van"])).when(~crossing, days(year, r["begin"], r["van"], r["tot"])).otherwise(F.concat(days(year, r["begin"], r["van"], last), days(later, r["eind"], F.lit(1), r["tot"])))
        ends = F.when(r["tot"].isNotNull() & crossing, F.struct(later.cast("int").alias("j"), r["eind"].alias("m"))).otherwise(F.struct(year.cast("int").alias("j"), r["begin"].alias("m")))
        # a run that has no day at all leaves year and month as they were
        moved = F.size(new) > 0
        return F.struct(F.when(moved, ends["j"]).otherwise(s["jaar"]).alias("jaar"), F.when(moved, ends["m"]).otherwise(s["m"]).alias("m"), F.concat(s["uit"], new).alias("uit"))

    start = F.struct(F.lit(today.year).alias("jaar"), F.lit(today.month).alias("m"), F.array().cast(day).alias("uit"))
    found = F.aggregate(runs, start, rightwards, lambda s: s["uit"])
    return F.transform(found, lambda d: F.concat_ws("-", d["jaar"].cast("string"), F.lpad(d["maand"].cast("string"), 2, "0"), F.lpad(d["dag"].cast("string"), 2, "0")))
