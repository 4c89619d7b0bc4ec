"""Business dates (Europe/Amsterdam), date choices and month names, as Column expressions.

"today" and "now" are always passed in; session time stays UTC.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Amsterdam"
# Month and weekday names as sources write them.
MONTHS = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")
SHORT_MONTHS = ("jan", "feb", "mrt", "apr", "mei", "jun", "jul", "aug", "sep", "okt", "nov", "dec")
WEEKDAYS = ("maandag", "dinsdag", "woensdag", "donderdag", "vrijdag", "zaterdag", "zondag")
SHORT_WEEKDAYS = ("ma", "di", "wo", "do", "vr", "za", "zo")
QUICK = ("vandaag", "morgen", "weekend", "week", "volgendeWeek", "maand")


def names(values) -> Column:
    return F.array(*map(F.lit, values))


def place_in(values, text: Column) -> Column:
    """1-based place of a text in a list, null if it is none of them."""
    return F.nullif(F.array_position(names(values), text), F.lit(0))


def local_date(instant: Column) -> Column:
    """Date in Amsterdam of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def from_unix(seconds: Column) -> tuple[Column, Column]:
    """(date, hh:mm) in Amsterdam of Unix seconds."""
    at = F.from_utc_timestamp(F.timestamp_seconds(seconds), ZONE)
    return F.to_date(at), F.date_format(at, "HH:mm")


def iso_weekday(day: Column) -> Column:
    """1 Monday to 7 Sunday."""
    return F.weekday(day) + 1


def sort_time(time: Column) -> Column:
    """A missing time comes last."""
    return F.coalesce(time, F.lit("99:99"))


def quick_range(quick: str, today: Column) -> tuple[Column, Column]:
    """(first, last) day of a quick choice; week and weekend end on Sunday, the weekend starts on Friday but not before today."""
    wd = iso_weekday(today)
    sunday = F.date_add(today, 7 - wd)
    return {
        "vandaag": (today, today),
        "morgen": (F.date_add(today, 1), F.date_add(today, 1)),
        "weekend": (F.greatest(today, F.date_add(today, 5 - wd)), sunday),
        "week": (today, sunday),
        "volgendeWeek": (F.date_add(sunday, 1), F.date_add(sunday, 7)),
        "maand": (today, F.last_day(today)),
    }[quick]


@dataclass(frozen=True)
class When:
    """A date choice: a quick range, or own dates (reversed ones are swapped), with ISO weekdays; nothing chosen is everything."""

    quick: str | None = None
    first: date | None = None
    last: date | None = None
    weekdays: tuple[int, ...] = field(default=())

    @staticmethod
    def clean(quick=None, first=None, last=None, weekdays=()) -> When:
        """Stored choices may hold anything: what is not valid is left out; own dates win over a quick range."""

        def day(x):
            try:
                return x if isinstance(x, date) else date.fromisoformat(x)
            except (TypeError, ValueError):
                return None

        a, b = day(first), day(last)
        days = tuple(sorted({d for d in weekdays or () if isinstance(d, int) and not isinstance(d, bool) and 1 <= d <= 7}))
        return When(quick if quick in QUICK and not a and not b else None, a, b, days)

    def toggle_quick(self, quick: str) -> When:
        return When(None if self.quick == quick else quick, None, None, self.weekdays)

    def with_date(self, first=None, last=None) -> When:
        return When(None, first or self.first, last or self.last, self.weekdays)

    def toggle_weekday(self, day: int) -> When:
        return When(self.quick, self.first, self.last, tuple(sorted(set(self.weekdays) ^ {day})))

    def has_range(self) -> bool:
        return bool(self.quick or self.first or self.last)

    def matches(self, day: Column, today: Column) -> Column:
        out = F.lit(True)
        if self.quick:
            first, last = quick_range(self.quick, today)
            out = out & day.between(first, last)
        elif self.has_range():
            a, b = self.first, self.last
            if a and b and a > b:
                a, b = b, a
            if a:
                out = out & (day >= F.lit(a))
            if b:
                out = out & (day <= F.lit(b))
        if self.weekdays:
            out = out & iso_weekday(day).isin(*self.weekdays)
        return out


def short_date(day: Column, with_year: bool = False) -> Column:
    text = F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), F.element_at(names(SHORT_MONTHS), F.month(day)))
    return F.concat(text, F.lit(" "), F.year(day).cast("string")) if with_year else text


def day_text(day: Column) -> Column:
    """Short text such as "vr 13 nov"."""
    return F.concat(F.element_at(names(SHORT_WEEKDAYS), iso_weekday(day)), F.lit(" "), short_date(day))


def range_text(first: Column, last: Column) -> Column:
    """"1–8 nov", "28 okt – 3 nov", "vanaf 1 nov", "t/m 8 nov"; reversed dates are swapped."""
    a, b = F.when(first.isNotNull() & last.isNotNull(), F.least(first, last)).otherwise(first), F.when(first.isNotNull() & last.isNotNull(), F.greatest(first, last)).otherwise(last)
    same_year = F.year(a) == F.year(b)
    return (
        F.when(a.isNull() & b.isNull(), "")
        .when(b.isNull(), F.concat(F.lit("vanaf "), short_date(a)))
        .when(a.isNull(), F.concat(F.lit("t/m "), short_date(b)))
        .when(a == b, short_date(a))
        .when(same_year & (F.month(a) == F.month(b)), F.concat(F.dayofmonth(a).cast("string"), F.lit("–"), short_date(b)))
        .when(same_year, F.concat(short_date(a), F.lit(" – "), short_date(b)))
        .otherwise(F.concat(short_date(a, True), F.lit(" – "), short_date(b, True)))
    )


def with_year(text: Column) -> Column:
    """Date from "13 november 2026" within a text; null where there is none or it is no day of the calendar."""
    pattern = "(?i)([0-9]{1,2})\\s+([a-zé]+)\\s+([0-9]{4})"
    month = place_in(MONTHS, F.lower(F.regexp_extract(text, pattern, 2)))
    iso = F.concat_ws("-", F.regexp_extract(text, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, pattern, 1), 2, "0"))
    return F.when(month.isNotNull(), F.try_to_date(iso, "yyyy-MM-dd"))


def after_show(day: Column) -> Column:
    """A fixed instant just after the day of a performance (22:00 UTC), the same on every device."""
    return day.cast("timestamp") + F.expr("INTERVAL 22 HOURS")


def end_of_day(day: Column) -> Column:
    return day.cast("timestamp") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MILLISECOND")


def nights(since: Column, now: Column) -> Column:
    """Nights from an instant up to and with now, by Amsterdam dates: 0 without an instant, else at least 1."""
    return F.when(since.isNull(), 0).otherwise(F.greatest(F.lit(1), F.datediff(local_date(now), local_date(since)) + 1))
