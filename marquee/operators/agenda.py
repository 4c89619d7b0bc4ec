"""The agenda: faceted filter, groups by date, facets, and what belongs to one performance.

Filters are predicates on one scan, so they reach the Parquet reader; memberships (watchlist, seen) are semi and anti
joins on the production key that ``show`` carries.
"""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import When, sort_time
from ..functions.values import is_cancelled, is_full
from .order import dutch

SHORT_TERM = 3
WINDOW_DAYS = 30


def genres_of(rows: DataFrame) -> Column:
    """All genres of a row: ``genres`` if it has some, else its genre, else "Overig"."""
    bucket = F.array(F.coalesce("genre", F.lit("Overig")))
    return F.when(F.size("genres") > 0, F.col("genres")).otherwise(bucket) if "genres" in rows.columns else bucket


def search_texts(rows: DataFrame, aliases: str | None = None, shown: bool = True) -> Column:
    """What a search looks at: the title (as ``shown``, with its maker), the source's title, maker, venue, city, and aliases of the venue."""
    texts = [X.display_title(F.col("titel"), F.col("maker")) if shown else F.col("titel"), *(F.col(c) for c in ("titelBron", "maker", "theaterNaam", "stad") if c in rows.columns)]
    out = F.array(*texts)
    return F.concat(out, F.coalesce(F.col(aliases), F.array().cast("array<string>"))) if aliases else out


def search_forms(rows: DataFrame, aliases: str | None = None, shown: bool = True) -> Column:
    """The texts of a search behind each other, with a mark between them that is in no term, folded once; a table may carry it as ``zoek``."""
    return X.search_form(F.array_join(search_texts(rows, aliases, shown), "\x01"))


def _term(term: str) -> str:
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", (term or "").lower()) if not 0x300 <= ord(c) <= 0x36F)
    return " ".join(bare.split())


def matches_search(rows: DataFrame, term: str, aliases: str | None = None) -> Column:
    """Does a row fit a search term?  Up to three characters must start a word, longer terms may stand anywhere."""
    q = _term(term)
    if not q:
        return F.lit(True)
    if "zoek" in rows.columns:
        text = F.concat_ws("\x01", "zoek", X.search_form(F.array_join(aliases, "\x01"))) if aliases else F.col("zoek")
    else:
        # a term without a dash that stands in the title as shown stands in the title or in the maker, which are looked at anyway
        text = search_forms(rows, aliases, shown="–" in q)
    if len(q) <= SHORT_TERM:
        return text.rlike(f"(^|[^\\p{{L}}\\p{{N}}])\\Q{q}\\E")
    return F.contains(text, F.lit(q))


def agenda(
    shows: DataFrame,
    today: date,
    *,
    venues_off: tuple[str, ...] = (),
    cities: tuple[str, ...] = (),
    venues: tuple[str, ...] = (),
    genres: tuple[str, ...] = (),
    passes_only: bool = False,
    watchlist: DataFrame | None = None,
    seen: DataFrame | None = None,
    hide_full: bool = False,
    when: When = When(),
    search: str = "",
    aliases: str | None = None,
    window: bool = True,
) -> DataFrame:
    """Performances that fit a choice; an empty choice does not restrict.

    ``window`` ends the list after 30 days, unless there is a search or a date range.  A pass filter keeps what is
    unknown.  ``watchlist`` and ``seen`` have a column ``sleutel``.  Order is left to the reader (see ``in_order``).
    """
    day = F.lit(today)
    rows = shows.filter(F.col("datum") >= day)
    if window and not search.strip() and not when.has_range():
        rows = rows.filter(F.col("datum") <= F.date_add(day, WINDOW_DAYS))
    if venues_off:
        rows = rows.filter(~F.col("theaterId").isin(*venues_off))
    if cities:
        rows = rows.filter(F.col("stad").isin(*cities))
    if venues:
        rows = rows.filter(F.col("theaterId").isin(*venues))
    if genres:
        rows = rows.filter(F.arrays_overlap(genres_of(rows), F.array(*map(F.lit, genres))))
    if passes_only:
        rows = rows.filter(F.coalesce("podiumpas", F.lit(True)))
    if hide_full:
        rows = rows.filter(~is_full(F.col("beschikbaarheid")))
    rows = rows.filter(when.matches(F.col("datum"), day)).filter(matches_search(rows, search, aliases))
    if watchlist is not None:
        rows = rows.join(watchlist.select("sleutel").distinct(), "sleutel", "left_semi")
    if seen is not None:
        rows = rows.join(seen.select("sleutel").distinct(), "sleutel", "left_anti")
    return rows


def in_order(rows: DataFrame) -> DataFrame:
    """By date and time, a missing time last, then in input order."""
    return rows.orderBy("datum", sort_time(F.col("tijd")), "seq")


def places(rows: DataFrame) -> DataFrame:
    """Adds plaats: the number of a row within its date, in the order of ``in_order``.  No group is larger than a date."""
    return rows.withColumn("plaats", F.row_number().over(W.partitionBy("datum").orderBy(sort_time(F.col("tijd")), "seq")))


def active_filters(choices: DataFrame) -> Column:
    """How many groups of filters are set: lists (steden, theaters, genres) with something in them, switches that are on, and a date choice (wanneer)."""
    lists = [F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, 1).otherwise(0) for c in ("steden", "theaters", "genres") if c in choices.columns]
    flags = [F.coalesce(c, F.lit(False)).cast("int") for c in ("podiumpas", "watchlist", "volVerbergen", "gezienVerbergen", "wanneer") if c in choices.columns]
    out = F.lit(0)
    for x in [*lists, *flags]:
        out = out + x
    return out


def by_date(rows: DataFrame) -> DataFrame:
    """datum, n and the sorted titles of each date.  A date is a heading on a screen: its titles are one value."""
    return rows.groupBy("datum").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(sort_time(F.col("tijd")).alias("t"), "seq", "titel"))), lambda x: x["titel"]).alias("titels"))


def hidden_count(rows: DataFrame, today: date) -> DataFrame:
    """One row: all, in_window (30 days) and hidden, of rows filtered without the window."""
    inside = F.count(F.when(F.col("datum") <= F.date_add(F.lit(today), WINDOW_DAYS), 1))
    return rows.agg(F.count(F.lit(1)).alias("alle"), inside.alias("binnen")).withColumn("verborgen", F.col("alle") - F.col("binnen"))


def facet_cascade(shows: DataFrame, passes_only: bool = False, cities: tuple[str, ...] = ()) -> DataFrame:
    """Venues still to choose from after the pass filter and chosen cities: theaterId, theaterNaam, stad."""
    rows = shows.filter(F.coalesce("podiumpas", F.lit(True))) if passes_only else shows
    rows = rows.filter(F.col("stad").isin(*cities)) if cities else rows
    return rows.select("theaterId", "theaterNaam", "stad").distinct()


def also_playing_at(shows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Other venues with the normal title of each chosen row (seq, theaterId, norm): venue, number of dates, first date.

    Ambiguous titles have none.  Rows are counted by title and venue before they meet the chosen ones, so a title that
    plays everywhere is one row a venue.
    """
    per_venue = shows.groupBy("norm", "theaterId").agg(F.count(F.lit(1)).alias("n"), F.min("datum").alias("eerste"))
    others = per_venue.withColumnRenamed("theaterId", "elders")
    open_ = chosen.filter(~F.col("norm").isin(*X.VENUE_BOUND_TITLES)).select("seq", "theaterId", "norm")
    return open_.join(others, "norm").filter("elders <> theaterId").select("seq", "theaterId", "elders", "n", "eerste")


def other_dates(shows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Dates of the same title at the same venue for each chosen row; none where it is the only one."""
    titles = chosen.select(F.col("seq").alias("gekozen"), "theaterId", "titel")
    rows = titles.join(shows.select("theaterId", "titel", "datum", "tijd", "seq", "beschikbaarheid"), ["theaterId", "titel"])
    several = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("gekozen"))).filter("n > 1")
    return several.select("gekozen", "seq", "datum", "tijd", is_cancelled(F.col("beschikbaarheid")).alias("vervallen"), "n")


def first_upcoming(shows: DataFrame, today: date, by: str = "sleutel") -> DataFrame:
    """First performance from today on of each key: by, seq, datum, tijd, titel."""
    first = F.min_by(F.struct("seq", "datum", "tijd", "titel"), F.struct("datum", sort_time(F.col("tijd")), "seq"))
    return shows.filter(F.col("datum") >= F.lit(today)).groupBy(by).agg(first.alias("x")).select(by, "x.*")


def related_venues(shows: DataFrame, chosen: DataFrame, today: date) -> DataFrame:
    """Other venues of each chosen row with their first date from today on, in order: place counts from 1."""
    upcoming = shows.filter(F.col("datum") >= F.lit(today))
    first = upcoming.groupBy("norm", F.col("theaterId").alias("elders"), F.col("theaterNaam").alias("naam")).agg(F.min(F.struct("datum", sort_time(F.col("tijd")).alias("tijd"))).alias("eerste"))
    rows = chosen.select("seq", "theaterId", "norm").join(first, "norm").filter("elders <> theaterId")
    place = F.row_number().over(W.partitionBy("seq").orderBy("eerste", dutch("naam"), "elders"))
    return rows.select("seq", "elders", "naam", F.col("eerste.datum").alias("datum"), place.alias("plaats"))


def map_points(venues: DataFrame, shows: DataFrame, today: date) -> DataFrame:
    """Venues with coordinates and their upcoming performances: adds aantal and actief (some, and not paused)."""
    n = shows.filter(F.col("datum") >= F.lit(today)).groupBy("theaterId").agg(F.count(F.lit(1)).alias("aantal"))
    placed = venues.filter("lat is not null and lng is not null and not isnan(lat) and not isnan(lng)")
    rows = placed.join(n, "theaterId", "left").withColumn("aantal", F.coalesce("aantal", F.lit(0)))
    return rows.withColumn("actief", (F.col("aantal") > 0) & ~F.coalesce("gepauzeerd", F.lit(False)))


def province_rollup(shows: DataFrame) -> DataFrame:
    """Performances, venues and productions by province, city and venue, with subtotals (null columns) at each level."""
    return shows.rollup("provincie", "stad", "theaterId").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("titel").alias("titels"))


def pass_state(shows: DataFrame) -> DataFrame:
    """Pass state of each venue: ja, onbekend or nee; and its share: ja, deels, nee, onbekend."""
    yes, no, unknown = (F.count(F.when(c, 1)) for c in (F.col("podiumpas"), ~F.col("podiumpas"), F.col("podiumpas").isNull()))
    rows = shows.groupBy("theaterId").agg(yes.alias("ja"), no.alias("nee"), unknown.alias("onbekend"))
    state = F.when(F.col("ja") > 0, "ja").when(F.col("onbekend") > 0, "onbekend").otherwise("nee")
    share = F.when((F.col("ja") > 0) & (F.col("nee") == 0) & (F.col("onbekend") == 0), "ja").when(F.col("ja") > 0, "deels").when(F.col("onbekend") > 0, "onbekend").otherwise("nee")
    return rows.select("theaterId", state.alias("stand"), share.alias("aandeel"))


def watchlist_state(shows: DataFrame, items: DataFrame, today: date) -> DataFrame:
    """Each watchlist item (sleutel) with soort komend, vervallen or weg, a label, and its first date.

    Only dates from today on count.  Part of them cancelled gives "k van n data afgelast", all of them "Afgelast" or
    "Verplaatst".
    """
    gone = is_cancelled(F.col("beschikbaarheid"))
    key = F.struct("datum", sort_time(F.col("tijd")).alias("t"), "seq")
    upcoming = shows.filter(F.col("datum") >= F.lit(today)).groupBy("sleutel").agg(
        F.count(F.lit(1)).alias("totaal"),
        F.count(F.when(gone, 1)).alias("vervallen"),
        F.count(F.when(F.col("beschikbaarheid") == "verplaatst", 1)).alias("verplaatst"),
        F.min(F.when(~gone, key)).alias("door"),
        F.min(F.when(gone, key)).alias("niet"),
    )
    rows = items.select("sleutel").distinct().join(upcoming, "sleutel", "left")
    word = F.when(F.col("verplaatst") == F.col("vervallen"), "verplaatst").when(F.col("verplaatst") == 0, "afgelast").otherwise("afgelast of verplaatst")
    kind = F.when(F.col("totaal").isNull(), "weg").when(F.col("door").isNull(), "vervallen").otherwise("komend")
    label = (
        F.when(F.col("totaal").isNull(), "Niet meer in de agenda")
        .when(F.col("door").isNull(), F.when(word == "verplaatst", "Verplaatst").otherwise("Afgelast"))
        .when(F.col("vervallen") > 0, F.concat(F.col("vervallen").cast("string"), F.lit(" van "), F.col("totaal").cast("string"), F.lit(" data "), word))
    )
    return rows.select("sleutel", kind.alias("soort"), label.alias("label"), F.coalesce("door.datum", "niet.datum").alias("eerste"), F.coalesce("vervallen", F.lit(0)).alias("vervallen"), F.coalesce("totaal", F.lit(0)).alias("totaal"))


def union_sizes(sets: DataFrame, venues: DataFrame, slices: int = 32) -> DataFrame:
    """sleutels, n_door, n_alle: how many venues have any key of a set, of those with ``door`` and of all.

    venues: sleutel, theaterId, door, a row a pair.  Venues are dealt into slices; in each a key's venues are the bits of a
    number, and every set is counted there, so neither a set's venues nor a key's leave their slice.
    """

    def fold(batches):
        at, place, door, every = None, {}, {}, {}
        for batch in batches:
            out = []
            for slice_, keys, key, venue, open_ in zip(*(batch.column(n).to_pylist() for n in ("deel", "sleutels", "sleutel", "theaterId", "door"))):
                if slice_ != at:
                    at, place, door, every = slice_, {}, {}, {}
                if keys is None:
                    bit = 1 << place.setdefault(venue, len(place))
                    every[key] = every.get(key, 0) | bit
                    if open_:
                        door[key] = door.get(key, 0) | bit
                    continue
                a = b = 0
                for k in keys:
                    a, b = a | door.get(k, 0), b | every.get(k, 0)
                out.append((keys, a.bit_count(), b.bit_count()))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.string()), pa.int64(), pa.int64()))], ["sleutels", "n_door", "n_alle"])

    asked = sets.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("deel"), "sleutels")
    rows = venues.filter("theaterId IS NOT NULL").select(F.pmod(F.hash("theaterId"), F.lit(slices)).alias("deel"), "sleutel", "theaterId", "door").unionByName(asked, allowMissingColumns=True)
    # a slice's venues come before its sets
    ordered = rows.repartition("deel").sortWithinPartitions("deel", F.col("sleutels").isNotNull())
    part = ordered.mapInArrow(fold, "sleutels array<string>, n_door bigint, n_alle bigint")
    return part.groupBy("sleutels").agg(F.sum("n_door").alias("n_door"), F.sum("n_alle").alias("n_alle"))


def watchlist_lines(items: DataFrame, groups: DataFrame, shows: DataFrame, today: date) -> DataFrame:
    """user, groep, soort, eerste, tijd, titel, theaters, plaatsnaam, podiumpas and volgorde of each line of a watchlist.

    items: user, sleutel, titel, maker; groups: user, groep, sleutels (``state.group_watchlist``).  A line takes in the
    performances of all its keys from today on.  Venues are those where it still takes place, or where it would have,
    if all is cancelled.  Lines that come first have a date that takes place, then cancelled ones, each by first date;
    last those that are gone, by title.  Performances are summed up by key before they meet the users' lists.
    """
    gone = is_cancelled(F.col("beschikbaarheid"))
    shown = F.struct("datum", sort_time(F.col("tijd")).alias("t"), "seq", "titel", "maker", "theaterNaam", "podiumpas")
    coming = shows.filter(F.col("datum") >= F.lit(today))
    venues = coming.groupBy("sleutel", "theaterId").agg(F.max(~gone).alias("door"))
    count = lambda c: F.count(F.when(c, F.col("theaterId"))).alias
    of = coming.groupBy("sleutel").agg(F.min(F.when(~gone, shown)).alias("door"), F.min(F.when(gone, shown)).alias("niet"))
    of = of.join(venues.groupBy("sleutel").agg(count(F.col("door"))("n_door"), count(F.lit(True))("n_alle")), "sleutel")
    keys = groups.select("user", "groep", F.explode("sleutels").alias("sleutel"))
    own = items.groupBy("user", "sleutel").agg(F.min(F.struct("titel", "maker")).alias("eigen"))
    lines = keys.join(own, ["user", "sleutel"], "left").join(of, "sleutel", "left").groupBy("user", "groep").agg(
        F.min("door").alias("door"), F.min("niet").alias("niet"), F.max("n_door").alias("n_door"), F.max("n_alle").alias("n_alle"), F.min_by("eigen", "sleutel").alias("eigen")
    )
    # lines of several keys: each set of keys is counted once, whoever has it
    several = groups.select("user", "groep", F.array_sort(F.array_distinct("sleutels")).alias("sleutels")).filter("size(sleutels) > 1")
    counted = several.join(union_sizes(several.select("sleutels").distinct(), venues), "sleutels").select("user", "groep", F.col("n_door").alias("_door"), F.col("n_alle").alias("_alle"))
    lines = lines.join(counted, ["user", "groep"], "left").withColumns({"n_door": F.coalesce("_door", "n_door"), "n_alle": F.coalesce("_alle", "n_alle")})
    first = F.coalesce("door", "niet")
    n = F.when(F.col("door").isNotNull(), F.col("n_door")).otherwise(F.col("n_alle")).cast("int")
    more = F.concat(F.lit(" en "), (n - 1).cast("string"), F.when(n == 2, " ander theater").otherwise(" andere theaters"))
    kind = F.when(F.col("door").isNotNull(), "komend").when(F.col("niet").isNotNull(), "vervallen").otherwise("weg")
    titled = F.when(first.isNotNull(), X.display_title(first["titel"], first["maker"])).otherwise(X.display_title(F.col("eigen.titel"), F.col("eigen.maker")))
    out = lines.select(
        "user", "groep", kind.alias("soort"), first["datum"].alias("eerste"), F.nullif(first["t"], F.lit("99:99")).alias("tijd"), titled.alias("titel"), F.when(first.isNotNull(), n).otherwise(0).alias("theaters"),
        F.when(first.isNotNull(), F.concat(first["theaterNaam"], F.when(n > 1, more).otherwise(""))).alias("plaatsnaam"), F.col("door.podiumpas").alias("podiumpas"), first["seq"].alias("_seq"),
    )
    order = W.partitionBy("user").orderBy(F.when(F.col("soort") == "komend", 0).when(F.col("soort") == "vervallen", 1).otherwise(2), "eerste", sort_time(F.col("tijd")), "_seq", "titel", "groep")
    return out.withColumn("volgorde", F.row_number().over(order)).drop("_seq")


def calendar_text(rows: DataFrame, stamp: Column, product: str = "-//Marquee//NL") -> DataFrame:
    """seq and the calendar file of each performance: two hours long, at 20:00 where the time is unknown."""
    start = F.to_timestamp(F.concat_ws(" ", F.col("datum").cast("string"), F.coalesce("tijd", F.lit("20:00"))), "yyyy-MM-dd HH:mm")
    when = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    lines = [
        F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit(f"PRODID:{product}"), F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), F.regexp_replace("seq", "(?i)[^a-z0-9-]+", "-"), F.lit("@marquee")),
        F.concat(F.lit("DTSTAMP:"), when(stamp)), F.concat(F.lit("DTSTART:"), when(start)), F.concat(F.lit("DTEND:"), when(start + F.expr("INTERVAL 2 HOURS"))),
        F.concat(F.lit("SUMMARY:"), X.escaped_ics(F.col("titel"))), F.concat(F.lit("LOCATION:"), X.escaped_ics(F.concat_ws(", ", "theaterNaam", "stad"))),
        F.lit("END:VEVENT"), F.lit("END:VCALENDAR"), F.lit(""),
    ]
    return rows.select("seq", F.array_join(F.array(*lines), "\r\n").alias("ics"))
