"""Agenda queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import agenda as A
from .shows import SHOW_SQL, TODAY, sql_norm, table
from .shows import shows as read_shows

DAY = date.fromisoformat(TODAY)


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on a watchlist: every part as a production of Ada Lint, who makes some of them."""
    from ..functions import text as X

    p = table(spark, sf_dir, "part")
    return p.select(X.production_key(F.concat("p_name", F.lit(" – Ada Lint")), F.lit(None).cast("string")).alias("sleutel")).distinct()


WATCHED_SQL = "watched AS (SELECT DISTINCT array_to_string(list_sort(['ada lint', p_name]), ' | ') AS sleutel FROM part)"
_COLUMNS = ("seq", "theaterId", "datum", "tijd", "titel")


def agenda_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.agenda(read_shows(spark, sf_dir), DAY, venues_off=("v3", "v7"), genres=("Cabaret", "Overig"), passes_only=True, hide_full=True, when=D.When(weekdays=(5, 6, 7)))
    return rows.select(*_COLUMNS)


def agenda_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_date(A.agenda(read_shows(spark, sf_dir), DAY, genres=("Dans",)))


def agenda_hidden_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hidden_count(A.agenda(read_shows(spark, sf_dir), DAY, passes_only=True, window=False), DAY)


def search_short_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.agenda(read_shows(spark, sf_dir), DAY, search="CAF").select(*_COLUMNS)


def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.agenda(read_shows(spark, sf_dir), DAY, search="  heatre n").select(*_COLUMNS)


def quick_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day of every quick choice on each day that has performances."""
    days = read_shows(spark, sf_dir).select("datum").distinct()
    ranges = F.array(*[F.struct(F.lit(q).alias("keuze"), a.alias("van"), b.alias("tot")) for q in D.QUICK for a, b in [D.quick_range(q, F.col("datum"))]])
    return days.select("datum", F.inline(ranges))


def when_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.agenda(read_shows(spark, sf_dir), DAY, when=D.When(first=date(1998, 4, 1), last=date(1998, 3, 1), weekdays=(1, 6)))
    return rows.groupBy("datum").agg(F.count(F.lit(1)).alias("n"))


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("van"))
    o = o.withColumn("tot", F.when(F.col("o_orderkey") % 5 != 0, F.date_add("van", (F.col("o_orderkey") % 90).cast("int") - 30))).withColumn("van", F.when(F.col("o_orderkey") % 7 != 0, F.col("van")))
    return o.select("o_orderkey", D.range_text(F.col("van"), F.col("tot")).alias("tekst"), D.day_text(F.col("van")).alias("dag"))


def pass_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.agenda(read_shows(spark, sf_dir), DAY, passes_only=True).groupBy("theaterId", "podiumpas").agg(F.count(F.lit(1)).alias("n"))


def facet_cascade_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.facet_cascade(read_shows(spark, sf_dir), True)


def on_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.agenda(read_shows(spark, sf_dir), DAY, watchlist=watched(spark, sf_dir)).select(*_COLUMNS)


def hide_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.agenda(read_shows(spark, sf_dir), DAY, seen=watched(spark, sf_dir)).groupBy("theaterId").agg(F.count(F.lit(1)).alias("n"))


def _chosen(rows: DataFrame) -> DataFrame:
    """Performances whose detail is asked for: those of venue v5 on the day."""
    return rows.filter((F.col("theaterId") == "v5") & (F.col("datum") == F.lit(DAY)))


def also_playing_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir)
    return A.also_playing_at(rows, _chosen(rows))


def other_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir)
    return A.other_dates(rows, rows.filter(F.col("datum") == F.lit(DAY)))


def related_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir)
    return A.related_venues(rows, _chosen(rows), DAY)


def first_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_upcoming(read_shows(spark, sf_dir), DAY)


def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    venues = s.select(F.concat(F.lit("v"), "s_suppkey").alias("theaterId"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal") / 1000).alias("lat"), (F.col("s_acctbal") / 2000).alias("lng"), (F.col("s_suppkey") % 4 == 0).alias("gepauzeerd"))
    return A.map_points(venues, read_shows(spark, sf_dir), DAY).select("theaterId", "aantal", "actief")


def province_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.province_rollup(read_shows(spark, sf_dir))


def venue_pass_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pass_state(read_shows(spark, sf_dir))


def watchlist_stand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.watchlist_state(read_shows(spark, sf_dir), watched(spark, sf_dir).union(spark.createDataFrame([("bestaat niet",)], "sleutel string")), date(1998, 4, 28))


def calendar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir).filter("theaterId = 'v5'")
    return A.calendar_text(rows, F.lit("1998-01-01 12:00:00").cast("timestamp"))


QUERIES = {
    f.__name__: f
    for f in (
        agenda_filter, agenda_by_date, agenda_hidden_count, search_short_prefix, search_substring, quick_ranges, when_filter, date_texts, pass_tristate, facet_cascade_all, on_watchlist, hide_seen,
        also_playing_at, other_dates, related_venues, first_upcoming, map_points, province_rollup, venue_pass_state, watchlist_stand, calendar_text,
    )
}

_SEL = "SELECT seq, theaterId, datum, tijd, titel FROM perf"
_WIN = f"datum >= DATE '{TODAY}' AND datum <= DATE '{TODAY}' + 30"
_CANC = "beschikbaarheid IN ('afgelast', 'verplaatst')"
_TIME = "coalesce(tijd, '99:99')"
_CHOSEN = f"chosen AS (SELECT * FROM perf WHERE theaterId = 'v5' AND datum = DATE '{TODAY}')"
_SHOWN = f"(CASE WHEN maker IS NULL OR contains(' ' || {sql_norm('titel')} || ' ', ' ' || {sql_norm('maker')} || ' ') THEN titel ELSE titel || ' – ' || maker END)"
_SEARCHED = f"searched AS (SELECT *, list_transform(list_filter([{_SHOWN}, maker, theaterNaam, stad], lambda t: t IS NOT NULL), lambda t: trim(regexp_replace(strip_accents(lower(t)), '\\s+', ' ', 'g'))) AS teksten FROM perf)"
_MONTHS = "['jan', 'feb', 'mrt', 'apr', 'mei', 'jun', 'jul', 'aug', 'sep', 'okt', 'nov', 'dec']"


def _short(d: str, year: bool = False) -> str:
    return f"(day({d}) || ' ' || {_MONTHS}[month({d})]" + (f" || ' ' || year({d}))" if year else ")")


ORACLE_SQL = {
    "agenda_filter": SHOW_SQL + f"{_SEL} WHERE {_WIN} AND theaterId NOT IN ('v3', 'v7') AND coalesce(genre, 'Overig') IN ('Cabaret', 'Overig') AND coalesce(podiumpas, true) AND beschikbaarheid NOT IN ('uitverkocht', 'wachtlijst') AND isodow(datum) IN (5, 6, 7)",
    "agenda_by_date": SHOW_SQL + f"SELECT datum, count(*) AS n, list(titel ORDER BY {_TIME}, seq) AS titels FROM perf WHERE {_WIN} AND genre = 'Dans' GROUP BY 1",
    "agenda_hidden_count": SHOW_SQL + f"SELECT count(*) AS alle, count(*) FILTER (datum <= DATE '{TODAY}' + 30) AS binnen, count(*) FILTER (datum > DATE '{TODAY}' + 30) AS verborgen FROM perf WHERE datum >= DATE '{TODAY}' AND coalesce(podiumpas, true)",
    "search_short_prefix": SHOW_SQL + f", {_SEARCHED} SELECT seq, theaterId, datum, tijd, titel FROM searched WHERE datum >= DATE '{TODAY}' AND len(list_filter(teksten, lambda t: regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}])caf'))) > 0",
    "search_substring": SHOW_SQL + f", {_SEARCHED} SELECT seq, theaterId, datum, tijd, titel FROM searched WHERE datum >= DATE '{TODAY}' AND len(list_filter(teksten, lambda t: contains(t, 'heatre n'))) > 0",
    "quick_ranges": SHOW_SQL + """, d AS (SELECT DISTINCT datum, isodow(datum)::INT AS wd FROM perf)
SELECT datum, 'vandaag' AS keuze, datum AS van, datum AS tot FROM d UNION ALL SELECT datum, 'morgen', datum + 1, datum + 1 FROM d
UNION ALL SELECT datum, 'weekend', greatest(datum, datum + (5 - wd)), datum + (7 - wd) FROM d UNION ALL SELECT datum, 'week', datum, datum + (7 - wd) FROM d
UNION ALL SELECT datum, 'volgendeWeek', datum + (8 - wd), datum + (14 - wd) FROM d UNION ALL SELECT datum, 'maand', datum, last_day(datum) FROM d""",
    "when_filter": SHOW_SQL + f"SELECT datum, count(*) AS n FROM perf WHERE datum >= DATE '{TODAY}' AND datum BETWEEN DATE '1998-03-01' AND DATE '1998-04-01' AND isodow(datum) IN (1, 6) GROUP BY 1",
    "date_texts": f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders), p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN d END AS van, CASE WHEN o_orderkey % 5 <> 0 THEN d + ((o_orderkey % 90)::INT - 30) END AS tot FROM o),
q AS (SELECT o_orderkey, van AS eigen, CASE WHEN van IS NOT NULL AND tot IS NOT NULL THEN least(van, tot) ELSE van END AS a, CASE WHEN van IS NOT NULL AND tot IS NOT NULL THEN greatest(van, tot) ELSE tot END AS b FROM p)
SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN '' WHEN b IS NULL THEN 'vanaf ' || {_short('a')} WHEN a IS NULL THEN 't/m ' || {_short('b')} WHEN a = b THEN {_short('a')}
 WHEN year(a) = year(b) AND month(a) = month(b) THEN day(a) || '–' || {_short('b')} WHEN year(a) = year(b) THEN {_short('a')} || ' – ' || {_short('b')} ELSE {_short('a', True)} || ' – ' || {_short('b', True)} END AS tekst,
 ['ma', 'di', 'wo', 'do', 'vr', 'za', 'zo'][isodow(eigen)] || ' ' || {_short('eigen')} AS dag FROM q""",
    "pass_tristate": SHOW_SQL + f"SELECT theaterId, podiumpas, count(*) AS n FROM perf WHERE {_WIN} AND coalesce(podiumpas, true) GROUP BY 1, 2",
    "facet_cascade_all": SHOW_SQL + "SELECT DISTINCT theaterId, theaterNaam, stad FROM perf WHERE coalesce(podiumpas, true)",
    "on_watchlist": SHOW_SQL + f", {WATCHED_SQL} {_SEL} WHERE {_WIN} AND sleutel IN (SELECT sleutel FROM watched)",
    "hide_seen": SHOW_SQL + f", {WATCHED_SQL} SELECT theaterId, count(*) AS n FROM perf WHERE {_WIN} AND sleutel NOT IN (SELECT sleutel FROM watched) GROUP BY 1",
    "also_playing_at": SHOW_SQL + f", {_CHOSEN} SELECT c.seq, c.theaterId, p.theaterId AS elders, count(*) AS n, min(p.datum) AS eerste FROM chosen c JOIN perf p ON p.norm = c.norm AND p.theaterId <> c.theaterId GROUP BY 1, 2, 3",
    "other_dates": SHOW_SQL + f", chosen AS (SELECT * FROM perf WHERE datum = DATE '{TODAY}'), j AS (SELECT c.seq AS gekozen, p.seq, p.datum, p.tijd, p.{_CANC} AS vervallen, count(*) OVER (PARTITION BY c.seq) AS n FROM chosen c JOIN perf p ON p.titel = c.titel AND p.theaterId = c.theaterId) SELECT * FROM j WHERE n > 1",
    "related_venues": SHOW_SQL + f""", {_CHOSEN}, f AS (SELECT norm, theaterId AS elders, theaterNaam AS naam, min((datum, {_TIME})) AS e FROM perf WHERE datum >= DATE '{TODAY}' GROUP BY 1, 2, 3)
SELECT c.seq, elders, naam, e[1] AS datum, row_number() OVER (PARTITION BY c.seq ORDER BY e, naam, elders)::INT AS plaats FROM chosen c JOIN f ON f.norm = c.norm AND elders <> theaterId""",
    "first_upcoming": SHOW_SQL + f", r AS (SELECT sleutel, seq, datum, tijd, titel, row_number() OVER (PARTITION BY sleutel ORDER BY datum, {_TIME}, seq) AS k FROM perf WHERE datum >= DATE '{TODAY}') SELECT sleutel, seq, datum, tijd, titel FROM r WHERE k = 1",
    "map_points": SHOW_SQL + f""", n AS (SELECT theaterId, count(*) AS aantal FROM perf WHERE datum >= DATE '{TODAY}' GROUP BY 1)
SELECT 'v' || s_suppkey AS theaterId, coalesce(aantal, 0) AS aantal, coalesce(aantal, 0) > 0 AND s_suppkey % 4 <> 0 AS actief FROM supplier LEFT JOIN n ON n.theaterId = 'v' || s_suppkey WHERE s_suppkey % 9 <> 0""",
    "province_rollup": SHOW_SQL + "SELECT provincie, stad, theaterId, count(*) AS n, count(DISTINCT titel) AS titels FROM perf GROUP BY ROLLUP (provincie, stad, theaterId)",
    "venue_pass_state": SHOW_SQL + """, c AS (SELECT theaterId, count(*) FILTER (podiumpas) AS ja, count(*) FILTER (NOT podiumpas) AS nee, count(*) FILTER (podiumpas IS NULL) AS onb FROM perf GROUP BY 1)
SELECT theaterId, CASE WHEN ja > 0 THEN 'ja' WHEN onb > 0 THEN 'onbekend' ELSE 'nee' END AS stand, CASE WHEN ja > 0 AND nee = 0 AND onb = 0 THEN 'ja' WHEN ja > 0 THEN 'deels' WHEN onb > 0 THEN 'onbekend' ELSE 'nee' END AS aandeel FROM c""",
    "watchlist_stand": SHOW_SQL + f""", {WATCHED_SQL}, items AS (SELECT sleutel FROM watched UNION SELECT 'bestaat niet'),
u AS (SELECT sleutel, count(*) AS totaal, count(*) FILTER ({_CANC}) AS vervallen, count(*) FILTER (beschikbaarheid = 'verplaatst') AS verplaatst,
 min((datum, {_TIME}, seq)) FILTER (NOT {_CANC}) AS door, min((datum, {_TIME}, seq)) FILTER ({_CANC}) AS niet FROM perf WHERE datum >= DATE '1998-04-28' GROUP BY 1),
w AS (SELECT i.sleutel, u.* EXCLUDE (sleutel), CASE WHEN verplaatst = vervallen THEN 'verplaatst' WHEN verplaatst = 0 THEN 'afgelast' ELSE 'afgelast of verplaatst' END AS woord FROM items i LEFT JOIN u ON u.sleutel = i.sleutel)
SELECT sleutel, CASE WHEN totaal IS NULL THEN 'weg' WHEN door IS NULL THEN 'vervallen' ELSE 'komend' END AS soort,
 CASE WHEN totaal IS NULL THEN 'Niet meer in de agenda' WHEN door IS NULL THEN CASE WHEN woord = 'verplaatst' THEN 'Verplaatst' ELSE 'Afgelast' END WHEN vervallen > 0 THEN vervallen || ' van ' || totaal || ' data ' || woord END AS label,
 coalesce(door[1], niet[1]) AS eerste, coalesce(vervallen, 0) AS vervallen, coalesce(totaal, 0) AS totaal FROM w""",
    "calendar_text": SHOW_SQL + """SELECT seq, array_to_string(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//Marquee//NL', 'BEGIN:VEVENT', 'UID:' || seq || '@marquee', 'DTSTAMP:19980101T120000',
 'DTSTART:' || strftime(datum + coalesce(tijd, '20:00')::TIME, '%Y%m%dT%H%M%S'), 'DTEND:' || strftime(datum + coalesce(tijd, '20:00')::TIME + INTERVAL 2 HOUR, '%Y%m%dT%H%M%S'),
 'SUMMARY:' || titel, 'LOCATION:' || theaterNaam || '\\, ' || stad, 'END:VEVENT', 'END:VCALENDAR', ''], chr(13) || chr(10)) AS ics FROM perf WHERE theaterId = 'v5'""",
}
