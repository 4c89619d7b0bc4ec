"""Queries on title rules, older lists, reports, saved interface answers, and the nightly refresh as a whole."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lists as LI
from ..operators import nightly as N
from ..operators import reports as R
from ..operators import titles as T
from ..sources import api as P
from .shows import SHOW_SQL, TODAY, sql_parts, table
from .shows import shows as read_shows

DAY = date.fromisoformat(TODAY)


def _s(c) -> F.Column:
    return c.cast("string")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as two lines of a source: a name, and a second line of several kinds."""
    p = table(spark, sf_dir, "part")
    second = F.element_at(F.array(F.initcap("p_name"), F.lit("met o.a. Jan"), F.lit("door Mia Bos"), F.lit(" "), F.concat(F.lit("Ada Lint "), "p_name"), F.lit("try-out"), F.lit("Kintsugi.")), (F.col("p_partkey") % 7 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("seq"), F.lit("Ada Lint").alias("kop"), second.alias("ondertitel"), F.element_at(F.array(F.lit("maker-titel"), F.lit("titel-maker"), F.lit("titel-beschrijving"), F.lit(None)), (F.floor(F.col("p_partkey") / 7) % 4 + 1).cast("int")).alias("volgorde"), F.when(F.col("p_partkey") % 5 == 0, "oud").alias("beschrijving"), F.when(F.col("p_partkey") % 2 == 0, "Cabaret").otherwise("Dans").alias("genre"))


def title_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumns({"titel": F.col("kop"), "maker": F.col("ondertitel"), "volgordeZeker": F.lit(False)})
    return T.convention(rows, "kop", "ondertitel", maker_empties=True).select("seq", "titel", "maker", "volgordeZeker")


def title_from_two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.from_two_lines(_lines(spark, sf_dir)).select("seq", "titel", "maker", "beschrijving")


def titles_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir)
    swapped = spark.createDataFrame([(f"v{i}", "Trio Vers | red ring") for i in range(50)] + [(f"v{i}", "Bo Café - blue bolt") for i in range(50)], "theaterId string, titel string")
    of = spark.createDataFrame([(f"v{i}", "HOT ROD", "De Race", date(1998, 3, 1)) for i in range(60)], "theaterId string, titel string, voorstelling string, tot date")
    return T.swap_listed(rows, swapped, of).select("seq", "titel", "maker")


def order_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = F.initcap("p_name"), F.lit("Mia en Bo")
    slug = F.when(F.col("p_partkey") % 3 == 0, F.concat(X.slug(a), F.lit("-"), X.slug(b))).when(F.col("p_partkey") % 3 == 1, F.concat(X.slug(b), F.lit("-"), X.slug(a))).otherwise("iets-anders")
    show, artist = T.order_by_slug(F.concat(F.lit("/agenda/"), slug, F.lit("/1998/")), a, b)
    return p.select("p_partkey", show.alias("voorstelling"), artist.alias("artiest"))


def favourites_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, F.concat(F.lit("v"), _s(k % 9), F.lit("::Het Bos – Ada"))).when(k % 3 == 1, F.concat(F.lit("v1-het-bos-de-musical-"), _s(k % 4), F.lit("-1998-01-01-2000"))).otherwise("onzin")
    known = spark.createDataFrame([("het bos", "Het Bos (8+)"), ("het bos 3", "Het Bos 3")], "sleutel string, titel string")
    return LI.from_favourites(c.select(k.alias("user"), value.alias("waarde")), known)


def favourites_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir)
    titles = rows.select("titel").distinct()
    f = titles.select(F.length("titel").alias("user"), F.concat(F.lit("v1::"), "titel").alias("waarde"))
    moves = spark.createDataFrame([("v1", "v2")], "van string, naar string")
    return LI.move_favourites(f, rows, moves)


def key_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    items = p.select(k.alias("id"), F.when(k % 10 == 0, "Medusa").otherwise(F.concat("p_name", F.lit(" 8+"))).alias("titel"), F.when(k % 4 != 0, F.concat(F.lit("v"), _s(k % 5))).alias("theaterId"), (k % 3).alias("op"), F.when(k % 6 != 0, (k % 5).cast("int")).alias("v"), F.lit("oud").alias("sleutel"))
    return LI.upgrade_keys(items).select("id", "sleutel", "v")


def plan_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every performance as a plan, and the plans as visits."""
    rows = read_shows(spark, sf_dir)
    odd = F.substring("seq", 10, 1).cast("int") % 2 == 0
    plans = rows.select(F.col("seq").alias("plan"), F.when(odd, F.col("seq")).alias("seq"), "theaterId", "datum", "tijd", F.lit("Oud").alias("titel"), F.lit("Wie").alias("maker"), F.lit("Dans").alias("genre"), F.lit("Stad").alias("stad"), F.lit(None).cast("boolean").alias("podiumpas"))
    return LI.visit_of(plans, rows)


def last_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    items = e.filter("event_type = 'view'").select(F.col("user_id").alias("user"), F.col("event_id").alias("op"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 2).alias("gewijzigd"))
    return LI.last_action(items, e.filter("event_type = 'error'").select(F.col("user_id").alias("user"), F.col("event_id").alias("op")))


def _venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("supplier", "nation", "region")}
    return spark.sql("SELECT concat('v', s_suppkey) AS theaterId, s_suppkey % 8 = 0 AS gepauzeerd, s_name AS naam, n_name AS stad, r_name AS provincie, CASE WHEN s_suppkey % 16 = 0 THEN 'Dicht | verbouwing' END AS melding, s_suppkey % 3 = 0 AS podiumpas, 'https://x.example/agenda' AS agendaUrl, CASE WHEN s_suppkey % 5 <> 0 THEN 52.5D END AS lat, CASE WHEN s_suppkey % 5 <> 0 THEN 4.5D END AS lng FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey", **t)


def venue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.venue_view(_venues(spark, sf_dir))


def venue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _venues(spark, sf_dir)
    status = v.select("theaterId", F.when(F.col("gepauzeerd"), "gepauzeerd").otherwise("ok").alias("status")).filter("theaterId <> 'v5'")
    return R.report(v, read_shows(spark, sf_dir).filter("theaterId <> 'v6'"), status)


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counts(_venues(spark, sf_dir), read_shows(spark, sf_dir))


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("subtitle"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("itix_from_raw"), F.lit("reserveren").alias("itix_show_status"))
    pages = o.groupBy(F.floor(F.col("o_orderkey") / 100).alias("p")).agg(F.to_json(F.struct(F.lit(1).alias("pages"), (F.first(F.floor(F.col("o_orderkey") / 100)) + 1).cast("int").alias("currentPage"), F.collect_list(row).alias("raw"))).alias("json"))
    return P.paged_rows(pages).select("id", "titel", "maker", "datum", "tijd", "status")


def place_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    loc = F.element_at(F.array(*[F.lit(x) for x in ("Huis aan de Kade, zaal 1", "AINSI", "Overige locaties", "Kerk", "", "Loods Heerlen")]), (k % 6 + 1).cast("int"))
    extra = F.element_at(F.array(*[F.lit(x) for x in ("Theatercafé", "Park", None)]), (F.floor(k / 6) % 3 + 1).cast("int"))
    venue, place = P.place_of(loc, extra, "huis", "huis aan de kade", "heerlen", "Maastricht", {"ainsi": "ainsi"})
    return p.select("p_partkey", venue.alias("theaterId"), place.alias("locatie"))


def card_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of two cards each: one with a panel of dates, one with a date on the card."""
    p = table(spark, sf_dir, "part")
    sub = lambda d, b: F.concat(F.lit(f'<li class="subshow"><span class="date"><span class="start">{d} sep</span></span><span class="time">20.15 uur</span><a class="btn x">{b}</a></li>'))
    html = F.concat(
        F.lit('<ul><li data-entry-id="'), _s(F.col("p_partkey")), F.lit('a"><h3 class="title">'), "p_name", F.lit('</h3><p class="subtitle"> <b>'), "p_brand", F.lit('</b></p><span class="price">€ 12,50 - € 20</span><div><ul>'), sub("wo 9", "Bestel"), sub("do 10", "Uitverkocht"), sub("vr 11", "Verkoop elders"), F.lit('</ul></div></li><li data-entry-id="'),
        _s(F.col("p_partkey")), F.lit('b"><h3 class="title">Los</h3><div class="dateTimeContainer"><div class="dateTimeInner"><span class="start">ma 1 okt</span><span class="time">9:00</span><a class="btn">Wachtlijst</a></div></div></li></ul>'),
    )
    return P.card_dates(P.cards(p.select("p_partkey", html.alias("html")), "p_partkey"), "p_partkey")


def nightly_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole refresh on half of the lines as the run and the other half as what was there before."""
    rows = read_shows(spark, sf_dir).drop("norm", "sleutel", "vorm", "zoek").withColumn("beschrijving", F.lit(None).cast("string"))
    odd = F.substring("seq", 10, 1).cast("int") % 2
    venues = rows.select("theaterId").distinct().withColumn("error", F.when(F.col("theaterId") == "v3", "stuk")).filter("theaterId <> 'v4'")
    out, _ = N.refresh(rows.filter(odd == 0), rows.filter(odd == 1), venues, N.Lists(), DAY)
    return out.select("seq", "theaterId", "datum", "tijd", "titel", "titelBron", "maker", "makerBron", "genre", "genreBron", "sleutel")


QUERIES = {
    f.__name__: f
    for f in (
        title_convention, title_from_two_lines, titles_swapped, order_by_slug, favourites_migrated, favourites_moved, key_upgrade, plan_visits, last_actions, venue_view, venue_report, report_counts, paged_listing,
        place_routing, card_dates, nightly_refresh,
    )
}

_LINES = """WITH l AS (SELECT p_partkey AS seq, p_partkey % 7 AS k, p_partkey // 7 % 4 AS o, upper(p_name[1]) || p_name[2:instr(p_name, ' ')] || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS naam, p_name, p_partkey % 2 = 0 AS cab, CASE WHEN p_partkey % 5 = 0 THEN 'oud' END AS b FROM part)"""
_VENUES = "v AS (SELECT 'v' || s_suppkey AS theaterId, s_suppkey % 8 = 0 AS dicht, s_suppkey, s_name AS naam, n_name AS stad, r_name AS provincie FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"

ORACLE_SQL = {
    "title_convention": _LINES
    + """SELECT seq, CASE WHEN NOT cab OR k IN (1, 3, 5) THEN 'Ada Lint' WHEN k = 0 THEN naam || ' – Ada Lint' WHEN k = 2 THEN 'door Mia Bos – Ada Lint' WHEN k = 4 THEN 'Ada Lint ' || p_name ELSE 'Kintsugi – Ada Lint' END AS titel,
 CASE WHEN cab AND k NOT IN (1, 3, 5) THEN NULL ELSE CASE k WHEN 0 THEN naam WHEN 1 THEN 'met o.a. Jan' WHEN 2 THEN 'door Mia Bos' WHEN 3 THEN ' ' WHEN 4 THEN 'Ada Lint ' || p_name WHEN 5 THEN 'try-out' ELSE 'Kintsugi.' END END AS maker, cab AND k IN (0, 2, 6) AS "volgordeZeker" FROM l""",
    "title_from_two_lines": _LINES
    + """SELECT seq, CASE WHEN o = 3 AND k NOT IN (1, 2, 5) THEN NULL WHEN o <> 0 OR k IN (1, 2, 3, 5) THEN 'Ada Lint' WHEN k = 0 THEN naam || ' – Ada Lint' WHEN k = 4 THEN 'Ada Lint ' || p_name ELSE 'Kintsugi – Ada Lint' END AS titel,
 CASE WHEN k = 2 THEN 'Mia Bos' WHEN o = 1 AND k IN (0, 4, 6) THEN CASE k WHEN 0 THEN naam WHEN 4 THEN 'Ada Lint ' || p_name ELSE 'Kintsugi.' END END AS maker,
 CASE WHEN k IN (1, 5) THEN coalesce(b, CASE k WHEN 1 THEN 'met o.a. Jan' ELSE 'try-out' END) WHEN o = 2 AND k IN (0, 4, 6) THEN coalesce(b, CASE k WHEN 0 THEN naam WHEN 4 THEN 'Ada Lint ' || p_name ELSE 'Kintsugi.' END) ELSE b END AS beschrijving FROM l""",
    "titles_swapped": SHOW_SQL
    + """SELECT seq, CASE WHEN titel = 'HOT ROD' AND substr(theaterId, 2)::INT < 60 AND datum <= DATE '1998-03-01' THEN 'De Race' WHEN titel IN ('Trio Vers - red ring', 'Bo Café - blue bolt') AND substr(theaterId, 2)::INT < 50 AND maker IS NOT NULL THEN maker ELSE titel END AS titel,
 CASE WHEN titel = 'HOT ROD' AND substr(theaterId, 2)::INT < 60 AND datum <= DATE '1998-03-01' THEN titel WHEN titel IN ('Trio Vers - red ring', 'Bo Café - blue bolt') AND substr(theaterId, 2)::INT < 50 AND maker IS NOT NULL THEN titel ELSE maker END AS maker FROM perf""",
    "order_by_slug": """WITH l AS (SELECT p_partkey, upper(p_name[1]) || p_name[2:instr(p_name, ' ')] || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS naam FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN naam WHEN 1 THEN 'Mia en Bo' END AS voorstelling, CASE p_partkey % 3 WHEN 0 THEN 'Mia en Bo' WHEN 1 THEN naam END AS artiest FROM l""",
    "favourites_migrated": """SELECT c_custkey AS "user", 'ada | het bos' AS sleutel, 'Het Bos – Ada' AS titel, 'v' || (c_custkey % 9) AS theaterId, 0::BIGINT AS op, 'favoriet' AS variant FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'het bos', 'Het Bos (8+)', 'v1', 0, 'het bos de musical' FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 4 <> 3 UNION ALL SELECT c_custkey, 'het bos 3', 'Het Bos 3', 'v1', 0, 'letterlijk' FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 4 = 3""",
    "favourites_moved": SHOW_SQL
    + """, t AS (SELECT DISTINCT titel FROM perf), a AS (SELECT DISTINCT titel FROM perf WHERE theaterId = 'v1'), b AS (SELECT DISTINCT titel FROM perf WHERE theaterId = 'v2')
SELECT DISTINCT length(titel)::INT AS "user", CASE WHEN titel NOT IN (FROM a) AND titel IN (FROM b) THEN 'v2::' ELSE 'v1::' END || titel AS waarde FROM t""",
    "key_upgrade": f"""WITH i AS (SELECT p_partkey AS id, p_partkey % 10 = 0 AS m, p_name, CASE WHEN p_partkey % 4 <> 0 THEN 'v' || (p_partkey % 5) END AS th, p_partkey % 3 AS op, coalesce(CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 5 END, 1) AS v FROM part)
SELECT id, CASE WHEN v >= 4 OR (m AND th IS NULL) THEN 'oud' WHEN m THEN th || '::medusa' ELSE array_to_string({sql_parts("p_name || ' 8+'")}, ' | ') END AS sleutel, 4::INT AS v FROM i WHERE NOT (v < 4 AND m AND th IS NULL AND op = 0)""",
    "plan_visits": SHOW_SQL
    + """SELECT seq AS plan, theaterId, datum, tijd, CASE WHEN substr(seq, 10, 1)::INT % 2 = 1 THEN 'Oud – Wie' WHEN maker IS NULL OR contains(' ' || norm || ' ', ' ' || trim(regexp_replace(strip_accents(lower(maker)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ') THEN titel ELSE titel || ' – ' || maker END AS titel,
 CASE WHEN substr(seq, 10, 1)::INT % 2 = 1 THEN 'Wie' ELSE coalesce(maker, 'Wie') END AS maker, CASE WHEN substr(seq, 10, 1)::INT % 2 = 1 THEN 'Dans' ELSE coalesce(genre, 'Dans') END AS genre, CASE WHEN substr(seq, 10, 1)::INT % 2 = 1 THEN 'Stad' ELSE stad END AS stad, CASE WHEN substr(seq, 10, 1)::INT % 2 = 0 THEN coalesce(podiumpas, false) END AS podiumpas FROM perf""",
    "last_actions": """SELECT user_id AS "user", max(CASE WHEN event_type = 'view' AND event_id % 3 = 0 THEN event_id * 2 ELSE event_id END) AS stand FROM events WHERE event_type IN ('view', 'error') GROUP BY 1""",
    "venue_view": f"""WITH {_VENUES} SELECT theaterId, '{{' || array_to_string(['"naam":"' || naam || '"', '"stad":"' || stad || '"', '"podiumpas":' || (s_suppkey % 3 = 0),
 CASE WHEN s_suppkey % 16 = 0 THEN '"melding":"Dicht | verbouwing"' WHEN dicht THEN '"melding":"Agenda tijdelijk niet beschikbaar. Bekijk de voorstellingen op de website van het theater."' END, CASE WHEN dicht AND s_suppkey % 16 <> 0 THEN '"meldingLink":"https://x.example/agenda"' END,
 CASE WHEN s_suppkey % 5 <> 0 THEN '"lat":52.5' END, CASE WHEN s_suppkey % 5 <> 0 THEN '"lng":4.5' END, CASE WHEN dicht THEN '"gepauzeerd":true' END], ',') || '}}' AS json FROM v""",
    "venue_report": SHOW_SQL
    + f""", {_VENUES}, c AS (SELECT theaterId, count(*) FILTER (podiumpas) AS ja, count(*) FILTER (NOT podiumpas) AS nee, count(*) FILTER (podiumpas IS NULL) AS onb FROM perf WHERE theaterId <> 'v6' GROUP BY 1),
r AS (SELECT provincie, stad, naam, '| ' || naam || ' | ' || stad || ' | ' || coalesce(CASE WHEN ja > 0 AND nee = 0 AND onb = 0 THEN 'ja' WHEN ja > 0 THEN 'deels' WHEN onb > 0 THEN 'onbekend' WHEN nee > 0 THEN 'nee' END, '–') || ' | ' || CASE WHEN theaterId = 'v5' THEN 'onbekend' WHEN dicht THEN 'gepauzeerd' ELSE 'ok' END || ' |' AS l FROM v LEFT JOIN c USING (theaterId))
SELECT provincie, count(*) AS n, '**' || provincie || '** (' || count(*) || ')' || chr(10) || chr(10) || '| Theater | Stad | Podiumpas | Status |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg(l, chr(10) ORDER BY stad, naam) AS tekst FROM r GROUP BY 1""",
    "report_counts": SHOW_SQL + "SELECT (SELECT count(*) FROM supplier) AS theaters, count(DISTINCT (theaterId, titel)) AS titels, count(*) AS speeldata FROM perf",
    "paged_listing": """SELECT o_orderkey AS id, o_orderpriority AS titel, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS maker, timezone('Europe/Amsterdam', timezone('UTC', o_orderdate))::DATE AS datum, strftime(timezone('Europe/Amsterdam', timezone('UTC', o_orderdate)), '%H:%M') AS tijd, 'reserveren' AS status FROM orders WHERE o_orderkey < 3000""",
    "place_routing": """WITH l AS (SELECT p_partkey, p_partkey % 6 AS k, p_partkey // 6 % 3 AS e FROM part)
SELECT p_partkey, CASE k WHEN 5 THEN NULL WHEN 1 THEN 'ainsi' ELSE 'huis' END AS theaterId, CASE WHEN k = 2 AND e = 1 THEN 'Park | Maastricht' WHEN k = 3 THEN 'Kerk | Maastricht' END AS locatie FROM l""",
    "card_dates": """SELECT p_partkey, p_partkey || 'a' AS entry, p_name AS titel, p_brand AS maker, NULL::VARCHAR AS genre, 12.5::DOUBLE AS prijs, unnest(['wo 9 sep', 'do 10 sep']) AS dag, '20:15' AS tijd, unnest(['beschikbaar', 'uitverkocht']) AS beschikbaarheid FROM part
UNION ALL SELECT p_partkey, p_partkey || 'b', 'Los', NULL, NULL, NULL, 'ma 1 okt', '09:00', 'wachtlijst' FROM part""",
}
