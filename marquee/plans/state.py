"""Queries on users' lists and on runs of sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from ..operators import state as S
from .shows import SHOW_SQL, TODAY, sql_parts, table
from .shows import shows as read_shows

DAY = date.fromisoformat(TODAY)
NOW = 1_706_000_000_000  # 23 January 2024


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on lists; times are whole days, so that equal ones occur."""
    e = table(spark, sf_dir, "events")
    day = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")))
    some = lambda c, prefix: F.when(c, F.concat(F.lit(prefix), (F.col("event_id") % 2).cast("string")))
    return e.select(
        F.col("user_id").alias("user"), F.concat(F.lit("k"), (F.floor(F.col("value")) % 5).cast("string")).alias("sleutel"), F.concat(F.lit("Titel "), (F.col("event_id") % 3).cast("string")).alias("titel"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string"))).alias("theaterId"), day.alias("op"),
        some(F.col("event_id") % 5 == 0, "M").alias("maker"), some(F.col("event_id") % 7 == 0, "G").alias("genre"), F.col("event_id").alias("seq"), "event_type", "value",
    )


ACTIONS_SQL = """WITH acties AS (SELECT user_id AS "user", 'k' || (floor(value)::BIGINT % 5) AS sleutel, 'Titel ' || (event_id % 3) AS titel, CASE WHEN event_id % 3 <> 0 THEN 'v' || (event_id % 4) END AS theaterId,
 epoch_ms(date_trunc('day', ts)::TIMESTAMP) AS op, CASE WHEN event_id % 5 = 0 THEN 'M' || (event_id % 2) END AS maker, CASE WHEN event_id % 7 = 0 THEN 'G' || (event_id % 2) END AS genre, event_id AS seq, event_type, value FROM events),
weg AS (SELECT "user", sleutel, max(op) AS weg FROM acties WHERE event_type = 'error' GROUP BY 1, 2)"""


def _watchlist(spark, sf_dir):
    a = _actions(spark, sf_dir)
    return S.merge_watchlist(a.filter("event_type in ('signup', 'view')"), a.filter("event_type = 'error'"))


def lww_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _watchlist(spark, sf_dir)[0]


def lww_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _watchlist(spark, sf_dir)[1]


def plan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _actions(spark, sf_dir)
    plans = a.filter("event_type in ('click', 'view')").select(
        "user", "sleutel", F.when(F.col("event_type") == "click", "kaarten").otherwise("gepland").alias("status"), F.lit("1998-02-01").cast("date").alias("datum"), "op", F.when(F.col("seq") % 11 == 0, "afgelast").when(F.col("seq") % 13 == 0, "verplaatst").alias("vervallen"), "maker", "genre", "seq"
    )
    return S.merge_plans(plans, a.filter("event_type = 'error'"))[0].drop("datum")


def _copies(a: DataFrame) -> DataFrame:
    rated = F.col("seq") % 4 == 0
    return a.filter("event_type in ('purchase', 'click')").select(
        "user", "sleutel", "titel", "op", F.when(F.col("seq") % 6 == 0, F.col("op") + 3 * 86_400_000).alias("gewijzigd"), F.when(rated & (F.col("seq") % 8 == 0), (F.col("seq") % 9 + 2) / 2).alias("beoordeling"), F.when(rated, F.col("op")).alias("beoordeeldOp"), "maker", "genre", "seq"
    )


def _visits(a: DataFrame) -> DataFrame:
    return a.filter("event_type in ('purchase', 'click')").select(
        "seq", F.date_add(F.lit("1998-01-01"), (F.col("seq") % 3).cast("int")).alias("datum"), F.when(F.col("seq") % 2 == 0, "20:00").alias("tijd"), "theaterId", F.when(F.col("seq") % 3 == 1, F.concat(F.lit("Zaal "), (F.col("seq") % 5).cast("string"))).alias("zaal")
    )


def seen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _actions(spark, sf_dir)
    items, _ = S.merge_seen(_copies(a), _visits(a), a.filter("event_type = 'error'"))
    last = S.last_visit(F.col("bezoeken"))
    return items.select("user", "sleutel", "titel", "op", "maker", "genre", "beoordeling", "beoordeeldOp", F.size("bezoeken").alias("n_bezoeken"), last["datum"].alias("laatste"), last["zaal"].alias("zaal"))


def seen_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _actions(spark, sf_dir)
    return S.merge_seen(_copies(a), _visits(a), a.filter("event_type = 'error'"))[1]


def seen_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _actions(spark, sf_dir)
    return S.seen_cleanup(lww_watchlist(spark, sf_dir), _copies(a), NOW)


def temporal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("k1", "n1", "Nieuw 1", date(2024, 1, 15)), ("k1", "n2", "Nieuw 2", None), ("k2", "n1", "Nieuw 1", date(2024, 1, 10)), ("k3", "n3", "Nieuw 3", date(2023, 1, 1))], "oud string, sleutel string, titel string, tot date")
    known = spark.createDataFrame([("k2",)], "sleutel string")
    return S.map_titles(lww_watchlist(spark, sf_dir), known, rules)


def group_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_watchlist(lww_watchlist(spark, sf_dir))


def monotone_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.floor(F.col("value")).alias("stand"), F.col("event_id").alias("seq"), "event_type")
    return S.newest_copy(e)


def accepted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.floor(F.col("value")).alias("stand"), F.col("event_id").alias("seq"))
    return S.accepted_copies(e)


def ttl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    made = F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp"))
    return e.select("event_id", S.expired(made, F.timestamp_millis(F.lit(NOW))).alias("verlopen"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.retained(e, "ts", F.timestamp_millis(F.lit(NOW)), 14).select("event_id")


def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.daily_quota(e, 2).select("event_id", "dag", "toegestaan")


def combined_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("seq"), F.to_date("ts").alias("dag"), (F.col("user_id") % 20).alias("afzender"), (F.floor(F.col("value")) % 30).alias("ontvanger"))
    return S.combined_quota(rows)


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every performance as a plan made when the agenda was older: times and titles have changed since."""
    rows = read_shows(spark, sf_dir)
    k = F.substring("seq", 14, 9).cast("int") % 6
    title = F.when(k == 1, F.element_at(F.split("titel", " "), -1)).when(k == 2, F.lit("Andere titel")).when(k == 5, F.lit("")).otherwise(F.col("titel"))
    return rows.select(F.col("seq").alias("plan"), "theaterId", "datum", F.when(k == 3, "23:59").when(k == 4, None).otherwise(F.col("tijd")).alias("tijd"), title.alias("titel"), F.when(k == 0, "afgelast").alias("vervallen"))


def plan_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.link_plans(_plans(spark, sf_dir), read_shows(spark, sf_dir))


def past_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a plan is linked at its own date: days that are not over take no part
    plans, rows = (x.filter(F.col("datum") < F.lit(DAY)) for x in (_plans(spark, sf_dir), read_shows(spark, sf_dir)))
    return S.past_plans(plans, S.link_plans(plans, rows), rows, DAY, NOW)


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A run, the one before it, and the venues that took part, some with an error."""
    rows = read_shows(spark, sf_dir).filter("theaterId <> 'v4'")
    odd = F.substring("seq", 10, 1).cast("int") % 2
    run = rows.filter(odd == 0).filter("theaterId not in ('v5', 'v6')").filter("theaterId <> 'v7' or substring(seq, 8, 3) = '000'")
    previous = rows.filter(odd == 1).filter("theaterId <> 'v6'").withColumn("tijd", F.when(F.col("theaterId").isin("v8", "v9"), F.lit("20:00")).otherwise(F.col("tijd")))
    run = run.withColumn("tijd", F.when(F.col("theaterId").isin("v8", "v10"), None).otherwise(F.col("tijd")))
    s = table(spark, sf_dir, "supplier")
    venues = s.select(F.concat(F.lit("v"), "s_suppkey").alias("theaterId"), F.when(F.col("s_suppkey").isin(4, 11), "geen antwoord").alias("error")).filter("theaterId <> 'v12'")
    return run, previous, venues


RUN_SQL = """, rijen AS (SELECT *, substr(seq, 10, 1)::INT % 2 AS k FROM perf WHERE theaterId <> 'v4'),
run AS (SELECT * REPLACE (CASE WHEN theaterId NOT IN ('v8', 'v10') THEN tijd END AS tijd) FROM rijen WHERE k = 0 AND theaterId NOT IN ('v5', 'v6') AND (theaterId <> 'v7' OR substr(seq, 8, 3) = '000')),
vorige AS (SELECT * REPLACE (CASE WHEN theaterId IN ('v8', 'v9') THEN '20:00' ELSE tijd END AS tijd) FROM rijen WHERE k = 1 AND theaterId <> 'v6'),
venues AS (SELECT 'v' || s_suppkey AS theaterId, CASE WHEN s_suppkey IN (4, 11) THEN 'geen antwoord' END AS error FROM supplier WHERE s_suppkey <> 12)"""


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, previous, venues = _run(spark, sf_dir)
    return R.outcomes(run.filter("theaterId <> 'v11'"), previous, venues, DAY)


def resolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, previous, venues = _run(spark, sf_dir)
    run = run.filter("theaterId <> 'v11'")
    return R.resolved(run, previous, R.outcomes(run, previous, venues, DAY), DAY).groupBy("theaterId").agg(F.count(F.lit(1)).alias("n"))


def missing_time_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, previous, _ = _run(spark, sf_dir)
    return R.missing_time_rise(run, previous)


def purge_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), F.col("o_custkey") % 50).alias("theaterId"), F.to_date("o_orderdate").alias("datum"))
    return R.purge(o, date(1996, 2, 29))[1]


def fail_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("theaterId"), F.to_date("ts").alias("dag"), (F.col("event_type") == "error").alias("fout"))
    return R.streaks(e, F.col("fout"))


def fail_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("theaterId"), F.to_date("ts").alias("dag"), (F.col("event_type") == "error").alias("fout"))
    return R.islands(e, F.col("fout"))


def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    status = s.select(F.concat(F.lit("v"), k).alias("theaterId"), F.when(k % 20 == 0, "terugval").when(k % 33 == 0, "fout").when(k % 7 == 0, "gepauzeerd").when(k % 9 == 0, "leeg").otherwise("ok").alias("status"), (k % 4).cast("int").alias("terugvalReeks"), (k % 17 == 3).alias("daling"), (k % 3).cast("int").alias("dalingReeks"))
    return R.verdict(status, F.lit(4830), F.array(F.lit("deploy starten")), F.lit(True))


def refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    fetched = F.when(F.col("page_id") % 9 != 0, F.lit(NOW) - (F.col("page_id") % 11) * 20 * R.HOUR)
    return p.select("page_id", R.bucket(F.col("url")).alias("emmer"), R.refresh_due(F.col("url"), fetched, F.lit(NOW)).alias("ophalen"))


def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    urls = p.select("url", k.alias("seq"), F.when(k % 9 != 0, F.lit(NOW) - (k % 41) * 20 * R.HOUR).alias("fetched"), F.date_add(F.lit(DAY), (k % 60).cast("int") - 10).alias("eerste"), F.date_add(F.lit(DAY), (k % 60).cast("int") - 5).alias("laatste"), (k % 8 == 0).alias("weglaten"))
    return R.crawl_plan(urls, DAY, NOW)


QUERIES = {
    f.__name__: f
    for f in (
        lww_watchlist, lww_tombstones, plan_merge, seen_merge, seen_tombstones, seen_cleanup, temporal_map, group_watchlist, monotone_copy, accepted_copies, ttl_links, retention, daily_quota, combined_quota,
        plan_links, past_plans, outcome, resolved_rows, missing_time_rise, purge_far, fail_streak, fail_islands, run_verdict, refresh_due, crawl_plan,
    )
}

_WATCH = """, a AS (SELECT * FROM acties WHERE event_type IN ('signup', 'view')),
b AS (SELECT "user", sleutel, arg_min({'t': titel, 'v': theaterId, 'op': op, 'm': maker, 'g': genre}, (-op, CASE WHEN theaterId IS NULL THEN 1 ELSE 0 END, seq)) AS x, arg_min(maker, seq) FILTER (maker IS NOT NULL) AS m, arg_min(genre, seq) FILTER (genre IS NOT NULL) AS g FROM a GROUP BY 1, 2),
w AS (SELECT "user", sleutel, x.t AS titel, x.v AS theaterId, x.op AS op, coalesce(x.m, m) AS maker, coalesce(x.g, g) AS genre, weg FROM b LEFT JOIN weg USING ("user", sleutel)),
items AS (SELECT * EXCLUDE (weg) FROM w WHERE weg IS NULL OR op > weg)"""
_SEEN = """, c AS (SELECT *, CASE WHEN seq % 6 = 0 THEN op + 259200000 END AS gewijzigd, CASE WHEN seq % 8 = 0 THEN (seq % 9 + 2) / 2.0 END::DOUBLE AS beoordeling, CASE WHEN seq % 4 = 0 THEN op END AS beoordeeldOp FROM acties WHERE event_type IN ('purchase', 'click')),
l AS (SELECT c.* FROM c LEFT JOIN weg USING ("user", sleutel) WHERE weg IS NULL OR op > weg)"""
_CANC = "beschikbaarheid IN ('afgelast', 'verplaatst')"
_DUP = f"concat_ws('|', theaterId, datum, coalesce(tijd, ''), norm, CASE WHEN {_CANC} THEN 'vervallen' END)"
_OUTCOME = RUN_SQL + f""", r AS (SELECT * FROM run WHERE theaterId <> 'v11'), rc AS (SELECT theaterId, count(*) AS rijen, count(DISTINCT {_DUP}) FILTER (datum >= DATE '{TODAY}') AS nieuw FROM r GROUP BY 1),
vc AS (SELECT theaterId, count(DISTINCT {_DUP}) AS vorig FROM vorige WHERE datum >= DATE '{TODAY}' GROUP BY 1),
j AS (SELECT theaterId, error, coalesce(rijen, 0) AS rijen, coalesce(nieuw, 0) AS nieuw, coalesce(vorig, 0) AS vorig FROM venues LEFT JOIN rc USING (theaterId) LEFT JOIN vc USING (theaterId)),
uit AS (SELECT theaterId, CASE WHEN error IS NOT NULL THEN CASE WHEN vorig > 0 THEN 'terugval' ELSE 'fout' END WHEN rijen = 0 THEN CASE WHEN vorig > 0 THEN 'terugval' ELSE 'leeg' END ELSE 'ok' END AS status, vorig, nieuw,
 CASE WHEN error IS NULL AND rijen > 0 AND vorig >= 20 AND nieuw < vorig * 0.3 THEN 'scherpe daling: ' || nieuw || ' unieke komende voorstellingen, vorige keer ' || vorig END AS waarschuwing,
 CASE WHEN error IS NOT NULL THEN 'exception: ' || error WHEN rijen = 0 AND vorig > 0 THEN '0 resultaten (vorige keer ' || vorig || ' komende voorstellingen)' END AS fout FROM j)"""
_PLANS = f""", p0 AS (SELECT *, substr(seq, 14, 9)::INT % 6 AS k FROM perf),
p1 AS (SELECT seq AS plan, theaterId, datum, CASE k WHEN 3 THEN '23:59' WHEN 4 THEN NULL ELSE tijd END AS tijd, CASE k WHEN 1 THEN string_split(titel, ' ')[-1] WHEN 2 THEN 'Andere titel' WHEN 5 THEN '' ELSE titel END AS titel, CASE k WHEN 0 THEN 'afgelast' END AS vervallen FROM p0),
p2 AS (SELECT *, coalesce(tijd, '') AS pt, {sql_parts('titel')} AS pd FROM p1), s2 AS (SELECT theaterId, datum, seq, coalesce(tijd, '') AS st, string_split(sleutel, ' | ') AS sd, {_CANC} AS gone FROM perf),
j AS (SELECT p.plan, s.seq, st = pt AS zt, sd = pd AS zw, st = pt AND len(list_filter(pd, lambda d: NOT list_contains(sd, d))) = 0 AS wijd, st = pt AND pt <> '' AS tt, gone FROM p2 p JOIN s2 s USING (theaterId, datum)),
g AS (SELECT plan, arg_min(seq, (gone, seq)) FILTER (zt AND zw) AS ex, count(*) FILTER (wijd) AS nw, min(seq) FILTER (wijd) AS sw, count(*) FILTER (zw) AS nt, min(seq) FILTER (zw) AS s_t, count(*) FILTER (tt) AS nm, min(seq) FILTER (tt) AS sm FROM j GROUP BY 1),
links AS (SELECT p1.plan, CASE WHEN ex IS NOT NULL THEN ex WHEN nw = 1 THEN sw WHEN nt = 1 THEN s_t WHEN nm = 1 THEN sm END AS seq, CASE WHEN ex IS NOT NULL OR nw = 1 THEN 'exact' WHEN nt = 1 THEN 'tijd' WHEN nm = 1 THEN 'titel' ELSE 'weg' END AS soort FROM p1 LEFT JOIN g USING (plan))"""
_ERRORS = "fouten AS (SELECT user_id % 40 AS theaterId, ts::DATE AS dag, bool_or(event_type = 'error') AS bad FROM events GROUP BY 1, 2)"
_BUCKET = "(list_reduce(list_prepend(5381::HUGEINT, list_transform(string_split(url, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: xor((h * 33) % 4294967296, c)) % 7)::INT"

ORACLE_SQL = {
    "combined_quota": """WITH RECURSIVE e AS (SELECT event_id AS seq, ts::DATE AS dag, user_id % 20 AS a, floor(value)::BIGINT % 30 AS o, row_number() OVER (PARTITION BY ts::DATE ORDER BY event_id) AS i FROM events),
q AS (SELECT dag, i, seq, NULL::VARCHAR AS reden, [a] AS sa, [o] AS so FROM e WHERE i = 1
 UNION ALL SELECT dag, i, seq, r, CASE WHEN r IS NULL THEN list_append(sa, a) ELSE sa END, CASE WHEN r IS NULL THEN list_append(so, o) ELSE so END FROM (SELECT e.*, sa, so,
 CASE WHEN len(sa) >= 100 THEN 'totaal' WHEN len(list_filter(sa, lambda x: x = a)) >= 10 THEN 'afzender' WHEN len(list_filter(so, lambda x: x = o)) >= 5 THEN 'ontvanger' END AS r FROM q JOIN e ON e.dag = q.dag AND e.i = q.i + 1))
SELECT seq, reden FROM q""",
    "lww_watchlist": ACTIONS_SQL + _WATCH + "SELECT * FROM items",
    "lww_tombstones": ACTIONS_SQL + _WATCH + 'SELECT "user", sleutel, weg AS op FROM weg LEFT JOIN b USING ("user", sleutel) WHERE x IS NULL OR x.op <= weg',
    "plan_merge": ACTIONS_SQL + """, p AS (SELECT *, CASE WHEN event_type = 'click' THEN 'kaarten' ELSE 'gepland' END AS status, CASE WHEN seq % 11 = 0 THEN 'afgelast' WHEN seq % 13 = 0 THEN 'verplaatst' END AS v FROM acties WHERE event_type IN ('click', 'view')),
b AS (SELECT "user", sleutel, arg_min({'s': status, 'op': op, 'm': maker, 'g': genre}, (-op, seq)) AS x, arg_max(v, seq) FILTER (v IS NOT NULL) AS vervallen, arg_min(maker, seq) FILTER (maker IS NOT NULL) AS m, arg_min(genre, seq) FILTER (genre IS NOT NULL) AS g FROM p GROUP BY 1, 2)
SELECT "user", sleutel, x.s AS status, x.op AS op, vervallen, coalesce(x.m, m) AS maker, coalesce(x.g, g) AS genre FROM b LEFT JOIN weg USING ("user", sleutel) WHERE weg IS NULL OR x.op > weg""",
    "seen_merge": ACTIONS_SQL + _SEEN + """, b AS (SELECT "user", sleutel, arg_min({'t': titel, 'm': maker, 'g': genre}, (-greatest(op, coalesce(gewijzigd, 0)), seq)) AS x, max(op) AS op, arg_min({'b': beoordeling, 'o': beoordeeldOp}, (-beoordeeldOp, seq)) FILTER (beoordeeldOp IS NOT NULL) AS r,
 arg_min(maker, seq) FILTER (maker IS NOT NULL) AS m, arg_min(genre, seq) FILTER (genre IS NOT NULL) AS g FROM l GROUP BY 1, 2),
v AS (SELECT "user", sleutel, DATE '1998-01-01' + (seq % 3)::INT AS datum, CASE WHEN seq % 2 = 0 THEN '20:00' ELSE '' END AS tijd, coalesce(theaterId, '') AS th, arg_min('Zaal ' || (seq % 5), seq) FILTER (seq % 3 = 1) AS zaal FROM l GROUP BY 1, 2, 3, 4, 5),
n AS (SELECT "user", sleutel, count(*)::INT AS n_bezoeken, arg_max({'d': datum, 'z': zaal}, (datum, tijd, th)) AS y FROM v GROUP BY 1, 2)
SELECT "user", sleutel, x.t AS titel, op, coalesce(x.m, m) AS maker, coalesce(x.g, g) AS genre, CASE WHEN r.b BETWEEN 1 AND 5 THEN r.b END AS beoordeling, r.o AS beoordeeldOp, n_bezoeken, y.d AS laatste, y.z AS zaal FROM b JOIN n USING ("user", sleutel)""",
    "seen_tombstones": ACTIONS_SQL + _SEEN + 'SELECT "user", sleutel, weg AS op FROM weg WHERE NOT EXISTS (FROM l WHERE l."user" = weg."user" AND l.sleutel = weg.sleutel)',
    "seen_cleanup": ACTIONS_SQL + _WATCH + f""", s AS (SELECT "user", sleutel, max(greatest(op, CASE WHEN seq % 6 = 0 THEN op + 259200000 ELSE 0 END)) AS g FROM acties WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2)
SELECT "user", sleutel, {NOW}::BIGINT AS op FROM items JOIN s USING ("user", sleutel) WHERE op <= g""",
    "temporal_map": ACTIONS_SQL + _WATCH + """, r(oud, nieuw, nt, tot) AS (VALUES ('k1', 'n1', 'Nieuw 1', DATE '2024-01-15'), ('k1', 'n2', 'Nieuw 2', NULL), ('k2', 'n1', 'Nieuw 1', DATE '2024-01-10'), ('k3', 'n3', 'Nieuw 3', DATE '2023-01-01')),
j AS (SELECT i.*, r.nieuw, r.nt FROM items i JOIN r ON r.oud = i.sleutel AND (r.tot IS NULL OR i.op < epoch_ms((r.tot + 1)::TIMESTAMP))),
u AS (SELECT "user", nieuw AS sleutel, nt AS titel, theaterId, op FROM j UNION ALL SELECT "user", sleutel, titel, theaterId, op FROM items i WHERE sleutel = 'k2' OR NOT EXISTS (FROM j WHERE j."user" = i."user" AND j.sleutel = i.sleutel))
SELECT "user", sleutel, arg_min({'t': titel, 'v': theaterId, 'op': op}, (-op, theaterId IS NULL, titel)).t AS titel, arg_min({'v': theaterId}, (-op, theaterId IS NULL, titel)).v AS theaterId, max(op) AS op FROM u GROUP BY 1, 2""",
    "group_watchlist": ACTIONS_SQL + _WATCH + """SELECT "user", CASE WHEN op > 0 AND theaterId IS NOT NULL THEN op || '|' || theaterId ELSE 's|' || sleutel END AS groep, count(*) AS n, list(sleutel ORDER BY sleutel) AS sleutels FROM items GROUP BY 1, 2""",
    "monotone_copy": 'SELECT user_id AS "user", arg_max(floor(value)::BIGINT, (floor(value), event_id)) AS stand, arg_max(event_id, (floor(value), event_id)) AS seq, arg_max(event_type, (floor(value), event_id)) AS event_type FROM events GROUP BY 1',
    "accepted_copies": 'WITH e AS (SELECT user_id AS "user", floor(value)::BIGINT AS stand, event_id AS seq FROM events), m AS (SELECT *, max(stand) OVER (PARTITION BY "user" ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e) SELECT "user", stand, seq FROM m WHERE m IS NULL OR stand >= m',
    "ttl_links": f"SELECT event_id, event_id % 5 <> 0 AND epoch_ms({NOW}) >= ts + INTERVAL 7 DAY AS verlopen FROM events",
    "retention": f"SELECT event_id FROM events WHERE ts >= epoch_ms({NOW}) - INTERVAL 14 DAY",
    "daily_quota": "WITH e AS (SELECT event_id, user_id, ts, (ts + INTERVAL 1 HOUR)::DATE AS dag FROM events) SELECT event_id, dag, row_number() OVER (PARTITION BY user_id, dag ORDER BY ts, event_id) <= 2 AS toegestaan FROM e",
    "plan_links": SHOW_SQL + _PLANS + " SELECT * FROM links",
    "past_plans": SHOW_SQL + _PLANS + f""", o AS (SELECT p1.plan, coalesce(s.titel, p1.titel) AS t, p1.datum, p1.vervallen IS NOT NULL OR coalesce(s.{_CANC}, false) AS weg FROM p1 JOIN links USING (plan) LEFT JOIN perf s ON s.seq = links.seq WHERE p1.datum < DATE '{TODAY}')
SELECT plan, CASE WHEN weg THEN 'stil' ELSE 'gezien' END AS naar, CASE WHEN NOT weg THEN array_to_string({sql_parts('t')}, ' | ') END AS sleutel, CASE WHEN NOT weg THEN least({NOW}, epoch_ms(datum + INTERVAL 22 HOUR)) END AS op FROM o""",
    "outcome": SHOW_SQL + _OUTCOME + " SELECT * FROM uit",
    "resolved_rows": SHOW_SQL + _OUTCOME + f""", alles AS (SELECT theaterId FROM r JOIN uit USING (theaterId) WHERE status = 'ok' UNION ALL SELECT theaterId FROM vorige JOIN uit USING (theaterId) WHERE status = 'terugval' AND datum >= DATE '{TODAY}'
 UNION ALL SELECT theaterId FROM vorige WHERE theaterId NOT IN (SELECT theaterId FROM uit)) SELECT theaterId, count(*) AS n FROM alles GROUP BY 1""",
    "missing_time_rise": SHOW_SQL + RUN_SQL + """, a AS (SELECT theaterId, count(*) AS n, count(*) FILTER (tijd IS NULL) / count(*) AS nu FROM run GROUP BY 1), b AS (SELECT theaterId, count(*) FILTER (tijd IS NULL) / count(*) AS toen FROM vorige GROUP BY 1)
SELECT theaterId, nu, toen FROM a JOIN b USING (theaterId) WHERE n >= 10 AND nu - toen >= 0.2""",
    "purge_far": "SELECT 'v' || (o_custkey % 50) AS theaterId, count(*) AS n FROM orders WHERE o_orderdate::DATE::VARCHAR > '1998-02-29' GROUP BY 1",
    "fail_streak": f"WITH {_ERRORS}, g AS (SELECT theaterId, max(dag) FILTER (NOT bad) AS goed FROM fouten GROUP BY 1) SELECT theaterId, min(dag) AS sinds, (max(dag) - min(dag) + 1)::INT AS reeks FROM fouten JOIN g USING (theaterId) WHERE goed IS NULL OR dag > goed GROUP BY 1",
    "fail_islands": f"WITH {_ERRORS}, d AS (SELECT theaterId, dag, dag - row_number() OVER (PARTITION BY theaterId ORDER BY dag)::INT AS g FROM fouten WHERE bad) SELECT theaterId, min(dag) AS van, max(dag) AS tot, count(*) AS n FROM d GROUP BY theaterId, g",
    "run_verdict": """WITH s AS (SELECT 'v' || s_suppkey AS t, CASE WHEN s_suppkey % 20 = 0 THEN 'terugval' WHEN s_suppkey % 33 = 0 THEN 'fout' WHEN s_suppkey % 7 = 0 THEN 'gepauzeerd' WHEN s_suppkey % 9 = 0 THEN 'leeg' ELSE 'ok' END AS st, greatest(1, s_suppkey % 4) AS fb, s_suppkey % 17 = 3 AS d, greatest(1, s_suppkey % 3) AS dr FROM supplier)
SELECT 'rood' AS niveau, list_concat(list(t || ' valt ' || fb || ' nachten op rij terug' ORDER BY -fb, t) FILTER (st IN ('terugval', 'fout') AND fb >= 2), CASE WHEN count(*) FILTER (st IN ('terugval', 'fout')) > 3 THEN [count(*) FILTER (st IN ('terugval', 'fout')) || ' theaters vallen terug (meer dan 3)'] ELSE [] END,
 list('scherpe daling bij ' || t || ', ' || dr || ' nachten op rij' ORDER BY t) FILTER (st <> 'gepauzeerd' AND d AND dr >= 2), ['stap "deploy starten" mislukt', 'scrapen duurde 81 min (grens 80)']) AS redenen,
 count(*) FILTER (st = 'ok') AS ok, count(*) FILTER (st = 'leeg') AS leeg, count(*) FILTER (st = 'gepauzeerd') AS gepauzeerd, count(*) FILTER (st IN ('terugval', 'fout')) AS terugval, 'bijwerken' AS issue FROM s""",
    "refresh_due": f"""WITH p AS (SELECT page_id, {_BUCKET} AS emmer, CASE WHEN page_id % 9 <> 0 THEN (page_id % 11) * 20 END AS uren FROM pages)
SELECT page_id, emmer, uren IS NULL OR uren >= 168 OR (emmer = {NOW // 86_400_000 % 7} AND uren >= 20) AS ophalen FROM p""",
    "crawl_plan": f"""WITH p AS (SELECT url, page_id AS seq, CASE WHEN page_id % 9 <> 0 THEN (page_id % 41) * 20 END AS uren, page_id % 60 - 10 AS eerste, page_id % 60 - 5 AS laatste, page_id % 8 = 0 AS weglaten, {_BUCKET} AS emmer FROM pages),
r AS (SELECT url, seq, CASE WHEN uren IS NULL THEN 'nieuw' WHEN weglaten THEN CASE WHEN uren > 720 THEN 'weg, verversen' END WHEN laatste < 0 THEN NULL WHEN eerste BETWEEN 0 AND 7 AND uren >= 20 THEN 'binnenkort' WHEN uren >= 168 OR (emmer = {NOW // 86_400_000 % 7} AND uren >= 20) THEN 'wekelijks' END AS reden FROM p)
SELECT url, seq, reden, CASE reden WHEN 'binnenkort' THEN 1 WHEN 'nieuw' THEN 2 ELSE 3 END AS voorrang FROM r WHERE reden IS NOT NULL ORDER BY voorrang, seq LIMIT 80""",
}
