"""Queries on venues' own rules and shared scans, and on states in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, venues
from ..operators.venues import Rule
from ..streaming import jobs as J
from .shows import SHOW_SQL, shows, table

PROVINCES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
#: Rules of ten venues; all others have none.
RULES = (
    Rule("v1", "genre", "woord", ("dans",), "dans"),
    Rule("v1", "titel", "woord", ("workshop", "almond", "antique"), "workshop/cursus"),
    Rule("v2", "genre", "een-van", ("CABARET", "toneel"), "{waarde}"),
    Rule("v2", "prijs", "boven", ("400",), "te duur"),
    Rule("v3", "genre", "geen-van", ("cabaret", "toneel", "dans"), "onbekende categorie: {waarde}"),
    Rule("v4", "maker", "leeg", (), "zonder maker"),
    Rule("v4", "titel", "begin", ("ada", "mia"), "besloten"),
    Rule("v5", "tijd", "leeg", (), "zonder tijd"),
    Rule("v5", "genre", "woord", ("musical",), "verhuur: {waarde} ({waarde})"),
    Rule("v6", "stad", "een-van", ("france", "peru", "china", "japan"), "andere plaats: {waarde}"),
    Rule("v7", "titel", "woord", ("try-out",), "try-out"),
    Rule("v7", "genre", "leeg", (), "zonder genre"),
    Rule("v8", "beschikbaarheid", "een-van", ("afgelast", "verplaatst"), "{waarde}"),
    Rule("v9", "prijs", "boven", ("700",), "te duur"),
    Rule("v10", "titel", "begin", ("Trio", "Bo"), "{waarde}"),
)


def venue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every performance with the reason for which its venue leaves it out."""
    return shows(spark, sf_dir).select("seq", "theaterId", venues.left_out(RULES).alias("reden"))


def shared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of the agenda for five members: what was counted on the way, and what each finds in its own rows."""
    got = venues.shared_scan(lambda: shows(spark, sf_dir).select("seq", "provincie", "titel", "datum"), PROVINCES, "provincie")
    out = None
    for m in PROVINCES:
        one = got.rows[m].agg(F.countDistinct("titel").alias("titels"), F.min("datum").alias("eerste")).select(F.lit(m).alias("lid"), F.lit(got.counts[m]).cast("bigint").alias("geteld"), "titels", "eerste")
        out = one if out is None else out.unionByName(one)
    return out


def _companions(events: DataFrame) -> DataFrame:
    v = F.floor(F.col("value"))
    name = lambda k: F.concat(F.lit("@"), k.cast("string"))
    names = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array(name(v % 3), name(v % 2), name(v % 3)))
    return events.select(F.col("user_id").alias("plan"), history.companions(names).alias("metWie"), F.date_trunc("hour", F.col("ts")).alias("op"), F.col("event_id").alias("seq"))


def _in_ms(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.unix_millis(F.col(n).cast("timestamp")) for n in names})


def companion_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who came along with each user's plan, and from when to when; an hour's changes count as one."""
    return _in_ms(history.intervals(_companions(table(spark, sf_dir, "events")), ["plan"], "metWie", "op", "seq"), "van", "tot")


def _copies(events: DataFrame) -> DataFrame:
    v = F.floor(F.col("value"))
    return events.select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), v.alias("stand"), (v % 3).cast("string").alias("inhoud"))


def copy_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshes of shared copies: a run of changes ends after twelve hours without one, and is written if it is not older."""
    return _in_ms(history.writes(history.settled(_copies(table(spark, sf_dir, "events")), "12 hours")), "begin", "einde")


def stream_copy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of changes that are over, from events as a stream."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events[.]parquet")
    return _in_ms(J.drain(history.settled(_copies(events).withWatermark("ts", "0 seconds"), "12 hours"), "append"), "begin", "einde")


QUERIES = {f.__name__: f for f in (venue_filters, shared_scan, companion_intervals, copy_writes, stream_copy_runs)}

_RUNS = """WITH e AS (SELECT user_id AS "user", ts, floor(value)::BIGINT AS stand, (floor(value)::BIGINT % 3)::VARCHAR AS inhoud FROM events),
g AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 12 HOUR, true)::INT AS nieuw FROM e WINDOW w AS (PARTITION BY "user" ORDER BY ts)),
s AS (SELECT *, sum(nieuw) OVER (PARTITION BY "user" ORDER BY ts) AS k FROM g),
r AS (SELECT "user", min(ts) AS begin, max(ts) + INTERVAL 12 HOUR AS einde, count(*) AS n, max(stand) AS stand, arg_max(inhoud, (stand, ts)) AS inhoud FROM s GROUP BY "user", k)"""


def _first_reason() -> str:
    """The rules as they read, venue by venue."""
    text = "trim(coalesce({0}::VARCHAR, ''))"
    test = {
        "woord": lambda r: f"regexp_matches({text.format(r.field)}, '(?i)\\b(?:{'|'.join(r.values)})\\b')",
        "begin": lambda r: f"regexp_matches({text.format(r.field)}, '(?i)^(?:{'|'.join(r.values)})\\b')",
        "een-van": lambda r: f"lower({text.format(r.field)}) IN ({', '.join(repr(v.lower()) for v in r.values)})",
        "geen-van": lambda r: f"lower({text.format(r.field)}) NOT IN ({', '.join(repr(v.lower()) for v in r.values)})",
        "boven": lambda r: f"{r.field} > {r.values[0]}",
        "leeg": lambda r: f"{text.format(r.field)} = ''",
    }
    reason = lambda r: f"replace('{r.reason}', '{{waarde}}', CASE WHEN {text.format(r.field)} = '' THEN '(leeg)' ELSE {text.format(r.field)} END)"
    return "CASE " + " ".join(f"WHEN theaterId = '{r.venue}' AND {test[r.kind](r)} THEN {reason(r)}" for r in RULES) + " END"


ORACLE_SQL = {
    "venue_filters": SHOW_SQL + f" SELECT seq, theaterId, {_first_reason()} AS reden FROM perf",
    "shared_scan": SHOW_SQL + " SELECT provincie AS lid, count(*) AS geteld, count(DISTINCT titel) AS titels, min(datum) AS eerste FROM perf GROUP BY 1",
    "companion_intervals": """WITH l AS (SELECT user_id AS plan, CASE WHEN event_type = 'error' THEN [] ELSE list_sort(list_distinct(['@' || (floor(value)::BIGINT % 3), '@' || (floor(value)::BIGINT % 2)])) END AS "metWie", date_trunc('hour', ts)::TIMESTAMP AS op, event_id FROM events),
h AS (SELECT plan, op, arg_max("metWie", event_id) AS "metWie" FROM l GROUP BY 1, 2), c AS (SELECT *, coalesce("metWie" <> lag("metWie") OVER (PARTITION BY plan ORDER BY op), true) AS nieuw FROM h)
SELECT plan, "metWie", epoch_ms(op) AS van, epoch_ms(lead(op) OVER (PARTITION BY plan ORDER BY op)) AS tot FROM c WHERE nieuw""",
    "copy_writes": _RUNS + """, o AS (SELECT *, coalesce(stand < max(stand) OVER (PARTITION BY "user" ORDER BY begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ouder FROM r),
l AS (SELECT *, last_value(CASE WHEN NOT ouder THEN inhoud END IGNORE NULLS) OVER (PARTITION BY "user" ORDER BY begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stond FROM o)
SELECT "user", epoch_us(begin) // 1000 AS begin, epoch_us(einde) // 1000 AS einde, n, stand, inhoud, CASE WHEN ouder THEN 'ouder' WHEN stond = inhoud THEN 'gelijk' ELSE 'geschreven' END AS uitkomst FROM l""",
    "stream_copy_runs": _RUNS + ' SELECT "user", epoch_us(begin) // 1000 AS begin, epoch_us(einde) // 1000 AS einde, n, stand, inhoud FROM r WHERE einde <= (SELECT max(ts) FROM events)',
}
