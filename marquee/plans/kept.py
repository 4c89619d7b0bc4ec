"""Queries on tables that are kept between runs: the index of names, published versions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import publish
from ..operators import loading, names
from ..operators.state import merge_watchlist
from ..storage import checkpointed, new_folder
from .shows import SHOW_SQL, TODAY, shows, table
from .state import ACTIONS_SQL, _actions


def changes(events: DataFrame) -> DataFrame:
    """Profiles and preferences of users, changed by their events."""
    k = F.col("event_id")
    name = F.when(F.col("event_type") == "error", None).when(k % 5 == 0, "Bo").otherwise(F.concat(F.lit("Ánna  de Vries "), (F.floor(F.col("value")) % 50).cast("string")))
    kind = F.when(F.col("event_type") == "click", "voorkeur").otherwise("profiel")
    return events.select(F.col("user_id").cast("string").alias("uid"), kind.alias("soort"), k.alias("seq"), name.alias("naam"), (k % 3 != 0).alias("vindbaar"))


def stream_name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after following all events as a stream."""
    schema = table(spark, sf_dir, "events").schema
    at = new_folder(spark, "names")
    names.follow(changes(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events[.]parquet")), at)
    return names.index(spark, at)


def name_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second half of the events changes in the index that the first half leads to."""
    all_ = changes(table(spark, sf_dir, "events"))
    half = F.col("seq") % 1000 < 500
    return names.outcomes(names.newest(all_.filter(half)), all_.filter(~half)).select("uid", "oud", "sleutel", "uitkomst")


def published_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs of publishing the agenda: all rows, the upcoming ones, an older run, and one of too few rows.

    A row for each run, with how many rows readers see in the end and on how many days.
    """
    rows = shows(spark, sf_dir).select("seq", "theaterId", "datum")
    coming = rows.filter(F.col("datum") >= F.lit(date.fromisoformat(TODAY)))
    at = new_folder(spark, "agenda")
    for stand, df, least in ((10, rows, 1), (20, coming, 1), (15, rows, 1), (30, rows.filter("datum IS NULL"), 1)):
        publish.publish(df, at, stand, least)
    seen = publish.current(spark, at, rows.schema).agg(F.count(F.lit(1)).alias("zichtbaar"), F.countDistinct("datum").alias("dagen")).first()
    return publish.status(spark, at).select("*", F.lit(seen["zichtbaar"]).alias("zichtbaar"), F.lit(seen["dagen"]).alias("dagen"))


def loaded_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's watchlist after a load round, whether it changed, and whether a second round changes it again.

    Even events made the lists that were saved; odd ones come from a second source, for two thirds of the users.
    """
    actions = _actions(spark, sf_dir)
    split = lambda df: (df.filter("event_type IN ('signup', 'view')"), df.filter("event_type = 'error'"))
    saved, saved_gone = (checkpointed(df) for df in merge_watchlist(*split(actions.filter("seq % 2 = 0"))))
    extra, extra_gone = split(actions.filter("seq % 2 = 1 AND user % 3 <> 0"))
    favourites = actions.filter("user % 5 = 0").select("user", F.lit("v1::Het Bos – Ada").alias("waarde")).distinct()
    known = spark.createDataFrame([("het bos", "Het Bos")], "sleutel string, titel string")
    mapping = spark.createDataFrame([("k1", "k0"), ("k3", "n3")], "oud string, nieuw string")
    info = spark.createDataFrame([("k0", "Ada Lint", None), ("n3", None, "Dans")], "sleutel string, maker string, genre string")
    items, gone, users = loading.load_round(saved, saved_gone, extra, extra_gone, favourites, known, mapping, info)
    items, gone = checkpointed(items), checkpointed(gone)
    again = loading.load_round(items, gone, extra, extra_gone, favourites, known, mapping, info)[2].select("user", F.col("gewijzigd").alias("nogmaals"))
    number = lambda df, name: df.groupBy("user").agg(F.count(F.lit(1)).alias(name), F.max("op").alias(f"{name}_op"))
    out = users.join(again, "user").join(number(items, "items"), "user", "left").join(number(gone, "stenen"), "user", "left")
    return out.select("user", "gewijzigd", "nogmaals", F.coalesce("items", F.lit(0)).alias("items"), "items_op", F.coalesce("stenen", F.lit(0)).alias("stenen"), "stenen_op")


QUERIES = {f.__name__: f for f in (stream_name_index, name_changes, published_runs, loaded_lists)}



def _merge(name: str, adds: str, gone: str) -> str:
    """CTEs <name>_items and <name>_stones of adds (with seq) and deletes."""
    return f"""{name}_weg AS (SELECT "user", sleutel, max(op) AS weg FROM ({gone}) GROUP BY 1, 2),
{name}_b AS (SELECT "user", sleutel, arg_min({{'t': titel, 'v': theaterId, 'op': op, 'm': maker, 'g': genre}}, (-op, CASE WHEN theaterId IS NULL THEN 1 ELSE 0 END, seq)) AS x, arg_min(maker, seq) FILTER (maker IS NOT NULL) AS m, arg_min(genre, seq) FILTER (genre IS NOT NULL) AS g FROM ({adds}) GROUP BY 1, 2),
{name}_items AS (SELECT "user", sleutel, x.t AS titel, x.v AS theaterId, x.op AS op, coalesce(x.m, m) AS maker, coalesce(x.g, g) AS genre FROM {name}_b LEFT JOIN {name}_weg USING ("user", sleutel) WHERE weg IS NULL OR x.op > weg),
{name}_stones AS (SELECT "user", sleutel, weg AS op FROM {name}_weg LEFT JOIN {name}_b USING ("user", sleutel) WHERE x IS NULL OR x.op <= weg)"""


_NEW_KEY = "CASE sleutel WHEN 'k1' THEN 'k0' WHEN 'k3' THEN 'n3' ELSE sleutel END"
_ROW = f"""SELECT "user", {_NEW_KEY} AS sleutel, titel, theaterId, op, maker, genre"""
_LOADED = ACTIONS_SQL + ", " + _merge("s", "FROM acties WHERE event_type IN ('signup', 'view') AND seq % 2 = 0", "FROM acties WHERE event_type = 'error' AND seq % 2 = 0") + ", " + _merge(
    "n",
    _ROW + ", '0|' || sleutel AS seq FROM s_items UNION ALL " + _ROW + """, '1|' || lpad(seq::VARCHAR, 20, '0') FROM acties WHERE event_type IN ('signup', 'view') AND seq % 2 = 1 AND "user" % 3 <> 0
 UNION ALL SELECT DISTINCT "user", 'ada | het bos', 'Het Bos – Ada', 'v1', 0, NULL, NULL, '2|' FROM acties WHERE "user" % 5 = 0""",
    f"""SELECT "user", {_NEW_KEY} AS sleutel, op FROM s_stones UNION ALL SELECT "user", {_NEW_KEY}, op FROM acties WHERE event_type = 'error' AND seq % 2 = 1 AND "user" % 3 <> 0""",
) + """, f AS (SELECT * REPLACE (coalesce(maker, CASE sleutel WHEN 'k0' THEN 'Ada Lint' END) AS maker, coalesce(genre, CASE sleutel WHEN 'n3' THEN 'Dans' END) AS genre) FROM n_items),
anders AS (SELECT "user" FROM ((FROM f EXCEPT FROM s_items) UNION ALL (FROM s_items EXCEPT FROM f)) UNION SELECT "user" FROM ((FROM n_stones EXCEPT FROM s_stones) UNION ALL (FROM s_stones EXCEPT FROM n_stones))),
iedereen AS (SELECT "user" FROM s_items UNION SELECT "user" FROM s_stones UNION SELECT "user" FROM n_items UNION SELECT "user" FROM n_stones)
SELECT u."user", u."user" IN (FROM anders) AS gewijzigd, false AS nogmaals, coalesce(i.n, 0) AS items, i.op AS items_op, coalesce(t.n, 0) AS stenen, t.op AS stenen_op FROM iedereen u
LEFT JOIN (SELECT "user", count(*) AS n, max(op) AS op FROM f GROUP BY 1) i USING ("user") LEFT JOIN (SELECT "user", count(*) AS n, max(op) AS op FROM n_stones GROUP BY 1) t USING ("user")"""
_NAMES = """WITH c AS (SELECT user_id::VARCHAR AS uid, event_type = 'click' AS voorkeur, event_id AS seq, CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN NULL ELSE 'anna de vries ' || (floor(value)::BIGINT % 50) END AS naam, event_id % 3 <> 0 AS vindbaar FROM events),
now AS (SELECT uid, sha256(arg_max(coalesce(naam, ''), seq) FILTER (NOT voorkeur)) AS h, arg_max(coalesce(naam, ''), seq) FILTER (NOT voorkeur) AS naam, arg_max(vindbaar, seq) FILTER (voorkeur) AS vindbaar FROM c {where} GROUP BY 1)"""
_KEYED = "SELECT uid, CASE WHEN vindbaar AND naam <> '' THEN h END AS sleutel FROM now"
ORACLE_SQL = {
    "loaded_lists": _LOADED,
    "stream_name_index": _NAMES.format(where="") + f" SELECT sleutel, uid FROM ({_KEYED}) WHERE sleutel IS NOT NULL",
    "name_changes": f"""SELECT uid, oud, sleutel, CASE WHEN oud IS NOT DISTINCT FROM sleutel THEN 'ongewijzigd' WHEN sleutel IS NOT NULL THEN 'gezet' ELSE 'verwijderd' END AS uitkomst
FROM ({_NAMES.format(where="")} {_KEYED}) LEFT JOIN (SELECT uid, sleutel AS oud FROM ({_NAMES.format(where="WHERE seq % 1000 < 500")} {_KEYED})) USING (uid)
WHERE uid IN (SELECT user_id::VARCHAR FROM events WHERE event_id % 1000 >= 500)""",
    "published_runs": SHOW_SQL + f""", n AS (SELECT count(*) AS alle, count(*) FILTER (datum >= DATE '{TODAY}') AS komend, count(DISTINCT datum) FILTER (datum >= DATE '{TODAY}') AS dagen FROM perf)
SELECT versie, stand, CASE versie WHEN 1 THEN alle WHEN 2 THEN komend ELSE 0 END AS rijen, uitkomst, komend AS zichtbaar, dagen
FROM n, (VALUES (1, 10, 'geplaatst'), (2, 20, 'geplaatst'), (3, 15, 'ouder'), (4, 30, 'te-weinig')) v(versie, stand, uitkomst)""",
}
