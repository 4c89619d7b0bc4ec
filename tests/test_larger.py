"""What larger tables bring: instants and years beyond the usual, long lists, many files."""

import random
from datetime import date

import duckdb
from compare import spark_rows, sql_rows
from pyspark.sql import functions as F

from marquee.operators import agenda, dating, lists, state
from marquee.plans import cards, lookups, more, streams
from tests.conftest import SMALL


def test_order_by_instants_beyond_the_last_timestamp(spark):
    rows = [(1, "a", None, None, 28_000_000_000_000_000), (1, "b", None, None, 28_382_400_000_000_000), (1, "c", None, date(2026, 1, 2), 1), (1, "d", None, None, None), (1, "e", None, date(2026, 1, 2), 2)]
    items = spark.createDataFrame(rows, "user long, sleutel string, beoordeling double, laatsteBezoek date, op long")
    for by_rating in (False, True):
        got = {r["sleutel"]: r["plaats"] for r in lists.in_seen_order(items, by_rating).collect()}
        assert got == {"b": 1, "a": 2, "c": 3, "e": 4, "d": 5}


def _long_list(spark, december, january):
    """20,000 rows that go back a month every second row."""
    rows = spark.range(20_000).select(F.lit(1).alias("lijst"), F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, december).otherwise(january).alias("dag"))
    return rows.withColumns({"label": F.col("dag"), "uur": F.lit("20:00"), "eerste": F.lit("2026-06-01").cast("date")})


def _years(dated):
    return [r["j"] for r in dated.select("pos", F.year("datum").alias("j")).orderBy("pos").collect()]


def test_years_of_five_digits(spark):
    want = [2026 + (i + 1) // 2 for i in range(20_000)]
    assert _years(dating.month_rollover(_long_list(spark, "za 5-12", "za 5-1"), "lijst")) == want
    assert _years(dating.short_dates(_long_list(spark, "5 dec", "5 jan"), date(2026, 6, 1))) == want
    assert _years(dating.numeric_dates(_long_list(spark, "05.12", "05.01"), date(2026, 6, 1))) == want


def test_folds_hold_no_list(spark):
    """Lists come row by row in order; no plan gathers one."""
    rows = _long_list(spark, "5 dec", "5 jan")
    for fold in (dating.short_dates, dating.numeric_dates):
        plan = fold(rows, date(2026, 6, 1))._jdf.queryExecution().toString().lower()
        assert "collect_list" not in plan and "mapinarrow" in plan


def test_dates_of_cards_are_read_once(spark):
    """No filter reads all dates beforehand, and buttons are not looked up for each status they may have."""
    plan = more.card_dates(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("?subshow(") == 1 and plan.count("?btn(") == 1


def test_elements_are_written_and_never_broadcast(spark):
    plan = cards.card_layouts(spark, SMALL)._jdf.queryExecution()
    joins = [line for line in plan.executedPlan().toString().split("\n") if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert not [line for line in joins if "nr#" in line and "> " in line]
    assert "MapInPandas" not in plan.optimizedPlan().toString()


def test_plans_and_performances_are_brought_together_once(spark):
    shows = spark.createDataFrame([("v1", "2026-01-01", "20:00", "s1", "Ada – Bo", "ada | bo", "beschikbaar")], "theaterId string, datum string, tijd string, seq string, titel string, sleutel string, beschikbaarheid string")
    plans = spark.createDataFrame([("p1", "v1", "2026-01-01", "20:00", "Bo")], "plan string, theaterId string, datum string, tijd string, titel string")
    links = state.link_plans(plans, shows)
    assert [tuple(r) for r in links.collect()] == [("p1", "s1", "exact")]
    plan = links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_quota_of_many_unordered_files(spark, tmp_path):
    """Twelve files, four a batch, that each span the same 140 days; some events are there twice."""
    con = duckdb.connect()
    (tmp_path / "events.parquet").mkdir()
    for k in range(12):
        con.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2023-11-01' + INTERVAL 1 HOUR * (event_id * 1237 % 3360) AS ts, event_id % 3 AS user_id) FROM '{SMALL}/events.parquet' WHERE event_id % 12 = {k} OR event_id % 40 = {k}) TO '{tmp_path}/events.parquet/{k}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert spark_rows(streams.stream_quota(spark, str(tmp_path))) == sql_rows(con, streams.ORACLE_SQL["stream_quota"])


def test_venues_of_sets_of_keys(spark):
    rnd = random.Random(4)
    pairs = {(f"k{rnd.randrange(6)}", f"v{rnd.randrange(40)}"): rnd.random() < 0.3 for _ in range(120)}
    venues = spark.createDataFrame([(*kv, door) for kv, door in pairs.items()], "sleutel string, theaterId string, door boolean")
    sets = [["k0", "k1"], ["k1", "k2", "k5"], ["k3", "weg"], ["weg", "x"]]
    got = {tuple(r["sleutels"]): (r["n_door"], r["n_alle"]) for r in agenda.union_sizes(spark.createDataFrame([(s,) for s in sets], "sleutels array<string>"), venues, 3).collect()}
    held = lambda s, all_: len({v for (k, v), door in pairs.items() if k in s and (all_ or door)})
    assert got == {tuple(s): (held(s, False), held(s, True)) for s in sets}


def test_lines_carry_no_venues(spark):
    plan = lookups.watchlist_lines(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(" not in plan and "flatten(" not in plan
