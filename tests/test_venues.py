"""Rules as data, shared scans, intervals and runs of changes, on worked-out rows."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import history, venues
from marquee.operators.venues import Rule


def test_first_rule_is_named(spark):
    rules = [
        Rule("a", "soort", "woord", ("film",), "film"), Rule("a", "soort", "een-van", ("Lezing", "quiz"), "{waarde}"), Rule("a", "soort", "geen-van", ("Theater", "muziek"), "onbekende categorie: {waarde}"),
        Rule("a", "kop", "woord", ("workshop", "cursus"), "workshop/cursus"), Rule("b", "zaal", "begin", ("filmzaal",), "filmzaal"), Rule("b", "prijs", "boven", ("50",), "te duur"),
    ]
    rows = [
        ("a", "Film, Junior", "x", None, None, "film"), ("a", "filmisch", "x", None, None, "onbekende categorie: filmisch"), ("a", " lezing ", "x", None, None, "lezing"), ("a", None, "x", None, None, "onbekende categorie: (leeg)"),
        ("a", "THEATER", "Een workshop, met Ada", None, None, "workshop/cursus"), ("a", "muziek", "workshops", None, None, None), ("b", "film", "workshop", "Filmzaal 2", 99.0, "filmzaal"), ("b", None, None, "Filmzalen", 50.5, "te duur"), ("b", None, None, None, 50.0, None), ("c", "film", "workshop", "Filmzaal", 99.0, None), (None, "film", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "theaterId string, soort string, kop string, zaal string, prijs double, reden string")
    assert [r for r in df.withColumn("nu", venues.left_out(rules)).collect() if r["nu"] != r["reden"]] == []
    with pytest.raises(ValueError):
        venues.left_out([Rule("a", "soort", "onbekend", (), "")])


def test_one_scan_for_all_members(spark):
    runs = spark.sparkContext.accumulator(0)

    def scan():
        runs.add(1)
        return spark.range(100).select(F.concat(F.lit("v"), (F.col("id") % 4).cast("string")).alias("theaterId"), "id")

    got = venues.shared_scan(scan, ("v0", "v1", "v9"))
    assert (got.counts, got.error, runs.value) == ({"v0": 25, "v1": 25, "v9": 0}, None, 1)
    assert {m: sorted(r["id"] for r in df.collect()) for m, df in got.rows.items()} == {"v0": [*range(0, 100, 4)], "v1": [*range(1, 100, 4)], "v9": []}
    assert got.rows["v0"].columns == ["theaterId", "id"]
    # a member's rows come from its own folder, not from the scan
    assert "PartitionFilters: [isnotnull(_lid" in got.rows["v0"]._jdf.queryExecution().executedPlan().toString()


def test_a_failure_is_everybodys(spark):
    def broken():
        return spark.range(100).select(F.lit("v0").alias("theaterId"), F.when(F.col("id") == 77, F.raise_error(F.lit("page 77"))).otherwise(F.col("id")).alias("id"))

    got = venues.shared_scan(broken, ("v0", "v1"))
    assert got.rows == {} and got.counts == {"v0": 0, "v1": 0} and got.error
    assert venues.shared_scan(lambda: 1 / 0, ("v0",)).error == "division by zero"
    none = venues.shared_scan(lambda: spark.range(0).select(F.lit("v0").alias("theaterId")), ("v0",))
    assert none.error is None and none.rows["v0"].collect() == []


def test_intervals_join_equal_states(spark):
    rows = [("p", 1, 1, "a"), ("p", 2, 2, "a"), ("p", 3, 3, "b"), ("p", 3, 4, "c"), ("p", 5, 5, None), ("p", 6, 6, None), ("p", 7, 7, "a"), ("q", 1, 8, None), (None, 1, 9, "a")]
    df = spark.createDataFrame(rows, "plan string, op int, seq int, wie string")
    got = sorted((tuple(r) for r in history.intervals(df, ["plan"], "wie", "op", "seq").collect()), key=str)
    assert got == sorted([("p", "a", 1, 3), ("p", "c", 3, 5), ("p", None, 5, 7), ("p", "a", 7, None), ("q", None, 1, None), (None, "a", 1, None)], key=str)


def test_runs_and_writes_against_a_loop(spark):
    rnd = random.Random(2)
    rows = [(u, rnd.randint(0, 3000), rnd.randint(0, 9), rnd.choice("xyz")) for u in range(20) for _ in range(30)]
    rows = list({(u, t): (u, t, s, c) for u, t, s, c in rows}.values())
    want = set()
    for u in range(20):
        mine, highest, stood, runs = sorted(r for r in rows if r[0] == u), None, None, []
        for r in mine:
            if runs and r[1] <= runs[-1][-1][1] + 60:
                runs[-1].append(r)
            else:
                runs.append([r])
        for run in runs:
            _, _, stand, content = max(run, key=lambda r: (r[2], r[1]))
            older = highest is not None and stand < highest
            outcome = "ouder" if older else "gelijk" if content == stood else "geschreven"
            if not older:
                stood = content
            highest = stand if highest is None else max(highest, stand)
            want.add((u, run[0][1], run[-1][1] + 60, len(run), stand, content, outcome))
    df = spark.createDataFrame(rows, "user int, t int, stand int, inhoud string").withColumn("ts", F.timestamp_seconds("t"))
    got = history.writes(history.settled(df, "60 seconds")).select("user", F.unix_seconds("begin"), F.unix_seconds("einde"), "n", "stand", "inhoud", "uitkomst")
    assert {tuple(r) for r in got.collect()} == want
