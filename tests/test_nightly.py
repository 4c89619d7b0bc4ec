"""The refresh as a whole: steps in their order, the same result again, and from any partitioning."""

from datetime import date

from pyspark.sql import functions as F
from test_operators import shows

from marquee.operators import curation, lists, nightly, reports, titles
from marquee.sources import api

TODAY = date(2026, 1, 1)
ROWS = [
    dict(theaterId="a", titel="Koning – 250 jaar – Ada Lint", volgordeZeker=True, genre="Cabaret"),
    dict(theaterId="b", titel="KONING – Ada Lint", volgordeZeker=True, datum=date(2026, 1, 2), genre="Overig"),
    dict(theaterId="c", titel="Koning | Ada Lint", volgordeZeker=True, datum=date(2026, 1, 3), genre="Cabaret"),
    dict(theaterId="a", titel="Bos (try-out)", maker="door Mia Bos", datum=date(2026, 1, 4)),
    dict(theaterId="b", titel="Bos – UITVERKOCHT", beschikbaarheid="onbekend", datum=date(2026, 1, 5)),
    dict(theaterId="c", titel="Zee", maker="Mia Bos", datum=date(2026, 1, 6)),
    dict(theaterId="a", titel="Workshop dansen", datum=date(2026, 1, 6)),
    dict(theaterId="a", titel="Oud", datum=date(2025, 12, 31)),
    dict(theaterId="a", titel="Ver weg", datum=date(2028, 1, 2)),
    dict(theaterId="a", titel="bos (TRY-OUT)", datum=date(2026, 1, 4)),
    dict(theaterId="d", titel="Van toen", datum=date(2026, 1, 7)),
]


def run(spark, rows, parts=3, again=None):
    table = shows(spark, rows).drop("norm", "sleutel").repartition(parts)
    previous = table.filter("titel = 'Van toen'")
    venues = spark.createDataFrame([(v, "stuk" if v == "d" else None) for v in "abcd"], "theaterId string, error string")
    out, status = nightly.refresh(table.filter("titel <> 'Van toen'"), previous, venues, nightly.Lists(), TODAY)
    return {r["seq"]: r for r in out.collect()}, {r["theaterId"]: r["status"] for r in status.collect()}


def test_refresh(spark):
    out, status = run(spark, ROWS)
    assert status == {"a": "ok", "b": "ok", "c": "ok", "d": "terugval"}
    assert sorted(out) == ["0000", "0001", "0002", "0003", "0004", "0005", "0010"]
    assert {out[k]["titel"] for k in ("0000", "0001", "0002")} == {"Koning – Ada Lint"}
    assert {out[k]["genre"] for k in ("0000", "0001", "0002")} == {"Cabaret"} and out["0001"]["genreBron"] == "Overig"
    assert out["0000"]["titelBron"] == "Koning – 250 jaar – Ada Lint" and out["0000"]["beschrijving"] == "250 jaar"
    assert [(out[k]["titel"], out[k]["maker"]) for k in ("0003", "0004")] == [("Bos", "Mia Bos")] * 2
    assert out["0004"]["beschikbaarheid"] == "uitverkocht" and out["0003"]["makerBron"] == "door Mia Bos"


def test_same_from_any_partitioning(spark):
    text = lambda r: {k: str(v) for k, v in r.items()}
    assert text(run(spark, ROWS, 1)[0]) == text(run(spark, ROWS, 7)[0])


def test_lists_of_old_forms(spark):
    copies = spark.createDataFrame([(1, "k", "Bos", None, None, 4.5, [("2026-01-02", "Mia", None), ("2026-01-05", None, "Dans")]), (1, "q", "Zee", "Bo", None, None, [])], "user int, sleutel string, titel string, maker string, genre string, beoordeling double, bezoeken array<struct<datum:string,maker:string,genre:string>>")
    live = spark.createDataFrame([("q", "De Zee", None, "Toneel")], "sleutel string, titel string, maker string, genre string")
    out = [tuple(r) for r in lists.shared_seen(copies, live).orderBy("sleutel").collect()]
    assert out == [(1, "k", "Bos", "Mia", "Dans", 4.5, "2026-01-05", 2), (1, "q", "De Zee", "Bo", "Toneel", None, None, 1)]


def test_slug_order_and_pass(spark):
    rows = spark.createDataFrame([("/a/het-bos-mia/1/", "Het Bos", "Mia"), ("/a/mia-het-bos/1/", "Het Bos", "Mia"), ("/a/x/1/", "Het Bos", "Mia"), (None, None, None)], "h string, a string, b string")
    show, artist = titles.order_by_slug(F.col("h"), F.col("a"), F.col("b"))
    assert [tuple(r) for r in rows.select(show, artist).collect()] == [("Het Bos", "Mia"), ("Mia", "Het Bos"), (None, None), (None, None)]
    cases = spark.createDataFrame([("elders.nl", "beschikbaar", True, 10.0, True), ("", "beschikbaar", True, 60.0, True), ("", "beschikbaar", True, 40.0, False), ("", "uitverkocht", True, 60.0, False), ("own.nl", "beschikbaar", True, None, True)], "h string, s string, r boolean, p double, w boolean")
    assert [r[0] for r in cases.select(titles.pass_by_sale(F.col("h"), "own", F.col("s"), F.col("r"), F.col("p"), F.col("w"))).collect()] == [False, False, False, True, True]


def test_blocks_and_messages(spark):
    text = "a <!-- AUTO:n:start -->old<!-- AUTO:n:end --> b"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(reports.replace_blocks(F.col("t"), {"n": F.lit("new")})).first()[0] == "a <!-- AUTO:n:start -->\nnew\n<!-- AUTO:n:end --> b"
    row = spark.createDataFrame([("ada", "Ada <Lint>", "Bos & Zee", "Huis", None, date(2026, 11, 13), "20:00")], "gebruikersnaam string, naam string, titel string, theaterNaam string, stad string, datum date, tijd string")
    r = reports.invitation(row, "https://x.example/app/").first()
    assert r["onderwerp"] == "@ada nodigt je uit voor Bos & Zee" and "vr 13 nov · 20:00\nHuis" in r["tekst"] and "Bos &amp; Zee" in r["html"] and "&lt;Lint&gt;" in r["html"]


def test_productions_map(spark):
    text = '{"productions": {"1": {"id": "1", "title": "Bos", "events": [{"start": "s", "soort": "Voorstelling"}, {"start": "t", "soort": "inleiding"}]}, "2": {"id": "2", "title": "Leeg", "events": []}}}'
    out = api.production_events(spark.createDataFrame([(text,)], "json string")).collect()
    assert [(r["production"], r["titel"], r["start"]) for r in out] == [("1", "Bos", "s")]


def test_proposals(spark):
    members = spark.createDataFrame(
        [("bos", "ada | bos", "Bos – Ada Lint", None, "t1", 9), ("bos", "bos", "Bos", "Ada Lint", "t2", 3), ("bos", "bos", "Bos", None, "t3", 1)],
        "groep string, sleutel string, titel string, maker string, theaterId string, n int",
    )
    out = curation.proposals(members).collect()
    assert [(r["groep"], r["canoniek"]) for r in out] == [("bos", "Bos")]
    choices = spark.createDataFrame([("bos", "ada | bos", "Bos", "Ada"), ("zee", "zee 1", "Zee", None), ("zee2", "zee 1", "Meer", None)], "groep string, bron string, titel string, maker string")
    old = spark.createDataFrame([("oud", "Bos", None, False, "bos", "keuze"), ("los", "X", None, False, "x", "R2"), ("weg", "Y", None, False, "y", "R2")], "sleutel string, titel string, maker string, makerVast boolean, groep string, regel string")
    never = spark.createDataFrame([("y", "weg")], "groep string, sleutel string")
    merged, conflicts = curation.merge_choices(old, choices, never)
    assert {(r["sleutel"], r["titel"], r["regel"]) for r in merged.collect()} == {("ada | bos", "Bos", "keuze"), ("oud", "Bos", "keuze"), ("los", "X", "R2")}
    assert [r["bron"] for r in conflicts.collect()] == ["zee 1"]
