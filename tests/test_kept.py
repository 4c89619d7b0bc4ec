"""Tables that are kept between runs: replays, breaks half way, versions."""

import random

import pytest

from marquee import publish
from marquee.operators import names
from marquee.storage import new_folder

CHANGES = "uid string, soort string, seq bigint, naam string, vindbaar boolean"


def some(n=300):
    rnd = random.Random(7)
    people = ["Anna de Vries", "ánna  DE vries", "Bo", None, "Jan Jansen", "x" * 40 + " " + "y" * 40, ""]
    return [(f"u{rnd.randint(0, 30)}", rnd.choice(["profiel", "voorkeur"]), i, rnd.choice(people), rnd.random() < 0.7) for i in range(n)]


def plain(rows):
    """{uid: normal name} of the index, by the newest change of either kind."""
    last = {}
    for uid, kind, _, name, findable in sorted(rows, key=lambda r: r[2]):
        last[uid, kind] = name if kind == "profiel" else findable
    out = {}
    for uid in {r[0] for r in rows}:
        normal = " ".join((last.get((uid, "profiel")) or "").lower().replace("á", "a").split())
        if last.get((uid, "voorkeur")) and " " in normal and len(last[uid, "profiel"]) <= 60:
            out[uid] = normal
    return out


def found(df):
    import hashlib

    hashed = {hashlib.sha256(n.encode()).hexdigest(): n for n in ("anna de vries", "jan jansen")}
    return {r["uid"]: hashed[r["sleutel"]] for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_index_after_any_order_and_replays(spark, seed):
    """Batches in any order, some of them twice and one after compaction, lead to what the whole feed says."""
    rows, rnd = some(), random.Random(seed)
    shuffled = rnd.sample(rows, len(rows))
    batches = [shuffled[i : i + 60] for i in range(0, 300, 60)]
    at = new_folder(spark, "names")
    df = lambda b: spark.createDataFrame(b, CHANGES)
    for n in (0, 1, 2):
        names.apply_batch(df(batches[n]), at, n)
    names.apply_batch(df(batches[1]), at, 1)
    names.compact(spark, at, 2)
    for n in (4, 0, 3):
        names.apply_batch(df(batches[n]), at, n)
    assert found(names.index(spark, at)) == plain(rows)
    names.compact(spark, at, 4)
    assert found(names.index(spark, at)) == plain(rows)
    again = names.outcomes(names.state(spark, at), df(rows)).collect()
    assert {r["uitkomst"] for r in again} == {names.UNCHANGED} and len(again) == len({r[0] for r in rows})


def test_outcomes(spark):
    held = names.newest(spark.createDataFrame([("a", "profiel", 1, "Anna de Vries", None), ("a", "voorkeur", 2, None, True), ("b", "profiel", 3, "Jan Jansen", None)], CHANGES))
    new = spark.createDataFrame([("a", "voorkeur", 9, None, False), ("b", "voorkeur", 9, None, True), ("c", "profiel", 9, "Bo", None), ("a", "profiel", 0, "Oud Nieuws", None)], CHANGES)
    assert {r["uid"]: r["uitkomst"] for r in names.outcomes(held, new).collect()} == {"a": "verwijderd", "b": "gezet", "c": "ongewijzigd"}


def test_stream_in_many_batches(spark):
    rows, at = some(), new_folder(spark, "names")
    spark.createDataFrame(rows, CHANGES).repartition(9).write.parquet(f"{at}/bron")
    for _ in range(2):  # a second run finds nothing new
        names.follow(spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 2).parquet(f"{at}/bron"), f"{at}/index", every=2)
        assert found(names.index(spark, f"{at}/index")) == plain(rows)


def test_a_write_that_breaks_off_changes_nothing(spark):
    from pyspark.sql import functions as F

    at = new_folder(spark, "table")
    schema = "x bigint"
    assert publish.current(spark, at, schema).collect() == []
    publish.publish(spark.range(5).toDF("x"), at, 1)
    broken = spark.range(0, 100, 1, 8).select(F.when(F.col("id") == 90, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).cast("bigint").alias("x"))
    with pytest.raises(Exception, match="half way"):
        publish.publish(broken, at, 2)
    assert publish.current(spark, at, schema).count() == 5
    assert publish.publish(spark.range(2).toDF("x"), at, 3, least=3)["uitkomst"] == publish.TOO_FEW
    assert publish.publish(spark.range(9).toDF("x"), at, 0)["uitkomst"] == publish.OLDER
    assert publish.current(spark, at, schema).count() == 5
    publish.publish(spark.range(7).toDF("x"), at, 1)
    assert publish.current(spark, at, schema).count() == 7
    # files of the current version are lost: the version before it is read
    files, path = publish._files(spark, max(p["map"] for p in publish._pointers(spark, at) if p["uitkomst"] == publish.PLACED))
    files.delete(path, True)
    assert publish.current(spark, at, schema).count() == 5
    assert [(r["versie"], r["uitkomst"]) for r in publish.status(spark, at).orderBy("versie").collect()] == [(1, "geplaatst"), (2, "te-weinig"), (3, "ouder"), (4, "geplaatst")]


def test_two_writers(spark):
    at = new_folder(spark, "table")
    publish.publish(spark.range(1).toDF("x"), at, 1)
    with pytest.raises(RuntimeError):
        publish._say(spark, at, {"versie": 1, "stand": 1, "rijen": 0, "uitkomst": "geplaatst", "map": None})
