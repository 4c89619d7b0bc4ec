"""Groups of productions by anchors, on worked-out agendas."""

from datetime import date

import pytest

from marquee.functions import text as X
from marquee.operators import curation, groups

SCHEMA = "seq bigint, theaterId string, titel string, maker string, datum date, genre string"


def agenda(spark, rows):
    from pyspark.sql import functions as F

    data = [(i, t, titel, maker, date.fromisoformat(d), g) for i, (t, titel, maker, d, g) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).withColumn("sleutel", X.production_key(F.col("titel"), F.col("theaterId")))


def found(spark, rows):
    m = groups.members(agenda(spark, rows), date(2026, 10, 10))
    return {r["anker"]: r for r in groups.groups(m).collect()}, m


def test_missing_and_turned_maker(spark):
    """A maker that is missing at one venue makes a group without doubts; what is over does not count."""
    got, m = found(spark, [
        ("a", "Peertje Kaal – Nora Bos", None, "2026-11-01", "Cabaret"),
        ("b", "Peertje Kaal – Nora Bos", None, "2026-11-02", "Cabaret"),
        ("c", "Nora Bos", None, "2026-11-03", "Cabaret"),
        ("a", "The Play", "Theater Noordpool", "2026-11-04", "Toneel"),
        ("d", "Theater Noordpool – The Play", "regie: Flip Mol", "2026-11-05", "Toneel"),
        ("e", "Oud – Nora Bos", None, "2026-01-01", "Cabaret"),
    ])
    assert set(got) == {"nora bos", "theater noordpool"}
    assert (got["nora bos"]["soorten"], got["nora bos"]["twijfel"]) == (["e"], [])
    assert got["nora bos"]["sleutels"] == ["nora bos", "nora bos | peertje kaal"] and got["nora bos"]["n"] == 3
    proposed = {r["groep"]: r["canoniek"] for r in curation.proposals(groups.for_proposals(m)).collect()}
    assert proposed["nora bos"] == "Peertje Kaal – Nora Bos"


def test_two_makers_under_one_anchor(spark):
    """Names of one maker, by spelling or length, are a group; a second maker, or a second other part, is none."""
    one = [("a", "De Grote Reis", None, "2026-11-01", "Toneel"), ("b", "De Grote Reis – Jan Smit", None, "2026-11-02", "Toneel"), ("c", "De Grote Reis – Jan Smid", None, "2026-11-02", "Toneel"), ("d", "De Grote Reis – Jan Smit en Zonen", None, "2026-11-02", "Toneel")]
    got, _ = found(spark, one)
    assert got["de grote reis"]["namen"] == ["Jan Smit", "Jan Smid", "Jan Smit en Zonen"] and got["de grote reis"]["soorten"] == ["d", "e"]
    assert found(spark, [*one, ("e", "De Grote Reis – Piet Vos", None, "2026-11-02", "Toneel")])[0] == {}
    other = [*one[:2], ("c", "De Grote Reis – naar het noorden", None, "2026-11-02", "Toneel")]
    assert set(found(spark, other)[0]) == {"de grote reis"}
    assert found(spark, [*other, ("d", "De Grote Reis – naar het zuiden", None, "2026-11-02", "Toneel")])[0] == {}


def test_order_decides_clusters(spark):
    """Greedy: a name joins a cluster through any of its names, but a bridge that comes too late joins one only."""
    from pyspark.sql import functions as F

    rows = [(["abcdef", "abcdxx", "abxxxx"], False), (["abcdef", "abxxxx", "abcdxx"], True), (["jan", "jan smit", "jan vos"], False), (["jan smit", "jan vos abc", "jan"], True), (["x"], False), ([], False)]
    df = spark.createDataFrame(rows, "namen array<string>, meer boolean").select(groups.several_makers(F.col("namen")).alias("x"), "meer")
    assert all(r["x"] == r["meer"] for r in df.collect())


@pytest.mark.parametrize("titel", ["Live", "Pan", "Kerst", "De Musical"])
def test_generic_and_short_anchors(spark, titel):
    assert found(spark, [("a", titel, None, "2026-11-01", "Toneel"), ("b", f"{titel} – Jan Smit", None, "2026-11-01", "Toneel")])[0] == {}


def test_longest_anchor_and_one_group_of_the_same_keys(spark):
    """Two anchors that lead to the same keys are one group; doubts tell of genres and dates."""
    got, _ = found(spark, [("a", "Zee en Zand – Ada Lint", None, "2026-11-01", "Toneel"), ("b", "Zee en Zand – Ada Lint, met o.a. Bo", None, "2028-01-01", "Dans")])
    assert list(got) == ["zee en zand"]
    assert got["zee en zand"]["soorten"] == ["b", "c"]
    assert got["zee en zand"]["twijfel"] == ["ander genre: Dans / Toneel", "speeldata ruim een jaar uit elkaar"]


def test_empty(spark):
    assert found(spark, [])[0] == {}
