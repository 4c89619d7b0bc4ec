"""Load rounds: a second one changes nothing, whatever was loaded."""

import random

import pytest

from marquee.operators import loading

ITEM = "user int, sleutel string, titel string, theaterId string, op bigint, maker string, genre string"


def tables(spark, seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["k0", "k1", "k2", "oud1", "oud2", "nieuw1"])
    some = lambda x: rnd.choice([x, None])
    rows = lambda n: [(rnd.randint(0, 6), key(), rnd.choice("ab"), some("v1"), some(rnd.randint(0, 5)), some("M"), some("G"), i) for i in range(n)]
    dels = lambda n: [(rnd.randint(0, 6), key(), some(rnd.randint(0, 5))) for _ in range(n)]
    saved = list({(r[0], r[1]): r[:7] for r in rows(15)}.values())
    make = spark.createDataFrame
    return dict(
        saved=make(saved, ITEM), saved_gone=make(list({r[:2]: r for r in dels(5)}.values()), "user int, sleutel string, op bigint"), extra=make(rows(15), ITEM + ", seq int"), extra_gone=make(dels(6), "user int, sleutel string, op bigint"),
        favourites=make([(u, w) for u in range(3) for w in ("v1::Het Bos – Ada", "v2-het-bos-2026-01-31-2000")], "user int, waarde string"), known=make([("het bos", "Het Bos")], "sleutel string, titel string"),
        mapping=make([("oud1", "nieuw1"), ("oud2", "k0")], "oud string, nieuw string"), info=make([("k0", "Ada", None), ("nieuw1", "Bo", "Dans")], "sleutel string, maker string, genre string"),
    )


@pytest.mark.parametrize("seed", range(4))
def test_a_second_load_changes_nothing(spark, seed):
    t = tables(spark, seed)
    items, gone, users = (spark.createDataFrame(df.collect(), df.schema) for df in loading.load_round(**t))
    assert any(r["gewijzigd"] for r in users.collect())
    again = loading.load_round(**(t | {"saved": items, "saved_gone": gone}))
    assert not any(r["gewijzigd"] for r in again[2].collect())
    assert sorted(again[0].collect(), key=str) == sorted(items.collect(), key=str) and sorted(again[1].collect(), key=str) == sorted(gone.collect(), key=str)
    assert {r["sleutel"] for r in items.collect()}.isdisjoint({"oud1", "oud2"})


def test_what_counts_as_a_change(spark):
    t = tables(spark, 0)
    none = {k: t[k].limit(0) for k in ("extra", "extra_gone", "favourites", "mapping")}
    saved = spark.createDataFrame([(1, "k0", "a", "v1", 3, "Zelf", None), (2, "k0", "a", "v1", 3, None, None), (3, "k2", "a", None, 3, None, None), (4, "k2", "a", None, 3, None, None)], ITEM)
    gone = spark.createDataFrame([(4, "k2", 5), (5, "k9", 1)], "user int, sleutel string, op bigint")
    users = loading.load_round(**(t | none | {"saved": saved, "saved_gone": gone}))[2]
    # filled from the agenda, and deleted after it was added
    assert {r["user"]: r["gewijzigd"] for r in users.collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}
