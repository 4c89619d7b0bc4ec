"""Dutch order against a fixed table."""

from pyspark.sql import functions as F

from marquee.operators import order

#: As a Dutch dictionary has them: letters first, then accents, then small before capital letters.
ORDERED = ["'s Avonds", "Äpfel", "appel", "Een", "één", "Eik", "Émile", "emmer", "ijs", "IJs", "lama", "Łódź", "résumé", "zebra", "Zebra", "Zèbre"]


def test_fixed_table(spark):
    rows = spark.createDataFrame([(x, i % 3) for i, x in enumerate(reversed(ORDERED))], "naam string, k int").repartition(4)
    got = [r["naam"] for r in rows.orderBy(order.dutch("naam")).collect()]
    assert sorted(got) == sorted(ORDERED)
    plain = sorted(ORDERED)
    assert got != plain and [x for x in got if x in ("Een", "één", "Eik", "Émile", "emmer")] == ["Een", "één", "Eik", "Émile", "emmer"]
    assert got.index("appel") < got.index("Een") and got.index("Äpfel") < got.index("Eik") and got.index("ijs") < got.index("IJs") < got.index("lama")
    assert [r["naam"] for r in order.first_by_name(rows.withColumn("k", F.lit(1)), ["k"], "naam").collect()] == [got[0]]


def test_places(spark):
    items = spark.createDataFrame([(1, "b", "Émile"), (1, "a", "emmer"), (1, "c", "Émile"), (2, "d", None)], "user int, sleutel string, titel string")
    assert sorted((r["user"], r["plaats"], r["sleutel"]) for r in order.by_title(items).collect()) == [(1, 1, "b"), (1, 2, "c"), (1, 3, "a"), (2, 1, "d")]
