"""Queries whose order is that of Dutch names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order
from .shows import table

#: Beginnings that sort differently by code point, without accents and in Dutch.
STARTS = ("Émile", "emmer", "Eik", "één", "Een", "Zèbre", "zebra", "IJs", "ijs", "Äpfel", "appel", "coöperatie", "cooper", "'s Avonds", "Łódź", "lama")
_LIST = ", ".join("'" + x.replace("'", "''") + "'" for x in STARTS)


def _start(number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, STARTS)), (number % len(STARTS) + 1).cast("int"))


def list_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a shared list by title."""
    o = table(spark, sf_dir, "orders")
    title = F.concat_ws(" ", _start(F.floor(F.col("o_totalprice"))), F.when(F.col("o_orderkey") % 3 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")))
    items = o.select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("sleutel"), title.alias("titel"))
    return order.by_title(items)


def venue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    venues = s.select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("theaterId"), F.col("s_nationkey").alias("stad"))
    names = s.filter("s_suppkey % 7 <> 0").select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("theaterId"), F.concat_ws(" ", _start(F.floor(F.col("s_suppkey") / 3)), F.substring("s_name", -1, 1)).alias("naam"))
    return order.venues_by_name(venues, names)


def first_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title of each customer's list."""
    return order.first_by_name(list_by_title(spark, sf_dir), ["user"], "titel")


QUERIES = {f.__name__: f for f in (list_by_title, venue_order, first_title)}

_ITEMS = f"""WITH i AS (SELECT o_custkey AS "user", o_orderkey AS sleutel, [{_LIST}][(floor(o_totalprice)::BIGINT % {len(STARTS)} + 1)::INT] || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS titel FROM orders)"""
ORACLE_SQL = {
    "list_by_title": _ITEMS + ' SELECT "user", sleutel, titel, row_number() OVER (PARTITION BY "user" ORDER BY titel COLLATE nl, sleutel)::INT AS plaats FROM i',
    "venue_order": f"""WITH n AS (SELECT 'v' || s_suppkey AS theaterId, s_nationkey AS stad, CASE WHEN s_suppkey % 7 <> 0 THEN [{_LIST}][(s_suppkey // 3 % {len(STARTS)} + 1)::INT] || ' ' || right(s_name, 1) ELSE 'v' || s_suppkey END AS naam FROM supplier)
SELECT theaterId, stad, naam, row_number() OVER (PARTITION BY stad ORDER BY naam COLLATE nl, theaterId)::INT AS plaats FROM n""",
    "first_title": _ITEMS + ' SELECT "user", titel FROM i QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY titel COLLATE nl, titel) = 1',
}
