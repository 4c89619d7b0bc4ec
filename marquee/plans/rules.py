"""Queries on writes of documents: every order is a write, made, changed or taken away, with what its number breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import rules
from .shows import table

_NOW = "timestamp '1997-06-01 12:00:00'"
_FIELDS = {"profile": rules.PROFILE_FIELDS, "copy": rules.COPY_FIELDS, "plan": rules.PLAN_FIELDS, "friend": ("sinds", "uid", "via")}


def _list(values, extra: str | None = None) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in (*values, *([extra] if extra else []))) + ")"


#: k: the order's number; h: another number of it, so that faults of different kinds meet in one write.
_O = "SELECT o_orderkey AS id, o_orderkey AS k, cast(floor(o_totalprice) AS bigint) AS h, cast(o_custkey % 120 AS string) AS a, cast(cast(floor(o_totalprice) AS bigint) % 119 AS string) AS b, o_orderdate FROM {orders}"
_WHEN = "if(k % 4 = {none}, NULL, {doc})"

_PROFILE = "named_struct('gebruikersnaam', concat('Gast.', {u}), 'gebruikersnaamLaag', {low}, 'naam', if(h % 13 = 0, 'Bo', concat('Ada ', {u})), 'aangemaaktOp', {made}, 'gewijzigdOp', if(h % 17 = 0, {now} - INTERVAL 1 DAY, {now}), 'v', if(h % 19 = 0, 2, 1), 'velden', if(h % 23 = 0, {odd}, {fields}))"


def _profile(u: str, low: str, made: str) -> str:
    return _PROFILE.format(u=u, low=low, made=made, now=_NOW, odd=_list(_FIELDS["profile"], "extra"), fields=_list(_FIELDS["profile"]))


def _writes(spark: SparkSession, sf_dir: str, columns: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return spark.sql(f"SELECT id, {_NOW} AS nu, {columns} FROM ({_O})", orders=orders)


def profile_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _profile("a", "if(h % 11 = 0, 'admin', concat('gast.', a))", f"if(h % 7 = 0, {_NOW} - INTERVAL 2 DAYS, {_NOW} - if(k % 4 = 2, INTERVAL 9 DAYS, INTERVAL 0 DAYS))")
    was = _profile("b", "if(h % 3 = 0, concat('gast.', a), concat('oud.', b))", f"{_NOW} - INTERVAL 9 DAYS")
    writes = _writes(spark, sf_dir, f"a AS uid, if(h % 29 = 0, b, a) AS ik, {_WHEN.format(none=1, doc=was)} AS was, {_WHEN.format(none=3, doc=now)} AS na").filter("was IS NOT NULL OR na IS NOT NULL")
    names = spark.sql("SELECT concat('gast.', x) AS laag, if(x % 10 = 3, 'ander', x) AS uid, concat('Ada ', x) AS naam FROM (SELECT DISTINCT cast(o_custkey % 120 AS string) AS x FROM {orders}) UNION ALL SELECT DISTINCT concat('oud.', cast(o_custkey % 60 AS string)), 'x', 'y' FROM {orders}", orders=table(spark, sf_dir, "orders"))
    return rules.profile_writes(writes, names)


def copy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = lambda stand, items: f"named_struct('items', {items}, 'stand', {stand}, 'nv', if(h % 17 = 0, 0, 3), 'v', 1, 'bijgewerktOp', if(h % 13 = 0, {_NOW} - INTERVAL 1 SECOND, {_NOW}), 'velden', if(h % 11 = 0, {_list(_FIELDS['copy'][1:])}, {_list(_FIELDS['copy'])}))"
    columns = f"a AS uid, CASE h % 5 WHEN 0 THEN 'gepland' WHEN 1 THEN 'gezien' ELSE 'watchlist' END AS onderdeel, if(h % 29 = 0, b, a) AS ik, {_WHEN.format(none=1, doc=doc('k % 100', '1'))} AS was, {_WHEN.format(none=3, doc=doc('h % 100 - 1', 'h % 1010'))} AS na"
    settings = spark.sql("SELECT x AS uid, y AS onderdeel, (x + length(y)) % 3 <> 0 AS deelt FROM (SELECT DISTINCT cast(o_custkey % 120 AS string) AS x FROM {orders}) LATERAL VIEW explode(array('gezien', 'watchlist')) e AS y", orders=table(spark, sf_dir, "orders"))
    return rules.copy_writes(_writes(spark, sf_dir, columns), settings)


def plan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = lambda owner, guests, ended, fixed: f"""named_struct('eigenaar', {owner}, 'sleutel', repeat('s', cast(h % 420 AS int)), 'sleutelV', if(h % 31 = 0, NULL, 3), 'titel', repeat('t', cast(h % 203 AS int)), 'theaterId', 'v1', 'theaterNaam', 'Zaal', 'stad', repeat('s', cast(h % 83 AS int)),
      'datum', if(h % 37 = 0, '1997-6-1', date_format(o_orderdate, 'yyyy-MM-dd')), 'tijd', CASE h % 5 WHEN 0 THEN NULL WHEN 1 THEN '9:00' ELSE '20:15' END, 'speeldag', if(h % 7 = 0, cast(o_orderdate AS timestamp) + INTERVAL 1 HOUR, cast(cast(o_orderdate AS date) AS timestamp)), 'genodigden', {guests}, 'opgeheven', {ended},
      'aangemaaktOp', {_NOW}, 'gewijzigdOp', if(h % 13 = 0, NULL, {_NOW}), 'velden', {_list(_FIELDS['plan'])}, 'vast', {fixed})"""  # noqa: E731
    was, now = doc("if(h % 29 = 0, b, a)", "array('g1', 'g2')", "h % 4 = 1", "'x'"), doc("a", "transform(sequence(1, cast(1 + h % 11 AS int)), i -> if(h % 41 = i, a, concat('g', i)))", "h % 3 = 0", "if(h % 43 = 0, 'y', 'x')")
    columns = f"k AS plan, a AS ik, {_WHEN.format(none=1, doc=was)} AS was, {_WHEN.format(none=3, doc=now)} AS na"
    orders = table(spark, sf_dir, "orders")
    profiles = spark.sql("SELECT DISTINCT cast(o_custkey % 120 AS string) AS uid FROM {orders} WHERE o_custkey % 120 % 9 <> 0", orders=orders)
    members = spark.sql("SELECT o_orderkey AS plan, cast(o_custkey % 120 AS string) AS uid, if(o_custkey % 5 = 0, 'gast', 'organisator') AS rol FROM {orders} WHERE o_custkey % 11 <> 0", orders=orders)
    return rules.plan_writes(_writes(spark, sf_dir, columns), profiles, members)


def friend_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = f"named_struct('uid', if(h % 31 = 0, a, b), 'sinds', if(h % 13 = 0, NULL, {_NOW}), 'via', CASE h % 3 WHEN 0 THEN 'link' ELSE 'verzoek' END, 'token', if(h % 3 = 0, concat('t', k), NULL), 'velden', if(h % 3 = 0, {_list(_FIELDS['friend'], 'token')}, {_list(_FIELDS['friend'])}))"
    columns = f"a AS eigenaar, if(h % 37 = 0, a, b) AS vriend, CASE h % 7 WHEN 0 THEN 'x' WHEN 1 THEN b ELSE a END AS ik, if(k % 4 IN (2, 3), {doc}, NULL) AS was, if(k % 4 = 3, NULL, {doc}) AS na"
    o = spark.sql(_O, orders=table(spark, sf_dir, "orders"))
    of = lambda where, *columns_: o.filter(where).selectExpr(*columns_)
    return rules.friend_writes(
        _writes(spark, sf_dir, columns), of("cast(a AS int) % 9 <> 0", "a AS uid"), of("k % 11 = 0", "b AS a", "a AS b"), of("h % 5 <> 0", "b AS eigenaar", "a AS vriend"), of("h % 2 = 0", "b AS van", "a AS naar"), of("h % 16 = 0", "b AS van", "a AS naar"),
        of("h % 3 = 0", "concat('t', k) AS token", "b AS uid", f"if(h % 2 = 0, {_NOW} - INTERVAL 7 DAYS, {_NOW} - INTERVAL 1 DAY) AS aangemaaktOp"), of("h % 15 = 0", "concat('t', k) AS token"),
    )


QUERIES = {f.__name__: f for f in (profile_writes, copy_rules, plan_rules, friend_rules)}

_S = "WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, floor(o_totalprice)::BIGINT AS h, (o_custkey % 120)::VARCHAR AS a, (floor(o_totalprice)::BIGINT % 119)::VARCHAR AS b, o_custkey AS c, o_orderdate::DATE AS d FROM orders), w AS (SELECT *, CASE k % 4 WHEN 1 THEN 'maken' WHEN 3 THEN 'weghalen' ELSE 'wijzigen' END AS soort FROM o)"


def _judged(checks: list[tuple[str, str, str]], source: str = "w") -> str:
    """checks: name, kinds (m, w, d), what must hold."""
    names = {"m": "maken", "w": "wijzigen", "d": "weghalen"}
    cases = ", ".join(f"CASE WHEN soort IN ({', '.join(repr(names[x]) for x in kinds)}) AND NOT coalesce({holds}, false) THEN '{name}' END" for name, kinds, holds in checks)
    return f" SELECT id, soort, len(g) = 0 AS toegestaan, g AS gebroken FROM (SELECT id, soort, list_filter([{cases}], lambda x: x IS NOT NULL) AS g FROM {source})"


_ROW = "(CASE WHEN h % 11 = 0 THEN 'admin' ELSE 'gast.' || a END)"
ORACLE_SQL = {
    "profile_writes": _S + ", old AS (SELECT DISTINCT 'oud.' || (o_custkey % 60) AS laag FROM orders UNION SELECT DISTINCT 'gast.' || a FROM o), v AS (SELECT *, CASE WHEN h % 3 = 0 THEN 'gast.' || a ELSE 'oud.' || b END AS was FROM w), x AS (SELECT *, was IN (FROM old) AS bezet FROM v)" + _judged([
        ("eigenaar", "mwd", "h % 29 <> 0 OR a = b"), ("velden", "mw", "h % 23 <> 0"), ("laag", "mw", "h % 11 <> 0"), ("weergave", "mw", "h % 11 <> 0"), ("naam", "mw", "h % 13 <> 0"), ("versie", "mw", "h % 19 <> 0"), ("gewijzigd", "mw", "h % 17 <> 0"),
        ("naamrij", "mw", "h % 11 <> 0 AND a::INT % 10 <> 3 AND h % 13 <> 0"), ("aangemaakt", "mw", "CASE WHEN h % 7 = 0 THEN false WHEN soort = 'maken' THEN true ELSE k % 4 = 2 END"), ("oude naam vrij", "w", f"was = {_ROW} OR NOT bezet"), ("naam vrij", "d", "NOT bezet"),
    ], "x"),
    "copy_rules": _S + ", s AS (SELECT *, CASE h % 5 WHEN 0 THEN 'gepland' WHEN 1 THEN 'gezien' ELSE 'watchlist' END AS deel FROM w)" + _judged([
        ("eigenaar", "mwd", "h % 29 <> 0 OR a = b"), ("onderdeel", "mw", "deel <> 'gepland'"), ("gedeeld", "mw", "deel <> 'gepland' AND (a::INT + length(deel)) % 3 <> 0"), ("velden", "mw", "h % 11 <> 0"), ("items", "mw", "h % 1010 <= 1000"), ("stand", "mw", "h % 100 >= 1"), ("versie", "mw", "h % 17 <> 0"),
        ("bijgewerkt", "mw", "h % 13 <> 0"), ("ouder", "w", "h % 100 - 1 >= k % 100"),
    ], "s"),
    "plan_rules": _S + ", p AS (SELECT *, d + INTERVAL (CASE WHEN h % 7 = 0 THEN 25 ELSE 24 END) HOUR > TIMESTAMP '1997-06-01 12:00:00' AS loopt FROM w)" + _judged([
        ("weghalen", "d", "false"), ("eigenaar", "mw", "soort = 'maken' OR h % 29 <> 0 OR a = b"), ("velden", "m", "true"), ("sleutel", "m", "h % 420 <= 400 AND h % 31 <> 0"), ("voorstelling", "m", "h % 203 BETWEEN 1 AND 200 AND h % 83 <= 80 AND h % 5 <> 1"), ("speeldag", "m", "h % 37 <> 0 AND h % 7 <> 0 AND loopt"),
        ("genodigden", "mw", "h % 11 < 10 AND NOT (h % 41 BETWEEN 1 AND 1 + h % 11)"), ("opgeheven", "m", "h % 3 <> 0"), ("aangemaakt", "m", "true"), ("gewijzigd", "mw", "h % 13 <> 0"), ("profiel", "m", "a::INT % 9 <> 0"), ("organisator", "m", "c % 11 <> 0 AND c % 5 <> 0"),
        ("vaste velden", "w", "h % 43 <> 0"), ("heropend", "w", "h % 4 <> 1 OR h % 3 = 0"), ("te laat", "w", "(1 + h % 11 <= 2 AND NOT (h % 41 BETWEEN 1 AND 1 + h % 11)) OR (h % 4 <> 1 AND h % 3 <> 0 AND loopt)"),
    ], "p"),
    "friend_rules": _S + """, y AS (SELECT *, CASE WHEN h % 37 = 0 THEN a ELSE b END AS vriend, CASE h % 7 WHEN 0 THEN 'x' WHEN 1 THEN b ELSE a END AS ik FROM (SELECT * REPLACE (CASE k % 4 WHEN 2 THEN 'wijzigen' WHEN 3 THEN 'weghalen' ELSE 'maken' END AS soort) FROM w)),
z AS (SELECT *, CASE WHEN ik = a THEN vriend WHEN ik = vriend THEN a END AS ander, (vriend, a) IN (SELECT (b, a) FROM o WHERE h % 5 <> 0) AS terug, (a, vriend) IN (SELECT (b, a) FROM o WHERE k % 11 = 0 UNION SELECT (a, b) FROM o WHERE k % 11 = 0) AS blok FROM y),
q AS (SELECT *, (ander, ik) IN (SELECT (b, a) FROM o WHERE h % 2 = 0) AS vroeg, (ander, ik) IN (SELECT (b, a) FROM o WHERE h % 16 = 0) AS vraagt FROM z)""" + _judged([
        ("wijzigen", "w", "false"), ("partij", "md", "ander IS NOT NULL"), ("zelf", "m", "a <> vriend"), ("velden", "m", "true"), ("uid", "m", "CASE WHEN h % 31 = 0 THEN a ELSE b END = vriend"), ("sinds", "m", "h % 13 <> 0"), ("profiel", "m", "ik <> 'x' AND ik IN (SELECT a FROM o WHERE a::INT % 9 <> 0)"), ("terug", "m", "terug"),
        ("blokkade", "m", "NOT blok"), ("toestemming", "m", "CASE WHEN h % 3 = 0 THEN b = ander AND h % 2 <> 0 AND h % 15 <> 0 ELSE vroeg AND NOT vraagt END"), ("andere richting", "d", "NOT terug"),
    ], "q"),
}
