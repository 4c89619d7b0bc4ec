"""Queries on friends, invitations and shared plans; users are customers, edges come from orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import social as G
from .shows import table

DAY = date(1997, 6, 1)


def _u(c) -> F.Column:
    return c.cast("string")


def _edges(spark: SparkSession, sf_dir: str):
    """(friends, blocks, requests): pairs of customers, by what an order's number leaves."""
    o = table(spark, sf_dir, "orders")
    a, b = F.col("o_custkey") % 120, F.floor(F.col("o_totalprice")) % 120
    pairs = o.select(F.col("o_orderkey").alias("k"), _u(a).alias("a"), _u(b).alias("b"))
    friends = pairs.filter("k % 5 = 0").select("a", "b").distinct()
    blocks = pairs.filter("k % 5 = 1 and k % 3 = 0").select("a", "b").distinct()
    requests = pairs.filter("k % 5 = 2").select(F.col("a").alias("van"), F.col("b").alias("naar")).distinct()
    return friends, blocks, requests


EDGES_SQL = """WITH pairs AS (SELECT o_orderkey AS k, (o_custkey % 120)::VARCHAR AS a, (floor(o_totalprice)::BIGINT % 120)::VARCHAR AS b FROM orders),
friends AS (SELECT DISTINCT a, b FROM pairs WHERE k % 5 = 0), blocks AS (SELECT DISTINCT a, b FROM pairs WHERE k % 5 = 1 AND k % 3 = 0), requests AS (SELECT DISTINCT a AS van, b AS naar FROM pairs WHERE k % 5 = 2)"""


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), _u(F.col("o_custkey") % 120).alias("van"), _u(F.floor(F.col("o_totalprice")) % 120).alias("naar"))


def request_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    friends, blocks, requests = _edges(spark, sf_dir)
    return G.request_outcome(_asks(spark, sf_dir), friends, blocks, requests)


def accepted_friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    friends, _, requests = _edges(spark, sf_dir)
    return G.accept(friends, requests, requests.filter("cast(van as int) % 2 = 0"))[0]


def requests_after_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    friends, blocks, requests = _edges(spark, sf_dir)
    return G.block(friends, requests, blocks, blocks)[1]


def friend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Friends that hold both ways and open requests, for every customer."""
    friends, _, requests = _edges(spark, sf_dir)
    mutual = friends.join(friends.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").groupBy("a").agg(F.count(F.lit(1)).alias("vrienden"))
    open_ = requests.groupBy(F.col("naar").alias("a")).agg(F.count(F.lit(1)).alias("verzoeken"))
    return mutual.join(open_, "a", "full_outer").select(F.col("a").alias("uid"), F.coalesce("vrienden", F.lit(0)).alias("vrienden"), F.coalesce("verzoeken", F.lit(0)).alias("verzoeken"))


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a searcher; they share ten names."""
    friends, blocks, _ = _edges(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("Ánna  de Vries-"), _u(F.col("c_custkey") % 10))
    profiles = c.select(_u(F.col("c_custkey")).alias("uid"), F.concat(F.lit("u"), F.lpad(_u(F.col("c_custkey")), 6, "0")).alias("gebruikersnaam"), name.alias("naam"), (F.col("c_custkey") % 3 != 0).alias("vindbaar"))
    searches = c.select(F.col("c_custkey").alias("zoek"), _u(F.col("c_custkey")).alias("uid"), F.concat(F.lit("anna de vries "), _u(F.col("c_custkey") % 12)).alias("naam"))
    return G.search_names(searches, profiles, blocks)


def link_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    friends, blocks, _ = _edges(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    token = F.concat(F.lit("token-token-token-token-"), _u(k - k % 3 + F.when(k % 7 == 0, 1).otherwise(0)))
    links = e.filter(k % 3 == 0).select(F.concat(F.lit("token-token-token-token-"), _u(k)).alias("token"), _u(F.col("user_id") % 120).alias("uid"), F.when(k % 9 != 0, F.col("ts").cast("timestamp")).alias("created"))
    opened = e.filter(k % 3 != 0).select("event_id", F.when(k % 10 == 0, "kort").otherwise(token).alias("token"), _u(k % 120).alias("uid"))
    return G.link_state(opened, links, friends, blocks, F.lit("2024-01-09 12:00:00").cast("timestamp")).select("event_id", "status")


def _plans(spark: SparkSession, sf_dir: str):
    o = table(spark, sf_dir, "orders")
    plans = o.select(F.col("o_orderkey").alias("plan"), _u(F.col("o_custkey") % 120).alias("eigenaar"), F.to_date("o_orderdate").alias("datum"), (F.col("o_orderkey") % 7 == 0).alias("opgeheven"))
    members = o.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("plan"), _u(F.floor(F.col("o_totalprice")) % 120).alias("uid"), F.lit("gast").alias("rol"), F.element_at(F.array(*map(F.lit, ("uitgenodigd", "gaat", "kan-niet", "weg"))), (F.floor(F.col("o_orderkey") / 5) % 4 + 1).cast("int")).alias("status"))
    invitations = o.select(F.col("o_orderkey").alias("plan"), _u(F.floor(F.col("o_totalprice")) % 120).alias("uid")).unionByName(o.filter("o_orderkey % 10 = 4").select((-F.col("o_orderkey")).alias("plan"), F.lit("1").alias("uid")))
    return plans, members, invitations


PLANS_SQL = EDGES_SQL + """, p AS (SELECT o_orderkey AS plan, (o_custkey % 120)::VARCHAR AS eigenaar, o_orderdate::DATE AS datum, o_orderkey % 7 = 0 AS opgeheven, (floor(o_totalprice)::BIGINT % 120)::VARCHAR AS gast, CASE WHEN o_orderkey % 11 <> 0 THEN ['uitgenodigd', 'gaat', 'kan-niet', 'weg'][(o_orderkey // 5 % 4 + 1)::INT] END AS status FROM orders),
inv AS (SELECT plan, gast AS uid FROM p UNION ALL SELECT -plan, '1' FROM p WHERE plan % 10 = 4)"""


def invitation_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    friends, blocks, _ = _edges(spark, sf_dir)
    plans, members, invitations = _plans(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    preferences = c.select(_u(F.col("c_custkey")).alias("uid"), (F.col("c_custkey") % 4 != 0).alias("uitnodigingen"))
    profiles = c.filter("c_custkey % 9 <> 0").select(_u(F.col("c_custkey")).alias("uid"))
    return G.invitation_reason(invitations, plans, members, friends, blocks, preferences, profiles, DAY)


def invitation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, members, invitations = _plans(spark, sf_dir)
    return G.invitation_state(invitations, plans, members, DAY)


def username_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Anna", "anna_", "a.b", "x", "admin", "Bo..b"))), (F.col("event_id") % 6 + 1).cast("int")), F.when(F.col("event_id") % 6 < 3, _u(F.col("event_id") % 700)).otherwise(""))
    return G.claim_usernames(e.select(_u(F.col("user_id")).alias("uid"), name.alias("gebruikersnaam"), F.col("event_id").alias("seq")))


def with_whom(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, members, _ = _plans(spark, sf_dir)
    return G.with_whom(plans, members, plans.select("plan", F.col("eigenaar").alias("ik")))


def shared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    items = o.select(_u(F.col("o_custkey") % 3).alias("user"), F.lpad(_u(F.col("o_orderkey")), 8, "0").alias("sleutel"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("  "), "o_orderpriority")).otherwise("  ").alias("titel"), F.repeat("o_orderstatus", 200).alias("maker"), F.lit("").alias("genre"))
    return G.shared_items(items)


def account_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    friends, blocks, requests = _edges(spark, sf_dir)
    _, gone = G.remove_account({"friends": friends, "blocks": blocks, "requests": requests}, "7")
    out = None
    for name, n in gone.items():
        row = n.select(F.lit(name).alias("tabel"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans, members, _ = _plans(spark, sf_dir)
    guests = members.select("plan", F.array("uid").alias("genodigden"))
    full = plans.join(guests, "plan", "left").withColumn("genodigden", F.coalesce("genodigden", F.array(F.lit("niemand")))).withColumn("tijd", F.when(F.col("plan") % 13 == 0, "24:00").otherwise("20:15"))
    c = table(spark, sf_dir, "customer")
    usernames = c.select(_u(F.col("c_custkey")).alias("uid"), F.concat(F.when(F.col("c_custkey") % 50 == 0, "_").otherwise("u"), F.lpad(_u(F.col("c_custkey")), 5, "0")).alias("gebruikersnaam"))
    profiles = usernames.filter("cast(uid as int) % 2 = 0").withColumn("gebruikersnaam", F.when(F.col("uid") == "8", "ander").otherwise(F.upper("gebruikersnaam")))
    copies = c.select(_u(F.col("c_custkey")).alias("user"), F.array_repeat(F.lit(1), F.when(F.col("c_custkey") == 3, 1001).otherwise(2)).alias("items"))
    return G.violations(profiles, usernames, full, members, copies, DAY)


def budget_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    body = F.to_json(F.struct(F.col("o_totalprice").alias("costAmount"), F.lit(250000.0).alias("budgetAmount")))
    message = F.when(F.col("o_orderkey") % 6 == 0, "geen base64!").when(F.col("o_orderkey") % 6 == 1, F.base64(F.lit('{"costAmount": "veel"}').cast("binary"))).otherwise(F.base64(body.cast("binary")))
    return o.select("o_orderkey", G.budget_action(message).alias("actie"))


QUERIES = {
    f.__name__: f
    for f in (
        request_outcome, accepted_friends, requests_after_block, friend_counts, name_search, link_state, invitation_reason, invitation_state, username_claims, with_whom, shared_items, account_removed,
        rule_violations, budget_action,
    )
}

_HAS = "EXISTS (FROM {0} WHERE {1})"
ORACLE_SQL = {
    "request_outcome": EDGES_SQL + """, asks AS (SELECT o_orderkey AS k, (o_custkey % 120)::VARCHAR AS van, (floor(o_totalprice)::BIGINT % 120)::VARCHAR AS naar FROM orders)
SELECT k, van, naar, CASE WHEN van = naar THEN 'zelf' WHEN (van, naar) IN (SELECT (a, b) FROM friends) THEN 'al-vrienden' WHEN (van, naar) IN (SELECT (a, b) FROM blocks) THEN 'jij-blokkeert' WHEN (naar, van) IN (SELECT (van, naar) FROM requests) THEN 'vrienden'
 WHEN (van, naar) IN (SELECT (van, naar) FROM requests) THEN 'al-verstuurd' WHEN (naar, van) IN (SELECT (a, b) FROM blocks) THEN 'niet-mogelijk' ELSE 'verstuurd' END AS uitkomst FROM asks""",
    "accepted_friends": EDGES_SQL + "SELECT a, b FROM friends UNION SELECT van, naar FROM requests WHERE van::INT % 2 = 0 UNION SELECT naar, van FROM requests WHERE van::INT % 2 = 0",
    "requests_after_block": EDGES_SQL + "SELECT van, naar FROM requests WHERE (van, naar) NOT IN (SELECT (a, b) FROM blocks UNION SELECT (b, a) FROM blocks)",
    "friend_counts": EDGES_SQL + """, m AS (SELECT a, count(*) AS n FROM friends WHERE (b, a) IN (SELECT (a, b) FROM friends) GROUP BY 1), o AS (SELECT naar, count(*) AS n FROM requests GROUP BY 1)
SELECT coalesce(a, naar) AS uid, coalesce(m.n, 0) AS vrienden, coalesce(o.n, 0) AS verzoeken FROM m FULL JOIN o ON a = naar""",
    "name_search": EDGES_SQL + """, j AS (SELECT s.c_custkey AS zoek, p.c_custkey AS b FROM customer s JOIN customer p ON s.c_custkey % 12 = p.c_custkey % 10 AND p.c_custkey % 3 <> 0 AND p.c_custkey <> s.c_custkey WHERE (s.c_custkey::VARCHAR, p.c_custkey::VARCHAR) NOT IN (SELECT (a, b) FROM blocks UNION SELECT (b, a) FROM blocks)),
r AS (SELECT *, row_number() OVER (PARTITION BY zoek ORDER BY b) AS k FROM j) SELECT zoek, 'u' || lpad(b::VARCHAR, 6, '0') AS gebruikersnaam, 'Ánna  de Vries-' || (b % 10) AS naam, k::INT AS plaats FROM r WHERE k <= 10""",
    "link_state": EDGES_SQL + """, l AS (SELECT event_id AS t, (user_id % 120)::VARCHAR AS van, CASE WHEN event_id % 9 <> 0 THEN ts END AS c FROM events WHERE event_id % 3 = 0), o AS (SELECT event_id, event_id % 10 = 0 AS kort, event_id - event_id % 3 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS t, (event_id % 120)::VARCHAR AS uid FROM events WHERE event_id % 3 <> 0)
SELECT event_id, CASE WHEN kort OR van IS NULL THEN 'ongeldig' WHEN van = uid THEN 'eigen' WHEN c IS NOT NULL AND TIMESTAMP '2024-01-09 12:00:00' >= c + INTERVAL 7 DAY THEN 'verlopen' WHEN (uid, van) IN (SELECT (a, b) FROM friends) THEN 'vrienden' WHEN (uid, van) IN (SELECT (a, b) FROM blocks) THEN 'jij-blokkeert' ELSE 'ok' END AS status FROM o LEFT JOIN l USING (t)""",
    "invitation_reason": PLANS_SQL + f"""SELECT inv.plan, uid, CASE WHEN eigenaar IS NULL THEN 'geen-plan' WHEN opgeheven THEN 'opgeheven' WHEN status IS DISTINCT FROM 'uitgenodigd' THEN 'geen-open-uitnodiging' WHEN datum < DATE '{DAY}' THEN 'voorbij'
 WHEN (eigenaar, uid) NOT IN (SELECT (a, b) FROM friends) OR (uid, eigenaar) NOT IN (SELECT (a, b) FROM friends) THEN 'geen-vrienden' WHEN (eigenaar, uid) IN (SELECT (a, b) FROM blocks UNION SELECT (b, a) FROM blocks) THEN 'blokkade' WHEN uid::INT % 4 = 0 THEN 'mail-uit' WHEN eigenaar::INT % 9 = 0 THEN 'geen-profiel' END AS reden FROM inv LEFT JOIN p ON p.plan = inv.plan""",
    "invitation_state": PLANS_SQL + f"SELECT inv.plan, uid, CASE WHEN status IS NULL THEN 'ingetrokken' WHEN opgeheven THEN 'opgeheven' WHEN status IN ('kan-niet', 'weg') THEN status WHEN datum < DATE '{DAY}' THEN 'verlopen' WHEN status = 'gaat' THEN 'gaat' ELSE 'open' END AS stand FROM inv LEFT JOIN p ON p.plan = inv.plan",
    "username_claims": """WITH c AS (SELECT user_id::VARCHAR AS uid, ['Anna', 'anna_', 'a.b', 'x', 'admin', 'Bo..b'][(event_id % 6 + 1)::INT] || CASE WHEN event_id % 6 < 3 THEN (event_id % 700)::VARCHAR ELSE '' END AS g, event_id AS seq FROM events WHERE event_id % 6 < 3),
f AS (SELECT lower(g) AS l, arg_min(uid, seq) AS uid, arg_min(g, seq) AS g, min(seq) AS seq FROM c GROUP BY 1) SELECT uid, arg_max(g, seq) AS gebruikersnaam FROM f GROUP BY 1""",
    "with_whom": PLANS_SQL + """SELECT plan, eigenaar AS ik, CASE WHEN status = 'gaat' AND gast <> eigenaar THEN ['@' || gast] ELSE [] END AS gaan, CASE WHEN status = 'uitgenodigd' AND gast <> eigenaar THEN ['@' || gast] ELSE [] END AS open,
 CASE WHEN status = 'kan-niet' AND gast <> eigenaar THEN ['@' || gast] ELSE [] END AS "kanNiet", CASE WHEN status = 'weg' AND gast <> eigenaar THEN ['@' || gast] ELSE [] END AS weg FROM p""",
    "shared_items": """WITH i AS (SELECT (o_custkey % 3)::VARCHAR AS "user", lpad(o_orderkey::VARCHAR, 8, '0') AS sleutel, o_orderpriority AS titel, repeat(o_orderstatus, 120) AS maker FROM orders WHERE o_orderkey % 4 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY sleutel) AS k FROM i) SELECT "user", sleutel, titel, maker, NULL::VARCHAR AS genre FROM r WHERE k <= 1000""",
    "account_removed": EDGES_SQL + "SELECT 'friends' AS tabel, count(*) AS n FROM friends WHERE a = '7' OR b = '7' UNION ALL SELECT 'blocks', count(*) FROM blocks WHERE a = '7' OR b = '7' UNION ALL SELECT 'requests', count(*) FROM requests WHERE van = '7' OR naar = '7'",
    "rule_violations": PLANS_SQL + f"""SELECT 'gebruikersnaam' AS regel, '_' || lpad(c_custkey::VARCHAR, 5, '0') AS rij FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 'profiel', '8' UNION ALL SELECT 'genodigden', plan::VARCHAR FROM p WHERE status IS NOT NULL AND gast = eigenaar
UNION ALL SELECT 'lid', plan || '/niemand' FROM p WHERE status IS NULL UNION ALL SELECT 'speeldag', plan::VARCHAR FROM p WHERE datum < DATE '{DAY}' UNION ALL SELECT 'tijd', plan::VARCHAR FROM p WHERE plan % 13 = 0 UNION ALL SELECT 'kopie', '3'""",
    "budget_action": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 2 THEN 'kapot-bericht' WHEN o_totalprice > 250000 THEN 'stoppen' ELSE 'onder-budget' END AS actie FROM orders",
}
