"""Friends, invitations, shared lists and plans: decisions over edge tables, and checks that list violating rows.

Tables: friends and blocks (a, b: one row a direction), requests (van, naar), links (token, uid, created), plans (plan,
eigenaar, datum, genodigden, opgeheven), members (plan, uid, rol, status, kaarten).  Each decision is a chain of left
joins and a first-match expression; each change gives the tables' new rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import valid_rating

MOST_HITS, MOST_GUESTS, MOST_ITEMS = 10, 10, 1000
LENGTHS = {"sleutel": 200, "titel": 200, "maker": 120, "genre": 40}
# Shapes of names, tokens and times.
USERNAME = "^[A-Za-z0-9]+(?:[._][A-Za-z0-9]+)*$"
TOKEN = "^[A-Za-z0-9_-]{20,}$"
TIME = "^([01][0-9]|2[0-3]):[0-5][0-9]$"


def _flag(rows: DataFrame, edges: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """Adds whether ``edges`` has a row with the given columns equal to those of ``rows``; null never equals."""
    keys = edges.select(*[F.col(e).alias(f"_{r}") for r, e in on.items()]).distinct().withColumn(name, F.lit(True))
    cond = None
    for r in on:
        c = F.col(r) == F.col(f"_{r}")
        cond = c if cond is None else cond & c
    return rows.join(keys, cond, "left").drop(*[f"_{r}" for r in on]).withColumn(name, F.coalesce(name, F.lit(False)))


def name_key(name: Column) -> Column:
    """Hash by which a full name (two words or more) is found; null for others."""
    normal = X.normal_title(F.coalesce(name, F.lit("")))
    return F.when(F.contains(normal, F.lit(" ")), F.sha2(normal, 256))


def search_names(searches: DataFrame, profiles: DataFrame, blocks: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """zoek, gebruikersnaam, naam, plaats: up to ``most`` findable people of exactly the searched name for each search.

    searches: zoek, uid, naam; profiles: uid, gebruikersnaam, naam, vindbaar.  Not oneself, and nobody with a block
    in either direction.  A searcher passes over no more people than there are blocks with them, and themselves: so of
    each name only so many of its first people meet the searches, however common the name.
    """
    both = _both(blocks).distinct()
    over = both.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    asked = searches.select("zoek", F.col("uid").alias("a"), name_key(F.col("naam")).alias("k")).filter("k is not null")
    there = profiles.filter("vindbaar").select(F.col("uid").alias("b"), "gebruikersnaam", "naam", name_key(F.col("naam")).alias("k")).filter("k is not null")
    there = there.withColumn("_n", F.row_number().over(W.partitionBy("k").orderBy("gebruikersnaam", "b"))).filter(F.col("_n") <= most + 1 + over).drop("_n")
    rows = asked.join(there, "k").filter("a <> b").join(both, ["a", "b"], "left_anti")
    place = F.row_number().over(W.partitionBy("zoek").orderBy("gebruikersnaam", "b"))
    return rows.withColumn("plaats", place).filter(F.col("plaats") <= most).select("zoek", "gebruikersnaam", "naam", "plaats")


def request_outcome(asks: DataFrame, friends: DataFrame, blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """asks (van, naar) with uitkomst: zelf, al-vrienden, jij-blokkeert, niet-mogelijk (blocked by the other), vrienden, al-verstuurd or verstuurd.

    A request in the other direction makes friends at once.
    """
    rows = _flag(asks, friends, {"van": "a", "naar": "b"}, "_vriend")
    rows = _flag(rows, blocks, {"van": "a", "naar": "b"}, "_blok")
    rows = _flag(rows, blocks, {"van": "b", "naar": "a"}, "_geblokt")
    rows = _flag(rows, requests, {"van": "naar", "naar": "van"}, "_terug")
    rows = _flag(rows, requests, {"van": "van", "naar": "naar"}, "_heen")
    outcome = (
        F.when(F.col("van") == F.col("naar"), "zelf")
        .when(F.col("_vriend"), "al-vrienden")
        .when(F.col("_blok"), "jij-blokkeert")
        .when(F.col("_terug"), "vrienden")
        .when(F.col("_heen"), "al-verstuurd")
        .when(F.col("_geblokt"), "niet-mogelijk")
        .otherwise("verstuurd")
    )
    return rows.select(*asks.columns, outcome.alias("uitkomst"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def accept(friends: DataFrame, requests: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(friends, requests) after requests (van, naar) were accepted: both directions are friends, both requests go."""
    pairs = accepted.select(F.col("van").alias("a"), F.col("naar").alias("b"))
    gone = _both(pairs).select(F.col("a").alias("van"), F.col("b").alias("naar")).distinct()
    return friends.select("a", "b").unionByName(_both(pairs)).distinct(), requests.join(gone, ["van", "naar"], "left_anti")


def block(friends: DataFrame, requests: DataFrame, blocks: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(friends, requests, blocks) after ``new`` blocks (a, b): friendships and requests of both directions go."""
    both = _both(new).distinct()
    return friends.join(both, ["a", "b"], "left_anti"), requests.join(both.select(F.col("a").alias("van"), F.col("b").alias("naar")), ["van", "naar"], "left_anti"), blocks.select("a", "b").unionByName(new.select("a", "b")).distinct()


def unfriend(friends: DataFrame, ended: DataFrame) -> DataFrame:
    return friends.join(_both(ended).distinct(), ["a", "b"], "left_anti")


def link_state(opened: DataFrame, links: DataFrame, friends: DataFrame, blocks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """opened (token, uid) with status: ongeldig, eigen, verlopen, vrienden, jij-blokkeert or ok."""
    rows = opened.join(links.select("token", F.col("uid").alias("_van"), "created"), "token", "left")
    rows = _flag(rows, friends, {"uid": "a", "_van": "b"}, "_vriend")
    rows = _flag(rows, blocks, {"uid": "a", "_van": "b"}, "_blok")
    over = F.coalesce(now >= F.col("created") + F.make_dt_interval(F.lit(days)), F.lit(False))
    status = (
        F.when(~F.coalesce("token", F.lit("")).rlike(TOKEN) | F.col("_van").isNull(), "ongeldig")
        .when(F.col("_van") == F.col("uid"), "eigen")
        .when(over, "verlopen")
        .when(F.col("_vriend"), "vrienden")
        .when(F.col("_blok"), "jij-blokkeert")
        .otherwise("ok")
    )
    return rows.select(*opened.columns, status.alias("status"))


def consumed_links(uses: DataFrame) -> DataFrame:
    """The first use (token, uid, seq) of each link: a link is used once."""
    return uses.groupBy("token").agg(F.min_by("uid", "seq").alias("uid"), F.min("seq").alias("seq"))


def invitation_reason(invitations: DataFrame, plans: DataFrame, members: DataFrame, friends: DataFrame, blocks: DataFrame, preferences: DataFrame, profiles: DataFrame, today: date) -> DataFrame:
    """invitations (plan, uid) with reden: why no message may be sent, null if one may (before quotas).

    In order: geen-plan, opgeheven, geen-open-uitnodiging, voorbij, geen-vrienden (both directions), blokkade (either
    direction), mail-uit, geen-profiel.
    """
    rows = invitations.join(plans.select("plan", "eigenaar", "datum", "opgeheven"), "plan", "left")
    rows = _flag(rows, members.filter("rol = 'gast' and status = 'uitgenodigd'"), {"plan": "plan", "uid": "uid"}, "_open")
    rows = _flag(rows, friends, {"eigenaar": "a", "uid": "b"}, "_heen")
    rows = _flag(rows, friends, {"eigenaar": "b", "uid": "a"}, "_terug")
    rows = _flag(rows, _both(blocks), {"eigenaar": "a", "uid": "b"}, "_blok")
    rows = _flag(rows, preferences.filter("not uitnodigingen"), {"uid": "uid"}, "_uit")
    rows = _flag(rows, profiles, {"eigenaar": "uid"}, "_profiel")
    reason = (
        F.when(F.col("eigenaar").isNull(), "geen-plan")
        .when(F.coalesce("opgeheven", F.lit(False)), "opgeheven")
        .when(~F.col("_open"), "geen-open-uitnodiging")
        .when(F.col("datum").isNull() | (F.col("datum") < F.lit(today)), "voorbij")
        .when(~F.col("_heen") | ~F.col("_terug"), "geen-vrienden")
        .when(F.col("_blok"), "blokkade")
        .when(F.col("_uit"), "mail-uit")
        .when(~F.col("_profiel"), "geen-profiel")
    )
    return rows.select(*invitations.columns, reason.alias("reden"))


def invitation_state(invitations: DataFrame, plans: DataFrame, members: DataFrame, today: date) -> DataFrame:
    """invitations (plan, uid) with stand for the receiver: ingetrokken, opgeheven, verlopen, gaat, kan-niet, weg or open."""
    rows = invitations.join(plans.select("plan", "datum", "opgeheven"), "plan", "left").join(members.select("plan", "uid", "status"), ["plan", "uid"], "left")
    past = F.coalesce(F.col("datum") < F.lit(today), F.lit(False))
    state = (
        F.when(F.col("status").isNull() | F.col("opgeheven").isNull(), "ingetrokken")
        .when(F.col("opgeheven"), "opgeheven")
        .when(F.col("status").isin("kan-niet", "weg"), F.col("status"))
        .when(past, "verlopen")
        .when(F.col("status") == "gaat", "gaat")
        .otherwise("open")
    )
    return rows.select(*invitations.columns, state.alias("stand"))


def plan_states(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, messages) from a log of a plan's events: seq, plan, actie, door, wie.

    actie: uitnodigen (by the owner: up to ten guests, nobody twice), intrekken, gaat, kan-niet, weg (by a guest who is
    invited then), opheffen (nothing counts after it; who is invited or goes gets a message).  The last thing said of a
    guest counts; a withdrawn one may be invited again.
    """
    ended = events.filter("actie = 'opheffen'").groupBy("plan").agg(F.min("seq").alias("_eind"), F.min_by("door", "seq").alias("_door"))
    live = events.join(ended, "plan", "left").filter("_eind is null or seq < _eind")
    guest = F.when(F.col("actie").isin("uitnodigen", "intrekken"), F.col("wie")).otherwise(F.col("door"))
    told = live.filter("actie <> 'opheffen'").withColumn("gast", guest)
    # answers count only while invited: after the last invitation that was not withdrawn
    by = W.partitionBy("plan", "gast").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    last_call = F.last(F.when(F.col("actie").isin("uitnodigen", "intrekken"), F.col("actie")), ignorenulls=True).over(by)
    told = told.withColumn("_roep", last_call)
    told = told.filter((F.col("_roep") == "uitnodigen") | (F.col("actie") == "intrekken"))
    # an invitation of someone who is invited already says nothing
    previous = F.lag("_roep", 1, "").over(W.partitionBy("plan", "gast").orderBy("seq"))
    told = told.withColumn("_was", previous).filter("not (actie = 'uitnodigen' and _was = 'uitnodigen')")
    # guests at the time of an invitation
    change = F.when(F.col("actie") == "uitnodigen", 1).when((F.col("actie") == "intrekken") & (F.col("_was") == "uitnodigen"), -1).otherwise(0)
    told = told.withColumn("_n", F.sum(change).over(W.partitionBy("plan").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)))
    fits = told.groupBy("plan", "gast").agg(F.max(F.when(F.col("actie") == "uitnodigen", F.col("_n"))).alias("_hoogst"))
    kept = told.join(fits.filter(F.col("_hoogst") <= MOST_GUESTS), ["plan", "gast"])
    final = kept.groupBy("plan", "gast").agg(F.max_by("actie", "seq").alias("actie"), F.max("seq").alias("seq")).filter("actie <> 'intrekken'")
    members = final.select("plan", F.col("gast").alias("uid"), F.when(F.col("actie") == "uitnodigen", "uitgenodigd").otherwise(F.col("actie")).alias("status"))
    answers = kept.filter(F.col("actie").isin("gaat", "kan-niet", "weg")).select("plan", F.lit(None).cast("string").alias("naar"), F.col("gast").alias("van"), F.when(F.col("actie") == "gaat", "gaat-mee").otherwise(F.col("actie")).alias("soort"))
    ends = members.filter(F.col("status").isin("gaat", "uitgenodigd")).join(ended, "plan").select("plan", F.col("uid").alias("naar"), F.col("_door").alias("van"), F.lit("opgeheven").alias("soort"))
    return members, answers.unionByName(ends)


def with_whom(plans: DataFrame, members: DataFrame, viewers: DataFrame) -> DataFrame:
    """viewers (plan, ik) with gaan, open, kanNiet, weg: sorted names of others; the last three for the owner only."""
    others = viewers.join(members, "plan").filter("uid <> ik")
    named = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.concat(F.lit("@"), "uid"))))
    sums = others.groupBy("plan", "ik").agg(named("gaat").alias("gaan"), named("uitgenodigd").alias("open"), named("kan-niet").alias("kanNiet"), named("weg").alias("weg"))
    rows = viewers.join(sums, ["plan", "ik"], "left").join(plans.select("plan", "eigenaar"), "plan", "left")
    none = F.array().cast("array<string>")
    own = F.coalesce(F.col("eigenaar") == F.col("ik"), F.lit(False))
    return rows.select("plan", "ik", F.coalesce("gaan", none).alias("gaan"), *[F.when(own, F.coalesce(c, none)).otherwise(none).alias(c) for c in ("open", "kanNiet", "weg")])


def shared_items(items: DataFrame, part: str = "watchlist") -> DataFrame:
    """Items as they are shared: allowed columns, cut to length, unusable ones out, the first 1000 of a user by key.

    items: user, sleutel, titel, maker, genre, and for ``gezien`` beoordeling, laatsteBezoek, aantal.
    """
    cut = {c: F.nullif(F.substring(X.strip(F.coalesce(c, F.lit(""))), 1, n), F.lit("")).alias(c) for c, n in LENGTHS.items()}
    extra = []
    if part == "gezien":
        extra = [
            F.when(valid_rating(F.col("beoordeling")), F.col("beoordeling")).alias("beoordeling"),
            F.col("laatsteBezoek"),
            F.when(F.col("aantal") >= 1, F.least(F.col("aantal"), F.lit(999))).otherwise(1).alias("aantal"),
        ]
    rows = items.select("user", *cut.values(), *extra).filter("sleutel is not null and titel is not null")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("user").orderBy("sleutel", "titel"))).filter(F.col("_n") <= MOST_ITEMS).drop("_n")


def shared_view(viewers: DataFrame, settings: DataFrame, copies: DataFrame) -> DataFrame:
    """viewers (ik, vriend) with items of a friend's copy: null where they do not share, empty where there is none."""
    rows = viewers.join(settings.select(F.col("user").alias("vriend"), "delen"), "vriend", "left").join(copies.select(F.col("user").alias("vriend"), F.col("items").alias("_i")), "vriend", "left")
    empty = F.array().cast(copies.schema["items"].dataType)
    return rows.select("ik", "vriend", F.when(F.coalesce("delen", F.lit(False)), F.coalesce("_i", empty)).alias("items"))


def username_error(name: Column, reserved: tuple[str, ...] = ("admin", "beheer", "support")) -> Column:
    """First thing wrong with a username, null for a good one."""
    n = F.regexp_replace(X.strip(F.coalesce(name, F.lit(""))), "^@", "")
    return (
        F.when(n == "", "leeg")
        .when(F.length(n) < 3, "te kort")
        .when(F.length(n) > 20, "te lang")
        .when(n.rlike("\\s"), "spaties")
        .when(~n.rlike("^[A-Za-z0-9._]+$"), "tekens")
        .when(~n.rlike(USERNAME), "vorm")
        .when(F.lower(n).isin(*reserved), "gereserveerd")
    )


def claim_usernames(claims: DataFrame) -> DataFrame:
    """uid, gebruikersnaam of claims (uid, gebruikersnaam, seq): the first claim of a name holds, a user has their last one that holds."""
    good = claims.filter(username_error(F.col("gebruikersnaam")).isNull()).withColumn("_laag", F.lower("gebruikersnaam"))
    first = good.groupBy("_laag").agg(F.min_by(F.struct("uid", "gebruikersnaam", "seq"), "seq").alias("x")).select("x.*")
    return first.groupBy("uid").agg(F.max_by("gebruikersnaam", "seq").alias("gebruikersnaam"))


def remove_account(tables: dict[str, DataFrame], uid: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables without a user, counts of what went) for friends, blocks (a, b), requests (van, naar), links (uid), plans (eigenaar, genodigden), members (plan, uid)."""
    out, gone = {}, {}
    hit = {
        "friends": (F.col("a") == uid) | (F.col("b") == uid),
        "blocks": (F.col("a") == uid) | (F.col("b") == uid),
        "requests": (F.col("van") == uid) | (F.col("naar") == uid),
        "links": F.col("uid") == uid,
        "plans": F.col("eigenaar") == uid,
    }
    for name, cond in hit.items():
        if name in tables:
            gone[name] = tables[name].filter(cond).agg(F.count(F.lit(1)).alias("n"))
            out[name] = tables[name].filter(~F.coalesce(cond, F.lit(False)))
    if "plans" in out:
        out["plans"] = out["plans"].withColumn("genodigden", F.array_remove("genodigden", uid))
    if "members" in tables:
        left = tables["members"].filter(F.col("uid") != uid)
        own = tables["plans"].filter(hit["plans"]).select("plan") if "plans" in tables else None
        out["members"] = left.join(own, "plan", "left_anti") if own is not None else left
    return out, gone


def violations(profiles: DataFrame, usernames: DataFrame, plans: DataFrame, members: DataFrame, copies: DataFrame, today: date) -> DataFrame:
    """regel, rij: rows that break a rule of the documents.

    username shape; profile and username rows agree; at most ten guests and not oneself; a guest has a member row; plan
    day not past; time shape; at most 1000 shared items.
    """
    bad = lambda df, rule, key: df.select(F.lit(rule).alias("regel"), F.col(key).cast("string").alias("rij"))
    shape = bad(usernames.filter(username_error(F.col("gebruikersnaam")).isNotNull()), "gebruikersnaam", "gebruikersnaam")
    agree = profiles.join(usernames.select(F.col("uid").alias("_u"), F.col("gebruikersnaam").alias("_g")), F.col("uid") == F.col("_u"), "left")
    apart = bad(agree.filter(F.col("_g").isNull() | (F.lower("_g") != F.lower("gebruikersnaam"))), "profiel", "uid")
    many = bad(plans.filter((F.size("genodigden") > MOST_GUESTS) | F.array_contains("genodigden", F.col("eigenaar"))), "genodigden", "plan")
    guests = plans.select("plan", F.explode("genodigden").alias("uid")).join(members.select("plan", "uid"), ["plan", "uid"], "left_anti")
    unseated = bad(guests.withColumn("rij", F.concat_ws("/", "plan", "uid")), "lid", "rij")
    past = bad(plans.filter(F.col("datum") < F.lit(today)), "speeldag", "plan")
    odd = bad(plans.filter(F.col("tijd").isNotNull() & ~F.col("tijd").rlike(TIME)), "tijd", "plan")
    large = bad(copies.filter(F.size("items") > MOST_ITEMS), "kopie", "user")
    out = shape
    for more in (apart, many, unseated, past, odd, large):
        out = out.unionByName(more)
    return out


def status_messages(before: DataFrame, after: DataFrame) -> DataFrame:
    """plan, uid, soort: real changes of a guest's status between two states of members, each worth one message."""
    both = after.select("plan", "uid", F.col("status").alias("nu")).join(before.select("plan", "uid", F.col("status").alias("was")), ["plan", "uid"], "left")
    changed = both.filter(F.col("nu").isin("gaat", "kan-niet", "weg") & ~F.col("nu").eqNullSafe(F.col("was")))
    return changed.select("plan", "uid", F.when(F.col("nu") == "gaat", "gaat-mee").otherwise(F.col("nu")).alias("soort"))


def budget_action(message: Column) -> Column:
    """What a base64 budget message asks for: kapot-bericht, onder-budget or stoppen."""
    parsed = F.from_json(F.decode(F.try_to_binary(message, F.lit("base64")), "UTF-8"), "costAmount double, budgetAmount double")
    return F.when(parsed["costAmount"].isNull() | parsed["budgetAmount"].isNull(), "kapot-bericht").when(parsed["costAmount"] > parsed["budgetAmount"], "stoppen").otherwise("onder-budget")
