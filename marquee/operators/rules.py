"""Rules on writes of shared documents: each write is allowed or not, with the names of all rules that it breaks.

A write is a row: id, ik (who writes), nu (when), was and na (structs, the document before and after; null where there
is none).  What other documents say is looked up by joins, in their state before the batch of writes or after it.  A rule
that cannot be decided, because something is missing, is broken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed: fields of the documents, longest values, patterns, and names that nobody may take.
PROFILE_FIELDS = ("gebruikersnaam", "gebruikersnaamLaag", "naam", "aangemaaktOp", "gewijzigdOp", "v")
COPY_FIELDS = ("items", "stand", "nv", "v", "bijgewerktOp")
PLAN_FIELDS = ("eigenaar", "sleutel", "sleutelV", "voorstelling", "speeldag", "genodigden", "opgeheven", "aangemaaktOp", "gewijzigdOp")
LONGEST = {"titel": 200, "theaterId": 60, "theaterNaam": 120, "stad": 80}
LONGEST_KEY, MOST_GUESTS, MOST_ITEMS, LINK_DAYS = 400, 10, 1000, 7
LOW_NAME = "^(?=.{3,20}$)[a-z0-9]+(?:[._][a-z0-9]+)*$"
RESERVED = (
    "admin", "administrator", "anoniem", "beheer", "beheerder", "berichten", "bot", "contact", "help", "helpdesk", "iedereen", "info", "moderator", "null", "profiel", "root", "support", "system", "systeem", "team", "theater",
    "theaters", "undefined", "vrienden",
)
DAY, TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "^[0-9]{2}:[0-9]{2}$"
CREATE, UPDATE, DELETE = "maken", "wijzigen", "weghalen"


def kind() -> Column:
    """maken, wijzigen, weghalen, or null for a row without a document."""
    return F.when(F.col("was").isNull() & F.col("na").isNotNull(), CREATE).when(F.col("was").isNotNull() & F.col("na").isNotNull(), UPDATE).when(F.col("was").isNotNull(), DELETE)


def judged(rows: DataFrame, rules: list[tuple[str, tuple[str, ...], Column]]) -> DataFrame:
    """id, soort, toegestaan and gebroken (names of broken rules, in their order); rules: name, kinds of writes, what must hold."""
    rows = rows.withColumn("soort", kind())
    broken = F.array(*[F.when(F.col("soort").isin(*kinds) & ~F.coalesce(holds, F.lit(False)), name) for name, kinds, holds in rules])
    broken = F.when(F.col("soort").isNull(), F.array(F.lit("leeg"))).otherwise(F.filter(broken, lambda x: x.isNotNull()))
    return rows.select("id", "soort", broken.alias("gebroken")).select("id", "soort", (F.size("gebroken") == 0).alias("toegestaan"), "gebroken")


def _exactly(fields: tuple[str, ...]) -> Column:
    return F.array_sort(F.col("na.velden")) == F.array(*map(F.lit, sorted(fields)))


def _found(rows: DataFrame, other: DataFrame, on: dict[str, Column], name: str, *columns: str) -> DataFrame:
    """``rows`` with whether a row of ``other`` is there, and some of its columns as ``<name>_<column>``; ``on``: other's column to a column of rows."""
    own = other.dropDuplicates(list(on)).select(*[F.col(c).alias(f"_{c}") for c in on], *[F.col(c).alias(f"{name}_{c}") for c in columns], F.lit(True).alias(name))
    same = None
    for c, of in on.items():
        cond = of == F.col(f"_{c}")
        same = cond if same is None else same & cond
    return rows.join(own, same, "left").drop(*[f"_{c}" for c in on]).withColumn(name, F.coalesce(name, F.lit(False)))


def profile_writes(writes: DataFrame, names_after: DataFrame) -> DataFrame:
    """Writes of profiles (uid; was, na: gebruikersnaam, gebruikersnaamLaag, naam, aangemaaktOp, gewijzigdOp, v, velden).

    names_after (laag, uid, naam): who has which user name after the batch.
    """
    rows = _found(writes, names_after, {"laag": F.col("na.gebruikersnaamLaag")}, "nieuw", "uid", "naam")
    rows = _found(rows, names_after, {"laag": F.col("was.gebruikersnaamLaag")}, "oud")
    low, name = F.col("na.gebruikersnaamLaag"), F.trim(F.col("na.naam"))
    both, all_ = (CREATE, UPDATE), (CREATE, UPDATE, DELETE)
    return judged(rows, [
        ("eigenaar", all_, F.col("ik") == F.col("uid")),
        ("velden", both, _exactly(PROFILE_FIELDS)),
        ("laag", both, low.rlike(LOW_NAME) & ~low.isin(*RESERVED)),
        ("weergave", both, F.lower("na.gebruikersnaam") == low),
        ("naam", both, name.rlike("\\S\\s+\\S") & (F.length(name) <= 60)),
        ("versie", both, F.col("na.v") == 1),
        ("gewijzigd", both, F.col("na.gewijzigdOp") == F.col("nu")),
        ("naamrij", both, F.col("nieuw") & (F.col("nieuw_uid") == F.col("uid")) & (F.col("nieuw_naam") == F.col("na.naam"))),
        ("aangemaakt", both, F.col("na.aangemaaktOp") == F.coalesce("was.aangemaaktOp", "nu")),
        ("oude naam vrij", (UPDATE,), (F.col("was.gebruikersnaamLaag") == low) | ~F.col("oud")),
        ("naam vrij", (DELETE,), ~F.col("oud")),
    ])


def copy_writes(writes: DataFrame, settings_after: DataFrame) -> DataFrame:
    """Writes of shared copies (uid, onderdeel; was, na: items (how many), stand, nv, v, bijgewerktOp, velden).

    settings_after (uid, onderdeel, deelt): what is shared after the batch.
    """
    rows = _found(writes, settings_after.filter("deelt"), {"uid": F.col("uid"), "onderdeel": F.col("onderdeel")}, "deelt")
    both = (CREATE, UPDATE)
    return judged(rows, [
        ("eigenaar", (CREATE, UPDATE, DELETE), F.col("ik") == F.col("uid")),
        ("onderdeel", both, F.col("onderdeel").isin("gezien", "watchlist")),
        ("gedeeld", both, F.col("deelt")),
        ("velden", both, _exactly(COPY_FIELDS)),
        ("items", both, F.col("na.items") <= MOST_ITEMS),
        ("stand", both, F.col("na.stand") >= 0),
        ("versie", both, (F.col("na.nv") >= 1) & (F.col("na.v") == 1)),
        ("bijgewerkt", both, F.col("na.bijgewerktOp") == F.col("nu")),
        ("ouder", (UPDATE,), F.col("na.stand") >= F.col("was.stand")),
    ])


def plan_writes(writes: DataFrame, profiles: DataFrame, members_after: DataFrame) -> DataFrame:
    """Writes of plans (plan; was, na: eigenaar, sleutel, sleutelV, titel, theaterId, theaterNaam, stad, datum, tijd, speeldag, genodigden, opgeheven, aangemaaktOp, gewijzigdOp, velden, vast).

    vast is a digest of all fields but genodigden, opgeheven and gewijzigdOp.  profiles: uid; members_after: plan, uid, rol.
    """
    rows = _found(writes, profiles, {"uid": F.col("ik")}, "profiel")
    rows = _found(rows, members_after, {"plan": F.col("plan"), "uid": F.col("ik")}, "lid", "rol")
    na, guests = F.col("na"), F.col("na.genodigden")
    runs = lambda day: F.col("nu") < day + F.expr("INTERVAL 1 DAY")
    both, none = (CREATE, UPDATE), F.array().cast("array<string>")
    more = F.size(F.array_except(guests, F.coalesce("was.genodigden", none))) > 0
    short = F.length(na["titel"]) >= 1
    for field, most in LONGEST.items():
        short = short & (F.length(na[field]) <= most)
    return judged(rows, [
        ("weghalen", (DELETE,), F.lit(False)),
        ("eigenaar", both, (F.coalesce("was.eigenaar", "na.eigenaar") == F.col("ik"))),
        ("velden", (CREATE,), _exactly(PLAN_FIELDS)),
        ("sleutel", (CREATE,), (F.length(na["sleutel"]) <= LONGEST_KEY) & na["sleutelV"].isNotNull()),
        ("voorstelling", (CREATE,), short & (na["tijd"].isNull() | na["tijd"].rlike(TIME))),
        ("speeldag", (CREATE,), na["datum"].rlike(DAY) & (na["speeldag"] == F.try_to_timestamp(na["datum"], F.lit("yyyy-MM-dd"))) & runs(na["speeldag"])),
        ("genodigden", both, (F.size(guests) <= MOST_GUESTS) & ~F.array_contains(guests, F.col("ik"))),
        ("opgeheven", (CREATE,), ~na["opgeheven"]),
        ("aangemaakt", (CREATE,), na["aangemaaktOp"] == F.col("nu")),
        ("gewijzigd", both, na["gewijzigdOp"] == F.col("nu")),
        ("profiel", (CREATE,), F.col("profiel")),
        ("organisator", (CREATE,), F.col("lid") & (F.col("lid_rol") == "organisator")),
        ("vaste velden", (UPDATE,), na["vast"] == F.col("was.vast")),
        ("heropend", (UPDATE,), ~F.col("was.opgeheven") | na["opgeheven"]),
        ("te laat", (UPDATE,), ~more | (~F.col("was.opgeheven") & ~na["opgeheven"] & runs(F.col("was.speeldag")))),
    ])


def friend_writes(writes: DataFrame, profiles: DataFrame, blocks: DataFrame, friends_after: DataFrame, requests: DataFrame, requests_after: DataFrame, links: DataFrame, links_after: DataFrame) -> DataFrame:
    """Writes of friendships (eigenaar, vriend; was, na: uid, sinds, via, token, velden), which go both ways in one batch.

    A new one needs the consent of the other: a request to the writer, or a link of the other's that is not over, either
    of which is gone after the batch.  profiles: uid; blocks: a, b; friends_after: eigenaar, vriend; requests: van, naar;
    links: token, uid, aangemaaktOp.
    """
    other = F.when(F.col("ik") == F.col("eigenaar"), F.col("vriend")).when(F.col("ik") == F.col("vriend"), F.col("eigenaar"))
    rows = _found(writes.withColumn("_ander", other), profiles, {"uid": F.col("ik")}, "profiel")
    rows = _found(rows, friends_after, {"eigenaar": F.col("vriend"), "vriend": F.col("eigenaar")}, "terug")
    both_ways = blocks.select("a", "b").unionByName(blocks.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = _found(rows, both_ways, {"a": F.col("eigenaar"), "b": F.col("vriend")}, "blok")
    for name, asked in (("vroeg", requests), ("vraagt", requests_after)):
        rows = _found(rows, asked, {"van": F.col("_ander"), "naar": F.col("ik")}, name)
    rows = _found(rows, links, {"token": F.col("na.token")}, "link", "uid", "aangemaaktOp")
    rows = _found(rows, links_after, {"token": F.col("na.token")}, "blijft")
    fields = F.array_sort(F.col("na.velden"))
    asked = (F.col("na.via") == "verzoek") & F.col("na.token").isNull() & F.col("vroeg") & ~F.col("vraagt")
    linked = (F.col("na.via") == "link") & F.col("link") & (F.col("link_uid") == F.col("_ander")) & (F.col("nu") < F.col("link_aangemaaktOp") + F.expr(f"INTERVAL {LINK_DAYS} DAYS")) & ~F.col("blijft")
    new = (CREATE,)
    return judged(rows, [
        ("wijzigen", (UPDATE,), F.lit(False)),
        ("partij", (CREATE, DELETE), F.col("_ander").isNotNull()),
        ("zelf", new, F.col("eigenaar") != F.col("vriend")),
        ("velden", new, fields.isin(F.array(*map(F.lit, ("sinds", "token", "uid", "via"))), F.array(*map(F.lit, ("sinds", "uid", "via"))))),
        ("uid", new, F.col("na.uid") == F.col("vriend")),
        ("sinds", new, F.col("na.sinds") == F.col("nu")),
        ("profiel", new, F.col("profiel")),
        ("terug", new, F.col("terug")),
        ("blokkade", new, ~F.col("blok")),
        ("toestemming", new, F.coalesce(asked, F.lit(False)) | F.coalesce(linked, F.lit(False))),
        ("andere richting", (DELETE,), ~F.col("terug")),
    ])
