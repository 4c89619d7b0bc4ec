"""Queries on aliases, shared lists, watchlist lines, choices, messages and further page layouts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import values as V
from ..operators import agenda as A
from ..operators import curation as CU
from ..operators import linkage as L
from ..operators import lists as LI
from ..operators import reports as R
from ..operators import runs as RU
from ..operators import social as SO
from ..operators import state as S
from ..sources import api as P
from ..sources import crawl as C
from . import state as lists
from .agenda import _short
from .shows import SHOW_SQL, TODAY, sql_noise, sql_norm, table
from .shows import shows as read_shows

DAY = date.fromisoformat(TODAY)
NOW = lists.NOW


def _s(c) -> F.Column:
    return c.cast("string")


def _parts(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in columns.items()])


def _k() -> F.Column:
    return F.col("p_partkey")


def _name() -> F.Column:
    return F.col("p_name")


# aliases


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias for every third name: its second word as an evening of a maker, with a maker, a fixed one, or none."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().filter("length(p_name) % 3 = 0")
    n, second = F.length("p_name"), F.element_at(F.split("p_name", " "), -1)
    title = F.when(n % 2 == 0, F.concat(F.lit("Avond "), second)).when(n % 4 == 1, F.concat(F.lit("Avond Ada Lint "), second)).otherwise(F.concat(F.lit("Nacht "), second, F.lit(" – Bo Café")))
    return names.select(_name().alias("sleutel"), title.alias("titel"), F.when(n % 5 != 0, F.when(n % 2 == 0, "Trio Vers").otherwise("Bo Café")).alias("maker"), (n % 7 == 1).alias("makerVast"))


def alias_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir).withColumn("sleutel", F.element_at(F.filter(F.split("sleutel", " \\| "), lambda d: ~d.isin("ada lint", "de grote kast", "mia en co", "trio vers", "bo cafe", "theatre nul")), 1))
    return L.apply_aliases(rows, _aliases(spark, sf_dir)).select("seq", "titel", "maker", "titelBron", "titelVoorAlias")


def slogan_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists and shows that venues put the wrong way round, casts, and shows with a subtitle."""
    p = table(spark, sf_dir, "part")
    artist, show = F.concat(F.lit("Artiest "), F.char(F.lit(65) + _k() % 20)), F.concat(F.lit("Hoera "), "p_name", F.lit("!"))
    way = _k() % 5
    title = F.when(way.isin(0, 3), artist).when(way == 1, show).otherwise(_name())
    maker = F.when(way == 0, show).when(way == 1, artist).when(way == 2, "Jan, Piet en Klaas, Mia").when(way == 3, F.concat(show, F.lit(" – Vervolg"))).otherwise(F.concat(F.lit("Groep "), artist))
    rows = p.select(_k().alias("seq"), F.concat(F.lit("v"), _s(_k() % 13)).alias("theaterId"), title.alias("titel"), maker.alias("maker"))
    return L.slogan_choice(rows, *L.source_index(rows))


def described_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are only the artist, with the show's name in the description, among shows of the same artists."""
    p = table(spark, sf_dir, "part")
    artist, way = F.concat(F.lit("Artiest "), F.reverse("p_name")), F.when(_k() % 40 == 0, 0).when(_k() % 12 == 3, 3).when(_k() % 4 == 2, 2).otherwise(1)
    title = F.when(way.isin(0, 3), artist).when(way == 2, F.concat("p_name", F.lit(" – "), artist)).otherwise(_name())
    rows = p.select(_k().alias("seq"), F.concat(F.lit("v"), _s(_k() % 13)).alias("theaterId"), title.alias("titel"), F.when(way == 1, artist).when(way == 3, "Groep Noord").alias("maker"), F.when(way.isin(0, 3), F.concat("p_name", F.lit(" | deel "), _s(_k()))).alias("beschrijving"), (_k() % 8 == 2).alias("volgordeZeker"))
    return L.title_from_description(rows.withColumn("sleutel", F.lit("x"))).drop("sleutel")


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that point to other names, so that some targets are sources, too."""
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    n = F.length("p_name")
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(_name().alias("sleutel"), F.when(n % 3 == 0, F.concat(a, F.lit(" rod"))).when(n % 3 == 1, F.concat(F.lit("hot "), b)).otherwise(_name()).alias("titel"), F.when(n % 2 == 0, "keuze").otherwise("R2").alias("regel"))


def alias_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _list(spark, sf_dir)
    return L.alias_errors(a, a.filter("length(sleutel) % 4 = 1").select("sleutel"))


def loose_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(_s(_k()).alias("seq"), F.concat(F.lit("v"), _s(_k() % 13)).alias("theaterId"), _name().alias("titel"), _name().alias("sleutel"))
    return L.loose_sources(rows, _list(spark, sf_dir))


def variants_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the parts of a variant stand in a proposal, and does the proposal add its maker only?"""
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    variant = F.when(_k() % 4 == 0, F.concat(a, F.lit(" – "), b)).when(_k() % 4 == 1, a).when(_k() % 4 == 2, F.lit("Ada Lint")).otherwise(F.concat(a, F.lit(" | Bo")))
    proposal = F.when(_k() % 3 == 0, F.concat(a, F.lit(" – Ada Lint"))).when(_k() % 3 == 1, F.concat(b, F.lit(" – "), a)).otherwise(a)
    return _parts(spark, sf_dir, past=CU.variant_fits(variant, proposal, F.lit("Ada Lint")))


# users' lists


def rekeyed_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and tombstones moved to new keys, then merged again."""
    a = lists._actions(spark, sf_dir)
    moved = S.rekey(a, spark.createDataFrame([("k1", "k0"), ("k3", "n3")], "oud string, nieuw string"))
    return S.merge_watchlist(moved.filter("event_type in ('signup', 'view')"), moved.filter("event_type = 'error'"))[0]


def filled_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = spark.createDataFrame([("k0", "Ada Lint", None), ("k1", None, "Dans"), ("k2", "Bo Café", "Musical")], "sleutel string, maker string, genre string")
    return S.fill_info(lists.lww_watchlist(spark, sf_dir), info)


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir).filter("length(sleutel) % 2 = 0")
    return rows.groupBy("sleutel").agg(F.min("titel").alias("titel"), F.max("maker").alias("maker"), F.min("genre").alias("genre"))


def shared_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of each venue as the list of a user, shared with what the agenda says of every second key."""
    items = read_shows(spark, sf_dir).groupBy(F.col("theaterId").alias("user"), "sleutel").agg(F.max("titel").alias("titel"))
    return LI.shared_watchlist(items, _live(spark, sf_dir))


def shared_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The performances of each venue and key as visits, shared in the order of the last one."""
    rows = read_shows(spark, sf_dir)
    visit = F.when(~F.col("seq").endswith("7"), F.struct("datum", F.coalesce("tijd", F.lit("")).alias("tijd"), "seq", "maker", "genre"))
    items = rows.groupBy(F.col("theaterId").alias("user"), "sleutel").agg(F.max("titel").alias("titel"), F.collect_list(visit).alias("bezoeken"), F.lit("Zelf").alias("maker"), F.lit("Overig").alias("genre"), (F.count(F.lit(1)) % 11 / 2.0).alias("beoordeling"), F.min(F.length("seq")).cast("bigint").alias("op"))
    shared = LI.shared_seen(items, _live(spark, sf_dir)).join(items.select("user", "sleutel", "op"), ["user", "sleutel"])
    return LI.in_seen_order(shared).drop("op")


def seen_by_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    items = c.select((k % 7).alias("user"), F.concat(F.lit("k"), _s(k)).alias("sleutel"), F.when(k % 3 != 0, (k % 10 + 1) / 2.0).alias("beoordeling"), F.when(k % 4 != 0, F.date_add(F.lit("1998-01-01"), (k % 50).cast("int"))).alias("laatsteBezoek"), (k * 86_400_000 * 365).alias("op"))
    return LI.in_seen_order(items, by_rating=True).select("user", "sleutel", "plaats")


def upcoming_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    plans = e.select(F.col("user_id").alias("user"), F.col("event_id").alias("plan"), F.date_add(F.lit(DAY), (F.col("event_id") % 40).cast("int") - 20).alias("datum"), F.when(F.col("event_id") % 3 != 0, "20:00").alias("tijd"))
    return LI.upcoming_plans(plans, DAY)


def gone_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir)
    links = rows.select(F.concat(F.lit("p"), "seq").alias("plan"), F.when(~F.col("seq").endswith("3"), F.col("seq")).alias("seq"))
    return LI.gone_plans(links, rows)


def watchlist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer watches the productions of their orders and one that is gone; some items were made from one older item."""
    rows = read_shows(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("user"))
    keys = rows.select(F.substring("seq", 1, 10).cast("bigint").alias("n"), "sleutel", "titel").join(orders, "n").groupBy("user", "sleutel").agg(F.min("titel").alias("titel"))
    old = F.length("sleutel") % 3 == 0
    watched = keys.select("user", "sleutel", "titel", F.when(old, F.col("user") * 1000 + F.length("sleutel")).otherwise(0).alias("op"), F.when(old, "v1").alias("theaterId"))
    gone = customers.select("user", F.lit("weg is weg").alias("sleutel"), F.lit("Weg is weg").alias("titel"), F.lit(0).cast("bigint").alias("op"), F.lit(None).cast("string").alias("theaterId"))
    items = watched.unionByName(gone).withColumn("maker", F.lit("Ada Lint"))
    return A.watchlist_lines(items, S.group_watchlist(items), rows, DAY)


def plan_guests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SO.plan_states(_plan_log(spark, sf_dir))[0]


def plan_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SO.plan_states(_plan_log(spark, sf_dir))[1]


def _plan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as what is said about plans: one plan a user, fifteen guests."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    act = F.when(k % 97 == 0, "opheffen").otherwise(F.element_at(F.array(*map(F.lit, ("uitnodigen", "gaat", "uitnodigen", "kan-niet", "intrekken", "uitnodigen", "weg"))), (k % 7 + 1).cast("int")))
    guest = F.concat(F.lit("g"), _s(F.floor(k / 7) % 15))
    owner = act.isin("uitnodigen", "intrekken", "opheffen")
    return e.select(k.alias("seq"), F.col("user_id").alias("plan"), act.alias("actie"), F.when(owner, "eigenaar").otherwise(guest).alias("door"), F.when(act.isin("uitnodigen", "intrekken"), guest).alias("wie"))


def shared_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    viewers = c.select(k.alias("ik"), F.floor(k * 2 / 3).alias("vriend"))
    settings = c.select(k.alias("user"), F.when(F.col("c_nationkey") > 4, k % 3 != 0).alias("delen")).filter("delen IS NOT NULL")
    o = table(spark, sf_dir, "orders")
    copies = o.groupBy(F.col("o_custkey").alias("user")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("items"))
    return SO.shared_view(viewers, settings, copies)


def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, ("uitgenodigd", "gaat", "kan-niet", "weg")))
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    members = lambda n: o.select(F.floor(k / 8).alias("plan"), k.alias("uid"), F.element_at(states, (F.floor(k / n) % 4 + 1).cast("int")).alias("status"))
    return SO.status_messages(members(3).filter("uid % 10 <> 0"), members(5))


# choices and orders


def agenda_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.places(read_shows(spark, sf_dir).filter("datum >= date'1998-02-10'")).select("seq", "plaats")


def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    some = lambda n: F.when(k % n == 0, F.array(F.lit("x"))).when(k % n == 1, F.array().cast("array<string>"))
    choices = c.select(k, some(2).alias("steden"), some(3).alias("theaters"), some(5).alias("genres"), (k % 4 == 0).alias("podiumpas"), F.when(k % 6 != 0, k % 7 == 0).alias("watchlist"), (k % 9 == 0).alias("volVerbergen"), (k % 10 == 0).alias("gezienVerbergen"), (k % 11 == 0).alias("wanneer"))
    return choices.select("c_custkey", A.active_filters(choices).alias("n"))


def when_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many performances three edited choices leave, by date: reversed dates with odd weekdays, a quick range with a weekday, a date that beats a quick range."""
    chosen = {
        "a": D.When.clean("onzin", "1998-03-05", "1998-02-20", [1, 9, True, 6, 6]),
        "b": D.When.clean("week", None, "geen datum", [5]).toggle_quick("maand").toggle_weekday(5).toggle_weekday(2),
        "c": D.When.clean("weekend", "1998-02-14"),
        "d": D.When.clean("morgen").with_date(last=date(1998, 1, 20)).toggle_quick("week").toggle_quick("week"),
    }
    rows = read_shows(spark, sf_dir)
    hit = F.array(*[F.when(w.matches(F.col("datum"), F.lit(DAY)), n) for n, w in chosen.items()])
    return rows.select("datum", F.explode(hit).alias("keuze")).filter("keuze is not null").groupBy("keuze", "datum").agg(F.count(F.lit(1)).alias("n"))


def rating_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.when(_k() % 31 != 0, (_k() % 29) / 4.0)
    return _parts(spark, sf_dir, geldig=V.valid_rating(r), tekst=V.rating_text(r))


def count_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, tekst=V.count_text(F.when(_k() % 5 != 4, _k() % 4)))


NAMES = ("Rêd", "ring", "BLUE", "hot")


def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, naam=V.first_name_in(list(NAMES), F.col("p_type"), F.when(_k() % 3 != 0, F.initcap("p_name"))))


def text_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(_k() % 9 != 0, F.concat(F.lit("Zaal:\n\t "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit(" ")))
    return _parts(spark, sf_dir, stand=V.text_drift(body, "Zaal:  red ring", "Zaal: red"))


def network_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("net::ERR_FAILED at x", "read ECONNRESET", "TypeError: fetch failed", "selector niet gevonden", "socket HANG up", "getaddrinfo ENOTFOUND", "timeout 30000ms", "")
    e = table(spark, sf_dir, "events")
    text = F.concat(F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 8 + 1).cast("int")), F.lit(" "), "event_type")
    return e.select("event_id", C.is_network_error(F.when(F.col("event_id") % 17 != 0, text)).alias("netwerk"))


def refreshed_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", RU.already_refreshed(F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp")), F.timestamp_millis(F.lit(NOW))).alias("vandaag"))


def details_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    cache = p.select("page_id", "url", (F.lit(NOW) - F.col("page_id") % 40 * RU.DAY).alias("fetched"))
    return RU.retained_details(cache, p.filter("page_id % 5 = 0").select("url"), NOW).select("page_id")


GENRE_LABELS = (("Red", "Dans"), ("ring", "Musical"), ("hot & bolt", "Cabaret"), ("saddle", "Toneel"), ("Blue", "Dans"))


def first_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a name that is a known label, as its category."""
    labels = spark.createDataFrame(list(GENRE_LABELS), "label string, category string")
    rows = _parts(spark, sf_dir, tags=F.when(_k() % 6 == 0, F.array(F.lit("bolt en HOT"), F.lit("ring"))).otherwise(F.split("p_name", " ")))
    return V.first_genre(rows, "tags", "p_partkey", labels)


# documents and pages


def invitation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir).select("seq", F.lower(F.substring("stad", 1, 5)).alias("gebruikersnaam"), F.when(F.col("seq").endswith("2"), F.lit("Ada  <Lint>")).alias("naam"), F.concat("titel", F.lit(' & "x"')).alias("titel"), "theaterNaam", F.when(~F.col("seq").endswith("5"), F.col("stad")).alias("stad"), "datum", "tijd")
    return R.invitation(rows, "https://app.example/").select("seq", "onderwerp", "tekst", "html")


def marked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# "), "p_name", F.lit("\n<!-- AUTO:telling:start -->\noud\n<!-- AUTO:telling:end -->\nslot <!-- AUTO:lijst:start --><!-- AUTO:lijst:end -->"))
    return _parts(spark, sf_dir, tekst=R.replace_blocks(text, {"telling": F.concat(F.lit("  "), _s(_k()), F.lit(" titels\n")), "lijst": F.col("p_brand")}))


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers of a search interface, a hundred a page, every tenth page twice."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    hit = F.struct(_s(k).alias("objectID"), F.col("o_orderpriority").alias("title"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("eventDateTimeStart"), F.array("o_orderstatus").alias("eventGenre"), F.concat(F.lit("Zaal "), _s(k % 5)).alias("eventLocations"), F.when(k % 3 == 0, "Foyer").alias("eventLocationAddition"), F.when(k % 4 != 0, (k % 7 == 0).cast("int")).alias("is_cancelled"))
    pages = o.groupBy(F.floor(k / 100).alias("p")).agg(F.to_json(F.struct(F.collect_list(hit).alias("hits"))).alias("json"))
    return P.search_hits(pages.unionByName(pages.filter("p % 10 = 0"))).drop("genres")


def production_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as productions, their lines as events of two kinds."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    event = F.struct(_s(F.col("l_shipdate")).alias("start"), F.when(F.col("l_linenumber") % 3 == 0, "inleiding").when(F.col("l_linenumber") % 3 == 1, "Voorstelling").otherwise("VOORSTELLING").alias("soort"), F.col("l_returnflag").alias("salesStatus"), F.when(k % 2 == 0, F.concat(F.lit("/t/"), _s(k), F.lit("/"), _s(F.col("l_linenumber")))).alias("salesUrl"))
    made = li.groupBy(k.alias("k")).agg(F.struct(_s(F.first(k)).alias("id"), F.concat(F.lit("Titel "), _s(F.first(k) % 50)).alias("title"), F.collect_list(event).alias("events")).alias("x"))
    pages = made.groupBy(F.floor(F.col("k") / 64).alias("p")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(_s(F.col("k")).alias("key"), F.col("x").alias("value")))).alias("productions"))).alias("json"))
    return P.production_events(pages)


def search_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit('<script>var a={"applicationId":"'), F.when(_k() % 5 != 0, F.concat(F.lit("AP"), _s(_k()))).otherwise("kleine"), F.lit('","searchApiKey":"'), F.lower(F.hex(_k())), F.lit('a0","eventIndexName":"'), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-"), F.lit('"}</script>'))
    found = P.search_config(F.when(_k() % 7 != 0, html))
    return _parts(spark, sf_dir, app=found["app"], sleutel=found["sleutel"], index=found["index"])


def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two articles: one with a link for more, one that is clicked as a whole."""
    html = F.concat(
        F.lit('<main><article class="program-block wide" data-showid="'), _s(_k()), F.lit('"><meta itemprop="startDate" content="1998-03-01T20:'), F.lpad(_s(_k() % 60), 2, "0"), F.lit('"><h2 class="program-block__title"> <b>'), "p_name", F.lit('</b>\n</h2><p class="x program-block__subtitle">'), "p_brand",
        F.lit('</p><span class="program-block__price">€ '), _s(F.col("p_size")), F.lit('</span><a data-hook="order-link-placeholder" data-status="reserveren" data-webstatus="'), F.when(_k() % 2 == 0, "laatste").otherwise(""), F.lit('"></a><a class="icon-info" href="/show/'), _s(_k()), F.lit('">info</a></article>'),
        F.lit('<article class="other">x</article><article data-showid="9" class="program-block" onclick="window.location=\'/klik/'), _s(_k()), F.lit('\'"><h2 class="program-block__title"></h2></article></main>'),
    )
    return P.articles(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey")


def plugin_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("TICKETS", "Uitverkocht", "Wachtlijst", "Afgelast", "Verplaatst naar mei", "info")))
    html = F.concat(
        F.lit('<div class="wp_theatre_events"><div class="wp_theatre_event genre-x"><div class="wp_theatre_event_title"><a href="/v/'), _s(_k()), F.lit('">'), "p_name", F.lit('</a></div><div class="wp_theatre_event_subtitle">'), "p_brand", F.lit('</div><ul><li class="wpt_production_category a"> Dans </li><li class="wpt_production_category b">'), "p_type",
        F.lit('</li></ul><div class="startdate_date">zo 1 mrt</div><div class="startdate_time">20:15</div><div class="wp_theatre_event_tickets"><a class="wp_theatre_event_tickets_url" href="/t/'), _s(_k()), F.lit('">'), F.element_at(kinds, (_k() % 6 + 1).cast("int")), F.lit('</a></div><div class="wp_theatre_event_prices">vanaf € '), _s(F.col("p_size")), F.when(_k() % 2 == 0, ",50").otherwise(""),
        F.lit('</div></div><div class="wp_theatre_event"><div class="wp_theatre_event_title">Los</div><div class="wp_theatre_event_starttime">19.30</div><div class="wp_theatre_event_tickets"> Bestel hier </div></div></div>'),
    )
    return P.plugin_events(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")), "p_partkey")


def _detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as the dates of a production's page: some at midnight, over, or there twice."""
    li = table(spark, sf_dir, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    hour = F.when(F.col("l_linenumber") % 3 == 0, "00:00").otherwise(F.concat(F.lit("2"), _s(F.col("l_linenumber") % 4), F.lit(":15")))
    knop = F.when(F.col("l_returnflag") == "R", "Geweest").when(F.col("l_returnflag") == "A", F.lit("Bestel <b>nu</b>")).otherwise("Wachtlijst")
    one = F.concat(F.lit('<li class="subshow in"><span data-event-start="'), day, F.lit(" "), hour, F.lit(':00">x</span><div class="buttonBox"><a class="btn">'), knop, F.lit("</a></div></li>"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("h")))).alias("a"))
    texts = F.transform("a", lambda x: x["h"])
    return rows.select("l_orderkey", F.concat(F.lit("<ul>"), F.array_join(F.concat(texts, F.slice(texts, F.lit(1), F.lit(1))), "\n"), F.lit('<li class="subshow">zonder</li></ul>')).alias("html"))


def detail_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.detail_dates(_detail_pages(spark, sf_dir), "l_orderkey")


def unknown_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.element_at(F.array(F.lit("Bestel"), F.lit("Meer info"), F.lit(None), F.lit("Inloop"), F.lit("Uitverkocht")), (F.substring("seq", 10, 1).cast("int") % 5) + 1)
    rows = read_shows(spark, sf_dir).select(texts.alias("knop"), C.button_status(texts).alias("beschikbaarheid"))
    return P.unknown_buttons(rows)


def row_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.date_add(F.lit("1998-01-01"), (_k() % 365).cast("int"))
    short = F.element_at(D.names(D.SHORT_MONTHS), F.month(d))
    start = F.when(_k() % 5 == 0, F.concat(_s(d), F.lit(" 20:15:00"))).when(_k() % 5 == 1, F.concat(_s(d), F.lit(" 00:00:00")))
    text = F.when(_k() % 5 == 2, F.concat(F.lit("Zo "), _s(F.dayofmonth(d)), F.lit(" "), short, F.lit(". 1998"))).when(_k() % 5 == 3, F.concat(_s(F.dayofmonth(d)), F.lit(" "), F.upper(short), F.lit(" ’26"))).when(_k() % 2 == 0, F.concat(_s(F.dayofmonth(d)), F.lit(" "), short))
    day, time = P.row_date(start, text, F.when(_k() % 3 == 0, "om 9.30 uur"), d)
    return _parts(spark, sf_dir, datum=day, tijd=time)


QUERIES = {
    f.__name__: f
    for f in (
        alias_titles, slogan_choices, described_titles, alias_errors, loose_aliases, variants_fit, rekeyed_watchlist, filled_watchlist, shared_watchlist, shared_seen, seen_by_rating, upcoming_plans, gone_plans, watchlist_lines, plan_guests, plan_messages, shared_view,
        status_messages, agenda_order, filter_counts, when_choices, rating_texts, count_texts, names_in_texts, text_drift, network_errors, refreshed_today, details_kept, first_tags, invitation_texts, marked_blocks, search_hits,
        production_events, search_configs, article_rows, plugin_events, detail_dates, unknown_buttons, row_dates,
    )
}

_MAKERS = "['ada lint', 'de grote kast', 'mia en co', 'trio vers', 'bo cafe', 'theatre nul']"
_ALIASES = """a AS (SELECT DISTINCT p_name AS sleutel, length(p_name) AS n, string_split(p_name, ' ')[-1] AS w FROM part WHERE length(p_name) % 3 = 0),
alias AS (SELECT sleutel, CASE WHEN n % 2 = 0 THEN 'Avond ' || w WHEN n % 4 = 1 THEN 'Avond Ada Lint ' || w ELSE 'Nacht ' || w || ' – Bo Café' END AS t, CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 2 = 0 THEN 'Trio Vers' ELSE 'Bo Café' END END AS m, n % 7 = 1 AS vast FROM a)"""


def _sql_bare(x: str) -> str:
    """Normal form of a title without noise at its ends."""
    ends = f"regexp_replace(regexp_replace({sql_noise(x)}, '(?:^|[\\s–-]+)(?:reprise|try-?out)\\s*$', ' ', 'i'), '(?:^|\\s)\\d+\\s*\\+\\s*$', ' ')"
    return sql_norm(ends)


_HAS = "contains(' ' || {0} || ' ', ' ' || {1} || ' ')"
_LIST = """lijst AS (SELECT DISTINCT p_name AS sleutel, CASE length(p_name) % 3 WHEN 0 THEN split_part(p_name, ' ', 1) || ' rod' WHEN 1 THEN 'hot ' || split_part(p_name, ' ', 2) ELSE p_name END AS titel, CASE WHEN length(p_name) % 2 = 0 THEN 'keuze' ELSE 'R2' END AS regel FROM part)"""
_LIVE = "live AS (SELECT sleutel, min(titel) AS titel, max(maker) AS maker, min(genre) AS genre FROM perf WHERE length(sleutel) % 2 = 0 GROUP BY 1)"
_EVENTS_LOG = """log AS (SELECT event_id AS seq, user_id AS plan, CASE WHEN event_id % 97 = 0 THEN 'opheffen' ELSE ['uitnodigen', 'gaat', 'uitnodigen', 'kan-niet', 'intrekken', 'uitnodigen', 'weg'][event_id % 7 + 1] END AS actie, 'g' || (event_id // 7 % 15) AS g FROM events),
eind AS (SELECT plan, min(seq) AS e FROM log WHERE actie = 'opheffen' GROUP BY 1),
l0 AS (SELECT log.*, last_value(CASE WHEN actie IN ('uitnodigen', 'intrekken') THEN actie END IGNORE NULLS) OVER (PARTITION BY plan, g ORDER BY seq) AS roep FROM log LEFT JOIN eind USING (plan) WHERE actie <> 'opheffen' AND (e IS NULL OR seq < e)),
l1 AS (SELECT *, lag(roep, 1, '') OVER (PARTITION BY plan, g ORDER BY seq) AS was FROM l0 WHERE roep = 'uitnodigen' OR actie = 'intrekken'),
l2 AS (SELECT *, sum(CASE WHEN actie = 'uitnodigen' THEN 1 WHEN actie = 'intrekken' AND was = 'uitnodigen' THEN -1 ELSE 0 END) OVER (PARTITION BY plan ORDER BY seq) AS n FROM l1 WHERE NOT (actie = 'uitnodigen' AND was = 'uitnodigen')),
fits AS (SELECT plan, g FROM l2 GROUP BY 1, 2 HAVING max(n) FILTER (actie = 'uitnodigen') <= 10),
kept AS (SELECT l2.* FROM l2 JOIN fits USING (plan, g)),
members AS (SELECT plan, g AS uid, CASE actie WHEN 'uitnodigen' THEN 'uitgenodigd' ELSE actie END AS status FROM (SELECT plan, g, arg_max(actie, seq) AS actie FROM kept GROUP BY 1, 2) WHERE actie <> 'intrekken')"""
_DAY_OF_YEAR = "(DATE '1998-01-01' + (p_partkey % 365)::INT)"
_SHORT_MONTH = "['jan', 'feb', 'mrt', 'apr', 'mei', 'jun', 'jul', 'aug', 'sep', 'okt', 'nov', 'dec']"
_HTML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_WHO = "'@' || lower(substr(stad, 1, 5))"
_BY = "CASE WHEN ends_with(seq, '2') THEN ' (Ada <Lint>)' ELSE '' END"
_WHEN = f"['ma', 'di', 'wo', 'do', 'vr', 'za', 'zo'][isodow(datum)] || ' ' || {_short('datum')} || coalesce(' · ' || tijd, '')"
_WHERE = "theaterNaam || CASE WHEN ends_with(seq, '5') THEN '' ELSE ', ' || stad END"
_URL = "https://app.example/#/berichten"

ORACLE_SQL = {
    "alias_titles": SHOW_SQL
    + f""", {_ALIASES}, r AS (SELECT *, list_filter(string_split(sleutel, ' | '), lambda d: NOT list_contains({_MAKERS}, d))[1] AS eigen FROM perf),
j AS (SELECT r.*, t, m, vast, {sql_norm('t')} AS nt, {_sql_bare('r.maker')} AS nm, string_split(t, ' – ') AS td FROM r LEFT JOIN alias ON alias.sleutel = eigen),
k AS (SELECT *, t IS NOT NULL AND len(td) > 1 AND coalesce({_sql_bare('td[-1]')} = {_sql_bare('m')} AND m IS NOT NULL, false) AS laatst, coalesce(maker <> '' AND length(nm) >= 4 AND {_HAS.format('nt', 'nm')}, false) AS binnen FROM j),
f AS (SELECT *, coalesce(CASE WHEN NOT binnen THEN maker END, CASE WHEN NOT laatst THEN m END) AS eerst, list_filter(string_split(titel, ' – '), lambda d: NOT regexp_matches(trim(d), '^\\(?\\d') AND NOT {_HAS.format('nt', _sql_bare('d'))}) AS rest FROM k)
SELECT seq, coalesce(t, titel) AS titel, CASE WHEN t IS NULL THEN maker WHEN vast THEN CASE WHEN NOT laatst THEN m END ELSE coalesce(eerst, CASE WHEN binnen AND NOT laatst AND len(rest) > 0 THEN array_to_string(rest, ' – ') END) END AS maker,
 CASE WHEN t <> titel THEN titel END AS titelBron, NULL::VARCHAR AS titelVoorAlias FROM f""",
    "slogan_choices": f"""WITH p AS (SELECT p_partkey AS seq, 'v' || (p_partkey % 13) AS theaterId, p_partkey % 5 AS k, 'Artiest ' || chr((65 + p_partkey % 20)::INT) AS a, 'Hoera ' || p_name || '!' AS s, p_name FROM part),
r AS (SELECT seq, theaterId, k, s, CASE WHEN k IN (0, 3) THEN a WHEN k = 1 THEN s ELSE p_name END AS titel, CASE k WHEN 1 THEN a WHEN 4 THEN 'Groep ' || a END AS goed, CASE WHEN k = 0 THEN {sql_norm('s')} WHEN k = 3 THEN {sql_norm('s')} || ' vervolg' END AS km, CASE WHEN k = 3 THEN {sql_norm('s')} END AS kd FROM p),
m AS (SELECT {sql_norm('goed')} AS x, min(theaterId) AS lo, max(theaterId) AS hi FROM r WHERE goed IS NOT NULL GROUP BY 1), t AS (SELECT {sql_norm('titel')} AS x, min(theaterId) AS lo, max(theaterId) AS hi FROM r GROUP BY 1),
j AS (SELECT r.*, {sql_norm('titel')} AS kt, coalesce(tm.lo <> theaterId OR tm.hi <> theaterId, false) AS om, coalesce(td.lo <> theaterId OR td.hi <> theaterId, false) AS od FROM r LEFT JOIN t tm ON tm.x = km LEFT JOIN t td ON td.x = kd WHERE k IN (0, 2, 3)),
c AS (SELECT j.*, k <> 2 AND (om OR od) AND coalesce(m.lo <> theaterId OR m.hi <> theaterId, false) AS om_en_om FROM j LEFT JOIN m ON m.x = kt)
SELECT seq, CASE WHEN k = 2 THEN 'beschrijving' WHEN om_en_om THEN 'omdraaien' ELSE 'laten' END AS keuze, CASE WHEN om_en_om THEN s || CASE WHEN om AND k = 3 THEN ' – Vervolg' ELSE '' END || ' – ' || titel END AS titel, CASE WHEN om_en_om AND NOT om THEN 'Vervolg' END AS rest FROM c""",
    "described_titles": f"""WITH p AS (SELECT p_partkey AS seq, 'v' || (p_partkey % 13) AS theaterId, p_name, 'Artiest ' || reverse(p_name) AS a, CASE WHEN p_partkey % 40 = 0 THEN 0 WHEN p_partkey % 12 = 3 THEN 3 WHEN p_partkey % 4 = 2 THEN 2 ELSE 1 END AS k, p_partkey % 8 = 2 AS z FROM part),
r AS (SELECT *, CASE WHEN k IN (0, 3) THEN a WHEN k = 2 THEN p_name || ' – ' || a ELSE p_name END AS titel, CASE WHEN k IN (0, 3) THEN {sql_norm('a')} ELSE p_name END AS begin, CASE WHEN k = 1 OR (k = 2 AND z) THEN {sql_norm('a')} WHEN k = 3 THEN 'groep noord' END AS wie FROM p),
d AS (SELECT r.seq, EXISTS (SELECT 1 FROM r m WHERE m.wie = r.begin AND m.begin = r.p_name) AND EXISTS (SELECT 1 FROM r m WHERE m.wie = r.begin AND m.theaterId <> r.theaterId) AND NOT EXISTS (SELECT 1 FROM r m WHERE m.begin = r.begin AND m.theaterId <> r.theaterId) AS doet FROM r WHERE k = 0)
SELECT r.seq, theaterId, CASE WHEN doet THEN p_name || ' – deel ' || r.seq || ' – ' || a ELSE titel END AS titel, CASE k WHEN 1 THEN a WHEN 3 THEN 'Groep Noord' END AS maker, CASE WHEN doet THEN titel END AS titelBron, CASE WHEN k = 3 OR NOT doet THEN p_name || ' | deel ' || r.seq END AS beschrijving, coalesce(doet, false) OR z AS volgordeZeker FROM r LEFT JOIN d USING (seq)""",
    "alias_errors": f"""WITH {_LIST} SELECT a.sleutel, 'keten' AS soort FROM lijst a JOIN lijst b ON b.sleutel = a.titel WHERE a.titel <> a.sleutel AND b.titel <> a.titel
UNION ALL SELECT sleutel, 'verboden' FROM lijst WHERE regel <> 'keuze' AND length(sleutel) % 4 = 1""",
    "loose_aliases": f"""WITH {_LIST} SELECT sleutel, p_name AS titel, list_sort(list(DISTINCT 'v' || (p_partkey % 13))) AS theaters FROM part JOIN lijst ON sleutel = p_name WHERE titel <> sleutel GROUP BY sleutel, p_name""",
    "variants_fit": """WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN list_distinct([a, b]) WHEN 1 THEN [a] WHEN 2 THEN ['ada lint'] ELSE [a, 'bo'] END AS v, CASE p_partkey % 3 WHEN 0 THEN [a, 'ada lint'] WHEN 1 THEN list_distinct([b, a]) ELSE [a] END AS c FROM n),
e AS (SELECT *, list_filter(v, lambda x: NOT list_contains(c, x) AND x <> 'ada lint') AS los, list_filter(c, lambda x: NOT list_contains(v, x)) AS erbij FROM d)
SELECT p_partkey, len(los) = 0 AND (len(list_filter(erbij, lambda x: x <> 'ada lint')) = 0 OR (len(v) = 1 AND list_contains(v, 'ada lint'))) AS past FROM e""",
    "rekeyed_watchlist": lists.ORACLE_SQL["lww_watchlist"].replace("'k' || (floor(value)::BIGINT % 5) AS sleutel", "['k0', 'k0', 'k2', 'n3', 'k4'][floor(value)::BIGINT % 5 + 1] AS sleutel"),
    "filled_watchlist": "SELECT * REPLACE (coalesce(maker, CASE sleutel WHEN 'k0' THEN 'Ada Lint' WHEN 'k2' THEN 'Bo Café' END) AS maker, coalesce(genre, CASE sleutel WHEN 'k1' THEN 'Dans' WHEN 'k2' THEN 'Musical' END) AS genre) FROM (" + lists.ORACLE_SQL["lww_watchlist"] + ")",
    "shared_watchlist": SHOW_SQL + f""", {_LIVE}, i AS (SELECT theaterId AS "user", sleutel, max(titel) AS t FROM perf GROUP BY 1, 2) SELECT "user", sleutel, coalesce(titel, t) AS titel, maker, genre FROM i LEFT JOIN live USING (sleutel)""",
    "shared_seen": SHOW_SQL
    + f""", {_LIVE}, i AS (SELECT theaterId AS "user", sleutel, max(titel) AS t, count(*) FILTER (NOT ends_with(seq, '7')) AS n, count(*) AS alle, max(datum) FILTER (NOT ends_with(seq, '7')) AS laatst, min(length(seq)) AS op,
 arg_max(maker, (datum, coalesce(tijd, ''), seq)) FILTER (NOT ends_with(seq, '7') AND coalesce(maker, '') <> '') AS m, arg_max(genre, (datum, coalesce(tijd, ''), seq)) FILTER (NOT ends_with(seq, '7') AND coalesce(genre, '') <> '') AS g FROM perf GROUP BY 1, 2)
SELECT "user", sleutel, coalesce(titel, t) AS titel, coalesce(l.maker, m, 'Zelf') AS maker, coalesce(l.genre, g, 'Overig') AS genre, (alle % 11) / 2.0 AS beoordeling, laatst AS laatsteBezoek, greatest(n, 1)::INT AS aantal,
 row_number() OVER (PARTITION BY "user" ORDER BY coalesce(laatst::TIMESTAMP, make_timestamp_ms(op)) DESC, sleutel)::INT AS plaats FROM i LEFT JOIN live l USING (sleutel)""",
    "seen_by_rating": """WITH i AS (SELECT c_custkey % 7 AS "user", 'k' || c_custkey AS sleutel, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 10 + 1) / 2.0 ELSE 0 END AS r, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN (DATE '1998-01-01' + (c_custkey % 50)::INT)::TIMESTAMP END, make_timestamp_ms(c_custkey * 86400000 * 365)) AS stip FROM customer)
SELECT "user", sleutel, row_number() OVER (PARTITION BY "user" ORDER BY r DESC, stip DESC, sleutel)::INT AS plaats FROM i""",
    "upcoming_plans": f"""WITH p AS (SELECT user_id AS "user", event_id AS plan, DATE '{TODAY}' + (event_id % 40 - 20)::INT AS datum, CASE WHEN event_id % 3 <> 0 THEN '20:00' END AS tijd FROM events)
SELECT *, count(*) OVER (PARTITION BY "user", datum) - 1 AS zelfde FROM p WHERE datum >= DATE '{TODAY}'""",
    "gone_plans": SHOW_SQL + "SELECT 'p' || seq AS plan, beschikbaarheid AS vervallen FROM perf WHERE NOT ends_with(seq, '3') AND beschikbaarheid IN ('afgelast', 'verplaatst')",
    "watchlist_lines": SHOW_SQL
    + f""", w AS (SELECT o_custkey AS u, sleutel, min(titel) AS titel FROM perf JOIN orders ON o_orderkey = substr(seq, 1, 10)::BIGINT GROUP BY 1, 2
 UNION ALL SELECT c_custkey, 'weg is weg', 'Weg is weg' FROM customer),
g AS (SELECT *, CASE WHEN length(sleutel) % 3 = 0 AND sleutel <> 'weg is weg' THEN (u * 1000 + length(sleutel)) || '|v1' ELSE 's|' || sleutel END AS groep FROM w),
s AS (SELECT *, coalesce(tijd, '99:99') AS t, beschikbaarheid IN ('afgelast', 'verplaatst') AS gone FROM perf WHERE datum >= DATE '{TODAY}'),
j AS (SELECT g.u, g.groep, g.sleutel AS k, g.titel AS eigen, s.* FROM g LEFT JOIN s ON s.sleutel = g.sleutel),
a AS (SELECT u, groep, arg_min({{'d': datum, 't': t, 's': seq, 'ti': titel, 'm': maker, 'n': theaterNaam, 'p': podiumpas, 'b': norm}}, (datum, t, seq)) FILTER (NOT gone) AS door, arg_min({{'d': datum, 't': t, 's': seq, 'ti': titel, 'm': maker, 'n': theaterNaam, 'p': podiumpas, 'b': norm}}, (datum, t, seq)) FILTER (gone) AS niet,
 count(DISTINCT theaterId) FILTER (NOT gone) AS n_door, count(DISTINCT theaterId) AS n_alle, arg_min(eigen, k) AS eigen FROM j GROUP BY 1, 2),
b AS (SELECT *, coalesce(door, niet) AS e, CASE WHEN door IS NOT NULL THEN n_door ELSE n_alle END AS n FROM a),
c AS (SELECT u AS "user", groep, CASE WHEN door IS NOT NULL THEN 'komend' WHEN niet IS NOT NULL THEN 'vervallen' ELSE 'weg' END AS soort, e.d AS eerste, nullif(e.t, '99:99') AS tijd,
 CASE WHEN e IS NULL THEN 'Weg is weg – Ada Lint' WHEN e.m IS NULL OR {_HAS.format('e.b', sql_norm('e.m'))} THEN e.ti ELSE e.ti || ' – ' || e.m END AS titel, CASE WHEN e IS NULL THEN 0 ELSE n END::INT AS theaters,
 CASE WHEN e IS NOT NULL THEN e.n || CASE WHEN n > 1 THEN ' en ' || (n - 1) || CASE WHEN n = 2 THEN ' ander theater' ELSE ' andere theaters' END ELSE '' END END AS plaatsnaam, door.p AS podiumpas, e.s AS q FROM b)
SELECT * EXCLUDE (q), row_number() OVER (PARTITION BY "user" ORDER BY CASE soort WHEN 'komend' THEN 0 WHEN 'vervallen' THEN 1 ELSE 2 END, eerste NULLS FIRST, coalesce(tijd, '99:99'), q NULLS FIRST, titel, groep)::INT AS volgorde FROM c""",
    "plan_guests": f"WITH {_EVENTS_LOG} SELECT * FROM members",
    "plan_messages": f"""WITH {_EVENTS_LOG} SELECT plan, NULL::VARCHAR AS naar, g AS van, CASE actie WHEN 'gaat' THEN 'gaat-mee' ELSE actie END AS soort FROM kept WHERE actie IN ('gaat', 'kan-niet', 'weg')
UNION ALL SELECT plan, uid, 'eigenaar', 'opgeheven' FROM members JOIN eind USING (plan) WHERE status IN ('gaat', 'uitgenodigd')""",
    "shared_view": """WITH k AS (SELECT o_custkey AS u, list_sort(list(DISTINCT o_orderpriority)) AS items FROM orders GROUP BY 1), v AS (SELECT c_custkey AS ik, c_custkey * 2 // 3 AS vriend FROM customer)
SELECT ik, vriend, CASE WHEN s.c_nationkey > 4 AND vriend % 3 <> 0 THEN coalesce(items, []) END AS items FROM v LEFT JOIN customer s ON s.c_custkey = vriend LEFT JOIN k ON u = vriend""",
    "status_messages": """WITH m AS (SELECT o_orderkey // 8 AS plan, o_orderkey AS uid, ['uitgenodigd', 'gaat', 'kan-niet', 'weg'] AS s, o_orderkey AS k FROM orders), b AS (SELECT *, CASE WHEN uid % 10 <> 0 THEN s[k // 3 % 4 + 1] END AS was, s[k // 5 % 4 + 1] AS nu FROM m)
SELECT plan, uid, CASE nu WHEN 'gaat' THEN 'gaat-mee' ELSE nu END AS soort FROM b WHERE nu <> 'uitgenodigd' AND nu IS DISTINCT FROM was""",
    "agenda_order": SHOW_SQL + "SELECT seq, row_number() OVER (PARTITION BY datum ORDER BY coalesce(tijd, '99:99'), seq)::INT AS plaats FROM perf WHERE datum >= DATE '1998-02-10'",
    "filter_counts": "SELECT c_custkey, ((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT + (c_custkey % 4 = 0)::INT + (c_custkey % 6 <> 0 AND c_custkey % 7 = 0)::INT + (c_custkey % 9 = 0)::INT + (c_custkey % 10 = 0)::INT + (c_custkey % 11 = 0)::INT)::INT AS n FROM customer",
    "when_choices": SHOW_SQL
    + """SELECT keuze, datum, count(*) AS n FROM (SELECT datum, unnest(list_filter([CASE WHEN datum BETWEEN DATE '1998-02-20' AND DATE '1998-03-05' AND isodow(datum) IN (1, 6) THEN 'a' END, CASE WHEN datum BETWEEN DATE '1998-02-10' AND DATE '1998-02-28' AND isodow(datum) = 2 THEN 'b' END,
 CASE WHEN datum >= DATE '1998-02-14' THEN 'c' END, 'd'], lambda x: x IS NOT NULL)) AS keuze FROM perf) GROUP BY 1, 2""",
    "rating_texts": """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 29) / 4.0 END AS r FROM part), v AS (SELECT *, coalesce(r BETWEEN 1 AND 5 AND r * 2 = floor(r * 2), false) AS geldig FROM r)
SELECT p_partkey, geldig, CASE WHEN geldig THEN CASE WHEN r = floor(r) THEN r::INT::VARCHAR ELSE floor(r)::INT || ',5' END END AS tekst FROM v""",
    "count_texts": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 OR p_partkey % 4 = 0 THEN 'Geen komende voorstellingen' WHEN p_partkey % 4 = 1 THEN '1 komende voorstelling' ELSE (p_partkey % 4) || ' komende voorstellingen' END AS tekst FROM part""",
    "names_in_texts": """WITH t AS (SELECT p_partkey, lower(concat_ws(' ', p_type, CASE WHEN p_partkey % 3 <> 0 THEN p_name END)) AS t FROM part)
SELECT p_partkey, CASE WHEN contains(t, 'red') THEN 'Rêd' WHEN contains(t, 'ring') THEN 'ring' WHEN contains(t, 'blue') THEN 'BLUE' WHEN contains(t, 'hot') THEN 'hot' END AS naam FROM t""",
    "text_drift": """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'weg' WHEN starts_with(p_name, 'red ring') THEN 'gelijk' WHEN starts_with(p_name, 'red') THEN 'gewijzigd' ELSE 'weg' END AS stand FROM part""",
    "network_errors": "SELECT event_id, event_id % 17 <> 0 AND event_id % 8 IN (0, 1, 2, 4, 5) AS netwerk FROM events",
    "refreshed_today": f"SELECT event_id, coalesce(event_id % 7 <> 0 AND timezone('Europe/Amsterdam', timezone('UTC', ts))::DATE = timezone('Europe/Amsterdam', to_timestamp({NOW} / 1000))::DATE, false) AS vandaag FROM events",
    "details_kept": f"SELECT page_id FROM pages WHERE page_id % 40 <= {RU.KEEP_DAYS} OR url IN (SELECT url FROM pages WHERE page_id % 5 = 0)",
    "first_tags": """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN ['bolt & hot', 'ring'] ELSE string_split(p_name, ' ') END AS tags FROM part), c AS (SELECT p_partkey, list_filter(list_transform(tags, lambda x: CASE x WHEN 'red' THEN 'Dans' WHEN 'blue' THEN 'Dans' WHEN 'ring' THEN 'Musical' WHEN 'saddle' THEN 'Toneel' WHEN 'bolt & hot' THEN 'Cabaret' END), lambda x: x IS NOT NULL) AS c FROM t)
SELECT p_partkey, c[1] AS genre FROM c""",
    "invitation_texts": SHOW_SQL
    + f"""SELECT seq, {_WHO} || ' nodigt je uit voor ' || titel || ' & "x"' AS onderwerp,
 'Hoi,' || chr(10) || chr(10) || {_WHO} || {_BY} || ' nodigt je uit om samen naar een voorstelling te gaan:' || chr(10) || chr(10) || titel || ' & "x"' || chr(10) || {_WHEN} || chr(10) || {_WHERE} || chr(10) || chr(10) || '{_URL}' AS tekst,
 '<p>' || {_HTML.format(f"{_WHO} || {_BY}")} || ' nodigt je uit:</p><p><b>' || {_HTML.format("titel || ' & \"x\"'")} || '</b><br>' || {_HTML.format(_WHEN)} || '<br>' || {_HTML.format(_WHERE)} || '</p><p><a href="{_URL}">{_URL}</a></p>' AS html FROM perf""",
    "marked_blocks": """SELECT p_partkey, '# ' || p_name || chr(10) || '<!-- AUTO:telling:start -->' || chr(10) || p_partkey || ' titels' || chr(10) || '<!-- AUTO:telling:end -->' || chr(10) || 'slot <!-- AUTO:lijst:start -->' || chr(10) || p_brand || chr(10) || '<!-- AUTO:lijst:end -->' AS tekst FROM part""",
    "search_hits": """SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS titel, timezone('Europe/Amsterdam', timezone('UTC', o_orderdate))::DATE AS datum, strftime(timezone('Europe/Amsterdam', timezone('UTC', o_orderdate)), '%H:%M') AS tijd, 'Zaal ' || (o_orderkey % 5) AS locatie, CASE WHEN o_orderkey % 3 = 0 THEN 'Foyer' END AS extra, o_orderkey % 4 <> 0 AND o_orderkey % 7 = 0 AS vervallen FROM orders""",
    "production_events": """SELECT l_orderkey::VARCHAR AS production, 'Titel ' || (l_orderkey % 50) AS titel, l_shipdate::VARCHAR AS start, l_returnflag AS status, CASE WHEN l_orderkey % 2 = 0 THEN '/t/' || l_orderkey || '/' || l_linenumber END AS url FROM lineitem WHERE l_linenumber % 3 <> 0""",
    "search_configs": """WITH g AS (SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS ok, p_brand FROM part) SELECT p_partkey, CASE WHEN ok THEN 'AP' || p_partkey END AS app, CASE WHEN ok THEN lower(hex(p_partkey)) || 'a0' END AS sleutel, CASE WHEN ok THEN regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') END AS "index" FROM g""",
    "article_rows": """SELECT p_partkey, p_partkey::VARCHAR AS showid, '1998-03-01T20:' || lpad((p_partkey % 60)::VARCHAR, 2, '0') AS start, p_name AS titel, p_brand AS ondertitel, '€ ' || p_size AS prijs, 'reserveren' AS status, CASE WHEN p_partkey % 2 = 0 THEN 'laatste' END AS webstatus, '/show/' || p_partkey AS href FROM part
UNION ALL SELECT p_partkey, '9', NULL, NULL, NULL, NULL, NULL, NULL, '/klik/' || p_partkey FROM part""",
    "plugin_events": """SELECT p_partkey, p_name AS titel, p_brand AS ondertitel, '/v/' || p_partkey AS href, ['Dans', p_type] AS categorieen, 'zo 1 mrt' AS datum, '20:15' AS tijd, ['beschikbaar', 'uitverkocht', 'wachtlijst', 'afgelast', 'verplaatst', 'beschikbaar'][p_partkey % 6 + 1] AS beschikbaarheid, '/t/' || p_partkey AS ticketUrl, p_size + CASE WHEN p_partkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0 END AS prijs FROM part
UNION ALL SELECT p_partkey, 'Los', NULL, NULL, [], NULL, '19.30', 'beschikbaar', NULL, NULL FROM part""",
    "detail_dates": """WITH l AS (SELECT l_orderkey, l_linenumber, l_shipdate AS d, CASE WHEN l_linenumber % 3 <> 0 THEN '2' || (l_linenumber % 4) || ':15' END AS t, CASE l_returnflag WHEN 'R' THEN 'Geweest' WHEN 'A' THEN 'Bestel nu' ELSE 'Wachtlijst' END AS k FROM lineitem)
SELECT * FROM (SELECT l_orderkey, d::DATE AS datum, t AS tijd, arg_min(k, (l_linenumber, k)) AS knop FROM l GROUP BY 1, 2, 3) WHERE knop <> 'Geweest'""",
    "unknown_buttons": SHOW_SQL + "SELECT * FROM (SELECT CASE substr(seq, 10, 1)::INT % 5 WHEN 1 THEN 'Meer info' WHEN 2 THEN '(geen knop)' WHEN 3 THEN 'Inloop' END AS tekst, count(*) AS n FROM perf GROUP BY 1) WHERE tekst IS NOT NULL",
    "row_dates": f"""WITH r AS (SELECT p_partkey, {_DAY_OF_YEAR} AS d, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 3 THEN make_date(2026, month(d), day(d)) WHEN k < 3 OR p_partkey % 2 = 0 THEN d END AS datum, CASE WHEN k = 0 THEN '20:15' WHEN p_partkey % 3 = 0 THEN '09:30' END AS tijd FROM r""",
}
