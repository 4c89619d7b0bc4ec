"""Answers of sources' interfaces, saved as JSON texts, and listing cards saved as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..functions.values import first_time, lowest_price
from .crawl import button_status, ticket_status

PAGED = "struct<pages:int,currentPage:int,raw:array<struct<id:bigint,title:string,subtitle:string,itix_from_raw:bigint,itix_show_status:string,show_web_status:string,url:string,location_title:string>>>"
HITS = "struct<hits:array<struct<objectID:string,title:string,eventDateTimeStart:bigint,eventGenre:array<string>,eventLocations:string,eventLocationAddition:string,is_cancelled:int>>,nbHits:int,nbPages:int,page:int>"
PRODUCTIONS = "struct<productions:map<string,struct<id:string,title:string,events:array<struct<start:string,soort:string,salesStatus:string,salesUrl:string>>>>>"


def paged_rows(pages: DataFrame, column: str = "json", most: int = 30) -> DataFrame:
    """id, titel, maker, datum, tijd, status, web, url of a listing that comes in pages; up to ``most`` pages are read.

    A page that is no such JSON is an error.
    """
    parsed = F.from_json(column, PAGED)
    checked = pages.select(F.when(parsed["raw"].isNotNull(), parsed).otherwise(F.raise_error(F.lit("page has another shape")).cast(PAGED)).alias("p"))
    rows = checked.filter(F.coalesce(F.col("p.currentPage"), F.lit(1)) <= most).select(F.explode("p.raw").alias("x"))
    day, time = D.from_unix(F.col("x.itix_from_raw"))
    return rows.select("x.id", F.col("x.title").alias("titel"), F.nullif("x.subtitle", F.lit("")).alias("maker"), day.alias("datum"), time.alias("tijd"), F.col("x.itix_show_status").alias("status"), F.col("x.show_web_status").alias("web"), "x.url")


def search_hits(pages: DataFrame, column: str = "json") -> DataFrame:
    """id, titel, datum, tijd, genres, locatie, extra, vervallen of a search interface's hits, each once."""
    hits = pages.select(F.explode(F.from_json(column, HITS)["hits"]).alias("x"))
    day, time = D.from_unix(F.col("x.eventDateTimeStart"))
    rows = hits.select(F.col("x.objectID").alias("id"), F.col("x.title").alias("titel"), day.alias("datum"), time.alias("tijd"), F.col("x.eventGenre").alias("genres"), F.col("x.eventLocations").alias("locatie"), F.col("x.eventLocationAddition").alias("extra"), (F.coalesce(F.col("x.is_cancelled"), F.lit(0)) != 0).alias("vervallen"))
    return rows.groupBy("id").agg(F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("x")).select("id", "x.*")


def place_of(location: Column, addition: Column, home: str, rooms: str, outside: str, city: str, others: dict[str, str]) -> tuple[Column, Column]:
    """(venue, place) of a hit, nulls for hits to leave out.

    ``outside`` (a pattern) is not of this source; ``others`` are venues by the pattern their name starts with; a room
    of the house (``rooms``) has no place of its own.
    """
    loc, extra = X.strip(F.coalesce(location, F.lit(""))), F.nullif(X.strip(F.coalesce(addition, F.lit(""))), F.lit(""))
    away = F.concat_ws(" ", loc, extra).rlike(f"(?i){outside}")
    venue = F.lit(home)
    for v, pattern in others.items():
        venue = F.when(loc.rlike(f"(?i)^{pattern}"), v).otherwise(venue)
    other = loc.rlike("(?i)^overige locaties$")
    inside = loc.rlike(f"(?i)^{rooms}") | (venue != home)
    named = F.when(other, F.when(extra.isNotNull() & ~extra.rlike("(?i)theatercaf|foyer"), extra)).when(~inside & (loc != ""), loc)
    return F.when(~away, venue), F.when(~away & named.isNotNull(), F.concat(named, F.lit(f" | {city}")))


def production_events(pages: DataFrame, column: str = "json", kind: str = "voorstelling") -> DataFrame:
    """production, titel, start, status, url of the events of one kind in a map of productions."""
    p = pages.select(F.explode(F.from_json(column, PRODUCTIONS)["productions"]).alias("production", "x"))
    e = p.select("production", F.col("x.title").alias("titel"), F.explode_outer("x.events").alias("e"))
    return e.filter(F.lower(F.coalesce("e.soort", F.lit(""))) == kind).select("production", "titel", F.col("e.start").alias("start"), F.col("e.salesStatus").alias("status"), F.col("e.salesUrl").alias("url"))


def _inner(html: Column, css_class: str) -> Column:
    """Text of the first element with a class."""
    inner = F.regexp_extract(html, f"(?s)<(\\w+)[^>]*class=\"(?:[^\"]*\\s)?{css_class}(?:\\s[^\"]*)?\"[^>]*>(.*?)</\\1>", 2)
    return X.let(X.squeeze(F.regexp_replace(inner, "<[^>]*>", " ")), lambda t: F.when(t != "", t))


def cards(pages: DataFrame, id: str, column: str = "html") -> DataFrame:
    """id, entry, titel, maker, genre, prijs, rijen of listing cards; rijen are dag, tijd, knop, status of each date.

    A card's dates are rows of class ``subshow`` in its panel, or one date on the card itself.
    """
    card = F.regexp_extract_all(column, F.lit("(?s)<li[^>]*data-entry-id=\"([^\"]+)\"[^>]*>.*?(?=<li[^>]*data-entry-id=|\\z)"), F.lit(0))
    # saved pages are few bytes and much work: they are dealt out to all tasks
    dealt = pages.select(id, column).repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), id)
    rows = dealt.select(id, F.explode(card).alias("c"))
    dates = F.regexp_extract_all("c", F.lit("(?s)<li[^>]*class=\"(?:[^\"]*\\s)?subshow(?:\\s[^\"]*)?\"[^>]*>.*?</li>"), F.lit(0))
    panels = X.let(dates, lambda d: F.when(F.size(d) > 0, d).when(F.col("c").rlike("dateTimeInner"), F.array("c")).otherwise(F.array().cast("array<string>")))

    def one(h: Column) -> Column:
        # each text is looked up once, however often what is made of it names it
        said = F.struct(_inner(h, "start").alias("dag"), _inner(h, "time").alias("tijd"), _inner(h, "btn").alias("knop"))
        return X.let(said, lambda x: F.struct(x["dag"].alias("dag"), first_time(x["tijd"]).alias("tijd"), x["knop"].alias("knop"), button_status(x["knop"]).alias("status")))

    return rows.select(
        id, F.regexp_extract("c", "data-entry-id=\"([^\"]+)\"", 1).alias("entry"), _inner(F.col("c"), "title").alias("titel"), _inner(F.col("c"), "subtitle").alias("maker"), _inner(F.col("c"), "genres__link").alias("genre"),
        X.let(_inner(F.col("c"), "price"), lowest_price).alias("prijs"), F.transform(panels, one).alias("rijen"),
    )


def card_dates(cards_: DataFrame, id: str) -> DataFrame:
    """One row for each date of each card that is not to be left out (sold elsewhere, over)."""
    # before a plain explode Spark looks for empty lists, for which it would read all cards' dates once more
    rows = cards_.select(id, "entry", "titel", "maker", "genre", "prijs", F.explode_outer("rijen").alias("r"))
    return rows.filter(F.col("r.status").isNotNull()).select(id, "entry", "titel", "maker", "genre", "prijs", "r.dag", "r.tijd", F.col("r.status").alias("beschikbaarheid"))


def search_config(html: Column) -> Column:
    """app, sleutel and index of a search interface, from a page's settings; null unless all three are there."""
    of = lambda name, value: F.nullif(F.regexp_extract(html, f'"{name}":"({value})"', 1), F.lit(""))
    app, key, index = of("applicationId", "[A-Z0-9]+"), of("searchApiKey", "[a-f0-9]+"), of("eventIndexName", "[A-Za-z0-9_-]+")
    return F.when(app.isNotNull() & key.isNotNull() & index.isNotNull(), F.struct(app.alias("app"), key.alias("sleutel"), index.alias("index")))


def _attribute(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, f"(?s)\\b{name}=\"([^\"]*)\"", 1), F.lit(""))


def _opening(html: Column, mark: str) -> Column:
    """The opening tag of the first element that has ``mark`` (a pattern) in it."""
    return F.regexp_extract(html, f"(?s)<\\w+[^>]*{mark}[^>]*>", 0)


def articles(pages: DataFrame, id: str, column: str = "html") -> DataFrame:
    """id, showid, start, titel, ondertitel, prijs, status, webstatus, href of the articles in a page's HTML."""
    block = F.regexp_extract_all(column, F.lit('(?s)<article[^>]*class="(?:[^"]*\\s)?program-block(?:\\s[^"]*)?"[^>]*>.*?</article>'), F.lit(0))
    rows = pages.select(id, F.explode(block).alias("a"))
    head, button, info = _opening(F.col("a"), "program-block"), _opening(F.col("a"), 'data-hook="order-link-placeholder"'), _opening(F.col("a"), 'class="(?:[^"]*\\s)?icon-info(?:\\s[^"]*)?"')
    click = F.nullif(F.regexp_extract(_attribute(head, "onclick"), "location='([^']+)'", 1), F.lit(""))
    return rows.select(
        id, _attribute(head, "data-showid").alias("showid"), _attribute(_opening(F.col("a"), 'itemprop="startDate"'), "content").alias("start"), _inner(F.col("a"), "program-block__title").alias("titel"), _inner(F.col("a"), "program-block__subtitle").alias("ondertitel"),
        _inner(F.col("a"), "program-block__price").alias("prijs"), _attribute(button, "data-status").alias("status"), _attribute(button, "data-webstatus").alias("webstatus"), F.coalesce(_attribute(info, "href"), click).alias("href"),
    )


def plugin_events(pages: DataFrame, id: str, column: str = "html") -> DataFrame:
    """id, titel, ondertitel, href, categorieen, datum, tijd, beschikbaarheid, ticketUrl and prijs of the events of an agenda plugin's standard layout."""
    block = F.regexp_extract_all(column, F.lit('(?s)<div[^>]*class="(?:[^"]*\\s)?wp_theatre_event(?:\\s[^"]*)?"[^>]*>.*?(?=<div[^>]*class="(?:[^"]*\\s)?wp_theatre_event(?:\\s[^"]*)?"|\\z)'), F.lit(0))
    e = F.col("e")
    button = _opening(e, 'class="(?:[^"]*\\s)?wp_theatre_event_tickets_url(?:\\s[^"]*)?"')
    text = F.when(button != "", _inner(e, "wp_theatre_event_tickets_url")).otherwise(_inner(e, "wp_theatre_event_tickets"))
    named = F.regexp_extract_all(e, F.lit('(?s)class="(?:[^"]*\\s)?wpt_production_category(?:\\s[^"]*)?"[^>]*>([^<]*)<'), F.lit(1))
    title = F.regexp_extract(e, '(?s)class="(?:[^"]*\\s)?wp_theatre_event_title(?:\\s[^"]*)?"[^>]*>.*?</', 0)
    price = F.regexp_extract(_inner(e, "wp_theatre_event_prices"), "([0-9]+)(?:[,.]([0-9]{2}))?", 1)
    cents = F.regexp_extract(_inner(e, "wp_theatre_event_prices"), "([0-9]+)(?:[,.]([0-9]{2}))?", 2)
    return pages.select(id, F.explode(block).alias("e")).select(
        id, _inner(e, "wp_theatre_event_title").alias("titel"), _inner(e, "wp_theatre_event_subtitle").alias("ondertitel"), _attribute(title, "href").alias("href"), F.transform(named, X.strip).alias("categorieen"),
        _inner(e, "startdate_date").alias("datum"), F.coalesce(_inner(e, "wp_theatre_event_starttime"), _inner(e, "startdate_time")).alias("tijd"), ticket_status(text, _attribute(button, "class")).alias("beschikbaarheid"),
        _attribute(button, "href").alias("ticketUrl"), F.when(price != "", F.concat(price, F.lit("."), F.when(cents == "", "00").otherwise(cents)).cast("double")).alias("prijs"),
    )


def detail_dates(pages: DataFrame, id: str, column: str = "html") -> DataFrame:
    """id, datum, tijd (null at midnight) and knop of the dates on a production's page, each instant once; what is over is left out."""
    items = F.regexp_extract_all(column, F.lit('(?s)<li[^>]*class="(?:[^"]*\\s)?subshow(?:\\s[^"]*)?"[^>]*>.*?</li>'), F.lit(0))
    start = F.regexp_extract("li", 'data-event-start="([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}[^"]*)"', 1)
    rows = pages.select(id, F.posexplode(items).alias("pos", "li")).select(id, "pos", start.alias("start"), _inner(F.col("li"), "buttonBox").alias("knop")).filter("start <> ''")
    first = rows.groupBy(id, "start").agg(F.min_by("knop", "pos").alias("knop")).filter(~F.coalesce(F.lower("knop"), F.lit("")).contains("geweest"))
    time = F.substring("start", 12, 5)
    return first.select(id, F.substring("start", 1, 10).cast("date").alias("datum"), F.when(time != "00:00", time).alias("tijd"), "knop")


def unknown_buttons(rows: DataFrame, button: str = "knop") -> DataFrame:
    """tekst and n of the button texts whose availability stayed unknown; "(geen knop)" where there was none."""
    return rows.filter("beschikbaarheid = 'onbekend'").groupBy(F.coalesce(button, F.lit("(geen knop)")).alias("tekst")).agg(F.count(F.lit(1)).alias("n"))


def row_date(start: Column, text: Column, time: Column, rolled: Column) -> tuple[Column, Column]:
    """(date, time) of a listing's row: of its instant, else of a text with a year ("27 sep 2026", "27 sep '26"), else ``rolled``, the date that the list gives."""
    stamped = start.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    own = F.substring(start, 12, 5)
    dated = "([0-9]{1,2})\\s+([a-z]{3})[a-z.]*\\s*(?:[’']([0-9]{2})|([0-9]{4}))"
    low = F.lower(text)
    month = D.place_in(D.SHORT_MONTHS, F.regexp_extract(low, dated, 2))
    year = F.when(F.regexp_extract(low, dated, 4) != "", F.regexp_extract(low, dated, 4)).otherwise(F.concat(F.lit("20"), F.regexp_extract(low, dated, 3)))
    written = F.when(month.isNotNull(), F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(low, dated, 1), 2, "0")), "yyyy-MM-dd"))
    day = F.when(stamped, F.try_to_date(F.substring(start, 1, 10), "yyyy-MM-dd")).when(text.isNotNull(), F.coalesce(written, rolled))
    return day, F.when(F.coalesce(stamped, F.lit(False)) & own.rlike("^[0-9]{2}:[0-9]{2}$") & (own != "00:00"), own).otherwise(first_time(time))
