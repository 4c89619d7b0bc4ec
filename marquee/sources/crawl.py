"""Saved pages as sources: listing pages, sitemaps, embedded data, robots rules, challenge pages, source statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import cancelled_status

LOC = "<loc>\\s*([^<\\s]+)\\s*</loc>"
LD_JSON = "(?is)<script[^>]*type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"


def new_items(listing: DataFrame, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, state) of paged listings: rows site, page, pos, key.

    Items are first occurrences of their key, up to the first page that has no new key.  state has for each site the
    pages read and whether the listing ended by itself (false where ``max_pages`` cut it).
    """
    rows = listing.filter(F.col("page") <= max_pages) if max_pages else listing
    first = rows.groupBy("site", "key").agg(F.min(F.struct("page", "pos")).alias("first"))
    fresh = first.groupBy("site", F.col("first.page").alias("page")).agg(F.count(F.lit(1)).alias("nieuw"))
    pages = rows.select("site", "page").distinct().join(fresh, ["site", "page"], "left").withColumn("nieuw", F.coalesce("nieuw", F.lit(0)))
    stop = pages.groupBy("site").agg(F.min(F.when(F.col("nieuw") == 0, F.col("page"))).alias("stop"), F.max("page").alias("laatste"))
    items = first.select("site", "key", "first.page", "first.pos").join(stop, "site").filter("stop is null or page < stop").select("site", "key", "page", "pos")
    ended = F.col("stop").isNotNull() | (F.col("laatste") < F.lit(max_pages) if max_pages else F.lit(True))
    return items, stop.select("site", F.coalesce("stop", "laatste").alias("paginas"), ended.alias("klaar"))


def listing_from_one(listing: DataFrame, sites: DataFrame, max_pages: int = 40) -> tuple[DataFrame, DataFrame]:
    """``new_items`` of listings whose pages count from 1; page 0 is only a disabled button, and a site (of ``sites``) with nothing on page 1 is an error."""
    begun = listing.filter("page = 1").select("site").distinct().withColumn("_er", F.lit(True))
    checked = sites.select("site").distinct().join(begun, "site", "left")
    read = checked.filter(F.coalesce("_er", F.raise_error(F.concat(F.lit("nothing on page 1 of "), F.col("site").cast("string"))).cast("boolean"))).select("site")
    return new_items(listing.filter("page >= 1").join(read, "site"), max_pages)


def sitemap_urls(pages: DataFrame, xml: str, keep: str = "/agenda/[^/?#]+$", drop: str = "/agenda/koop-ticket$") -> DataFrame:
    """Distinct urls of sitemaps that match ``keep`` and not ``drop``."""
    urls = pages.select(F.explode(F.regexp_extract_all(xml, F.lit(LOC), F.lit(1))).alias("url"))
    return urls.filter(F.col("url").rlike(keep) & ~F.col("url").rlike(drop)).distinct()


def links(pages: DataFrame, html: str, id: str) -> DataFrame:
    """id, href, n of the links of each page."""
    hrefs = pages.select(id, F.explode(F.regexp_extract_all(html, F.lit("<a[^>]*href=\"([^\"]*)\""), F.lit(1))).alias("href"))
    return hrefs.groupBy(id, "href").agg(F.count(F.lit(1)).alias("n"))


def event_starts(html: Column) -> Column:
    """Sorted start dates of events in a page's JSON-LD; scripts that are no JSON are left out."""
    scripts = F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1))
    as_list = F.transform(scripts, lambda s: F.when(F.ltrim(s).startswith("["), s).otherwise(F.concat(F.lit("["), s, F.lit("]"))))
    events = F.flatten(F.transform(as_list, lambda s: F.coalesce(F.from_json(s, "array<struct<`@type`:string,startDate:string>>"), F.array().cast("array<struct<`@type`:string,startDate:string>>"))))
    return F.array_sort(F.transform(F.filter(events, lambda e: e["@type"].rlike("Event$") & (F.coalesce(e["startDate"], F.lit("")) != "")), lambda e: e["startDate"]))


def robots_groups(texts: DataFrame) -> DataFrame:
    """site, groep, agents, delay and rules (kind, pattern) of robots texts (site, text).

    Agents that follow each other share a group; what stands before the first agent is left out.
    """
    lines = texts.select("site", F.posexplode(F.split("text", "\n")).alias("pos", "l")).withColumn("l", X.strip(F.regexp_replace("l", "#.*", "")))
    parsed = lines.filter(F.contains("l", F.lit(":"))).select("site", "pos", F.lower(X.strip(F.substring_index("l", ":", 1))).alias("k"), X.strip(F.expr("substring(l, instr(l, ':') + 1)")).alias("v"))
    known = parsed.filter(F.col("k").isin("user-agent", "allow", "disallow", "crawl-delay"))
    by = W.partitionBy("site").orderBy("pos")
    starts = F.when((F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(by), F.lit("")) != "user-agent"), 1).otherwise(0)
    grouped = known.withColumn("_s", starts).withColumn("groep", F.sum("_s").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))).filter("groep > 0")
    rule = F.when(F.col("k").isin("allow", "disallow"), F.struct("pos", F.col("k").alias("kind"), F.col("v").alias("pattern")))
    return grouped.groupBy("site", "groep").agg(
        F.array_sort(F.collect_set(F.when(F.col("k") == "user-agent", F.lower("v")))).alias("agents"),
        F.max_by(F.when(F.col("k") == "crawl-delay", F.col("v").try_cast("double")), F.when(F.col("k") == "crawl-delay", F.col("pos"))).alias("delay"),
        F.transform(F.array_sort(F.collect_list(rule)), lambda r: F.struct(r["kind"].alias("kind"), r["pattern"].alias("pattern"))).alias("rules"),
    )


def group_for(groups: DataFrame, token: str) -> DataFrame:
    """The group of each site that holds for an agent: the first that names it, else the first for all."""
    t = token.lower()
    named = F.exists("agents", lambda a: (a == t) | ((a != "*") & (a != "") & F.contains(F.lit(t), a)))
    rank = F.when(named, 0).when(F.array_contains("agents", "*"), 1)
    fit = groups.withColumn("_r", rank).filter("_r is not null")
    return fit.groupBy("site").agg(F.min_by(F.struct("groep", "delay", "rules"), F.struct("_r", "groep")).alias("x")).select("site", "x.*")


def robots_allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """site, path, allowed: the longest pattern that fits decides, of equal ones an allow; nothing fitting is allowed.

    rules: site, kind (allow, disallow), pattern with ``*`` and a final ``$``.  An empty disallow is no rule.
    """
    r = rules.filter("not (kind = 'disallow' and pattern = '')").select("site", "kind", "pattern").distinct()
    escaped = F.regexp_replace("pattern", "([.+^{}()|\\[\\]\\\\?])", "\\\\$1")
    ends = F.endswith(escaped, F.lit("$"))
    body = F.regexp_replace(F.when(ends, F.expr("substring(e, 1, length(e) - 1)")).otherwise(F.col("e")), "\\*", ".*")
    r = r.withColumn("e", escaped).withColumn("re", F.concat(F.lit("^"), body, F.when(F.endswith("e", F.lit("$")), "$").otherwise("")))
    unique = paths.select("site", "path").distinct()
    fits = unique.join(r.select("site", "kind", "pattern", "re"), "site").filter(F.expr("path rlike re"))
    best = fits.groupBy("site", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), (F.col("kind") == "allow").alias("allow"))).alias("best"))
    return paths.join(best, ["site", "path"], "left").withColumn("allowed", F.coalesce("best.allow", F.lit(True))).drop("best")


def crawl_delay_ms(robots: Column, own_seconds: Column) -> Column:
    """The largest of the robots delay, a site's own delay and a second; what is no positive number counts as 0."""
    fine = lambda c: F.when((c > 0) & ~F.isnan(c.cast("double")), c).otherwise(0).cast("double")
    return F.greatest(fine(robots), fine(own_seconds) * 1000, F.lit(1000.0))


def is_challenge(status: Column, title: Column, server: Column, mitigated: Column, markup: Column) -> Column:
    """Does an answer hold a bot check instead of the page?"""
    return (
        (F.lower(F.coalesce(mitigated, F.lit(""))) == "challenge")
        | F.coalesce(markup, F.lit(False))
        | F.coalesce(title, F.lit("")).rlike("(?i)just a moment|attention required|een moment geduld")
        | (F.coalesce(status.isin(403, 503), F.lit(False)) & F.coalesce(server, F.lit("")).rlike("(?i)cloudflare"))
    )


def conflict_marker(text: Column, markdown: Column) -> tuple[Column, Column]:
    """(number from 1, line) of the first conflict marker of a text; a bare ======= counts in Markdown only beside others."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda l: F.regexp_replace(l, "\r$", ""))
    outer = "^(<{7}|>{7})(\\s|$)"
    any_ = F.exists(lines, lambda l: l.rlike(outer))
    hits = F.filter(F.transform(lines, lambda l, i: F.when(l.rlike(outer) | (l.rlike("^={7}$") & (~markdown | any_)), F.struct((i + 1).alias("regel"), l.alias("tekst")))), lambda x: x.isNotNull())
    first = F.get(hits, F.lit(0))
    return first["regel"], first["tekst"]


def is_network_error(error: Column) -> Column:
    return F.coalesce(error, F.lit("")).rlike("(?i)net::ERR_|ECONNRESET|ECONNREFUSED|ENOTFOUND|ETIMEDOUT|EAI_AGAIN|fetch failed|socket hang up")


def button_status(text: Column) -> Column:
    """Availability from the text of a ticket button; null for rows to leave out (over, or sold elsewhere)."""
    t = F.lower(X.strip(F.coalesce(text, F.lit(""))))
    has = lambda *words: F.greatest(*[F.contains(t, F.lit(w)) for w in words], F.lit(False))
    gone = cancelled_status(text)
    return (
        F.when(t == "", "onbekend")
        .when(has("geweest"), None)
        .when(gone.isNotNull(), gone)
        .when(has("verkoop elders", "via theater"), None)
        .when(has("uitverkocht", "volgeboekt"), "uitverkocht")
        .when(has("wachtlijst"), "wachtlijst")
        .when(has("kaarten", "tickets", "bestel", "aanmelden", "gratis", "losse plekken"), "beschikbaar")
        .otherwise("onbekend")
    )


def ticket_status(text: Column, css_class: Column) -> Column:
    """Availability from a ticket text and the class of its element."""
    t = F.lower(F.concat_ws(" ", text, css_class))
    gone = cancelled_status(text)
    return F.when(gone.isNotNull(), gone).when(t.rlike("uitverkocht|soldout|sold-out"), "uitverkocht").when(t.rlike("wachtlijst|waitinglist"), "wachtlijst").when(t.rlike("ticket|laatstekaarten|bestel"), "beschikbaar").otherwise("onbekend")


def shown_status(listed: Column, web: Column, system: Column) -> Column:
    """What a site shows of three statuses: of its list, its web pages and its ticket system."""
    return (
        F.when((listed == "geannuleerd") | (system == "geannuleerd"), "geannuleerd")
        .when(system == "geweest", "geweest")
        .when((listed == "reserveren") & (F.coalesce(web, F.lit("")) != ""), web)
        .when(listed == "reserveren", F.coalesce(system, listed))
        .when((listed == "uitverkocht") & (system == "wachtlijst"), "wachtlijst")
        .when((listed == "uitverkocht") | (system == "uitverkocht"), "uitverkocht")
        .otherwise(listed)
    )


def data_layer(html: DataFrame, id: str, column: str = "html") -> DataFrame:
    """id, item, naam, prijs, genre, zaal, datum of products in a page's inline analytics; the first of an item counts."""
    text = "\"((?:[^\"\\\\]|\\\\.)*)\""
    pattern = f"item_name: {text},\\s*item_id: (\\d+),\\s*price: ([\\d.]+),\\s*quantity: 1,(?:\\s*index: \\d+,)?\\s*item_category: {text},\\s*item_category2: {text},\\s*item_category3: {text}"
    groups = [F.regexp_extract_all(column, F.lit(pattern), F.lit(g)) for g in range(1, 7)]
    rows = html.select(id, F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("naam", "item", "prijs", "genre", "zaal", "datum"))])).alias("pos", "x")).select(id, "pos", "x.*")
    first = rows.groupBy(id, "item").agg(F.min_by(F.struct("naam", "prijs", "genre", "zaal", "datum"), "pos").alias("x"))
    return first.select(id, "item", "x.naam", F.col("x.prijs").cast("double").alias("prijs"), "x.genre", "x.zaal", "x.datum")
