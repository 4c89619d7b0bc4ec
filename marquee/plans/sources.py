"""Queries on pages, listings and lists of dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import dating as T
from ..sources import crawl as C
from .shows import table

DAY = date(1998, 2, 10)
RULES = (("com", "disallow", "/en/"), ("com", "allow", "/en/4"), ("com", "disallow", "*.html$"), ("net", "disallow", "/"), ("net", "allow", "/fr/*?page="), ("org", "disallow", ""), ("org", "disallow", "/es/6"), ("org", "allow", "/es/6"))
ROBOTS = "# all\nUser-agent: *\nDisallow: /en/\nCrawl-delay: 5\n\nUser-agent: OtherBot\nUser-Agent: marquee\nAllow: /fr/ # note\nDisallow: /\n"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, site (last label of the host) and path with query."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return p.select("page_id", "url", "html", F.substring_index(host, ".", -1).alias("site"), F.regexp_extract("url", "://[^/?#]*([^#]*)", 1).alias("path"))


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "site string, kind string, pattern string")
    return C.robots_allowed(_pages(spark, sf_dir).select("page_id", "site", "path"), rules).select("page_id", "allowed")


def robots_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _pages(spark, sf_dir).select("site").distinct().withColumn("text", F.lit(ROBOTS))
    chosen = C.group_for(C.robots_groups(sites), "Marquee/1.0")
    return chosen.select("site", F.col("groep").cast("long").alias("groep"), F.size("rules").alias("n"), F.col("rules")[0]["pattern"].alias("eerste"))


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of English pages from sitemaps made of the pages' urls."""
    xml = _pages(spark, sf_dir).select(F.concat(F.lit("<url><loc> "), F.regexp_replace("url", "[?#].*", ""), F.lit(" </loc></url><url><loc>https://a.b/en/koop-ticket</loc></url>")).alias("xml"))
    return C.sitemap_urls(xml, "xml", "/en/[^/?#]+$", "/en/koop-ticket$")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.links(table(spark, sf_dir, "pages"), "html", "page_id")


def event_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from JSON-LD put into pages: two events, something else, and a broken script."""
    p = table(spark, sf_dir, "pages").select("page_id")
    day = lambda n: F.date_add(F.lit("2026-01-01"), ((F.col("page_id") * n) % 365).cast("int")).cast("string")
    html = F.concat(F.lit('<script type="application/ld+json">[{"@type":"TheaterEvent","startDate":"'), day(7), F.lit('"},{"@type":"Place","startDate":"x"}]</script><script type="application/ld+json">{"@type":"Event","startDate":"'), day(3), F.lit('"}</script><script type="application/ld+json">{oops</script>'))
    return p.select("page_id", C.event_starts(html).alias("starts"))


def data_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    item = lambda price: F.concat(F.lit('item_name: "'), "p_name", F.lit('", item_id: '), F.col("p_size").cast("string"), F.lit(", price: "), F.lit(price), F.lit(', quantity: 1, item_category: "'), "p_type", F.lit('", item_category2: "zaal", item_category3: "2026-10-10"'))
    return C.data_layer(p.select("p_partkey", F.concat(item("12.50"), F.lit(" } { "), item("99")).alias("html")), "p_partkey").select("p_partkey", "item", "naam", "prijs", "genre")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as paged listings: ten a page, keys repeat."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("site"), F.floor((F.col("o_orderkey") % 300) / 10).alias("page"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") * 7 % 60).alias("key"))
    return C.new_items(rows)[0]


def listing_from_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings of sites that have a page 1, read from there on, twenty pages of each at most."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("site"), F.floor((F.col("o_orderkey") % 300) / 10).alias("page"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") * 7 % 60).alias("key"))
    return C.listing_from_one(rows, rows.filter("page = 1").select("site"), 20)[0]


def conflict_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    text = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, "\n<<<<<<< HEAD\r\nx").when(k == 1, "\n=======\n").otherwise(""))
    number, line = C.conflict_marker(text, F.col("doc_id") % 8 == 1)
    return d.select("doc_id", number.alias("regel"), line.alias("tekst"))


def source_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    words = ["Bestel kaarten", "Uitverkocht", "Wachtlijst", "Geweest", "Verkoop elders", "Afgelast", "", "Info", "Via theater X", "LAATSTE TICKETS"]
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("o_orderkey") / n) % len(values) + 1).cast("int"))
    text = pick(words, 1)
    listed, web, system = pick(["reserveren", "uitverkocht", "geannuleerd", "info"], 1), pick([None, "binnenkort"], 4), pick([None, "wachtlijst", "uitverkocht", "geweest", "geannuleerd"], 8)
    return o.select("o_orderkey", C.button_status(text).alias("knop"), C.ticket_status(text, pick(["", "soldout"], 10)).alias("kaart"), C.shown_status(listed, web, system).alias("getoond"))


def crawl_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", C.crawl_delay_ms(F.col("s_acctbal"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") - 20)).alias("ms"))


def challenge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    return p.select("page_id", C.is_challenge(F.when(k % 5 == 0, 503).otherwise(200), F.when(k % 7 == 0, "Just a moment...").otherwise("x"), F.when(k % 2 == 0, "Cloudflare"), F.when(k % 11 == 0, "Challenge"), F.lit(None).cast("boolean")).alias("controle"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("lijst"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "view", "").alias("dagTekst"))
    return T.carry_forward(rows, "dagTekst")


def year_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of customers' orders in order of their number, written without a year (some with one)."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    label = F.concat(F.element_at(D.names(D.WEEKDAYS), D.iso_weekday(F.col("d"))), F.lit(" "), F.dayofmonth("d").cast("string"), F.lit(" "), F.element_at(D.names(D.MONTHS), F.month("d")))
    k = F.col("o_orderkey")
    label = F.when(k % 7 == 0, F.concat(label, F.lit(" "), F.year("d").cast("string"))).when(k % 11 == 0, " Vandaag ").when(k % 13 == 0, "MORGEN").when(k % 17 == 0, "onbekend").otherwise(F.initcap(label))
    rows = o.select((F.col("o_custkey") % 300).alias("lijst"), k.alias("pos"), label.alias("label"))
    return T.long_dates(rows, DAY).select("lijst", "pos", "datum")


def month_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    rows = o.select((F.col("o_custkey") % 300).alias("lijst"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("za "), F.dayofmonth("d").cast("string"), F.lit("-"), F.month("d").cast("string"))).otherwise("n.n.b.").alias("dag"), F.lit("aanvang 9.30 uur").alias("uur"), F.lit(DAY).alias("eerste"))
    return T.month_rollover(rows).select("lijst", "pos", "datum", "tijd")


def short_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    rows = o.select((F.col("o_custkey") % 300).alias("lijst"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace(D.day_text(F.col("d")), "^.. ", "")).otherwise(D.day_text(F.col("d"))).alias("label"))
    return T.short_dates(rows, DAY)


def numeric_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    text = F.concat(F.lpad(F.dayofmonth("d").cast("string"), 2, "0"), F.lit("."), F.lpad(F.month("d").cast("string"), 2, "0"))
    rows = o.select((F.col("o_custkey") % 300).alias("lijst"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 3 == 0, text).otherwise(F.concat(F.initcap(F.element_at(D.names(D.SHORT_WEEKDAYS), D.iso_weekday(F.col("d")))), F.lit(" "), text)).alias("label"))
    return T.numeric_dates(rows, DAY)


def date_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    texts = ["4 t/m 7 & 11, 12 nov, 3 jan", "30 okt t/m 2 nov", "7, 8 oktober 9, 10 oktober", "25 t/m 29 november", "datum volgt", "1, 2 & 3 mrt, 31 dec - 2 jan"]
    return p.select("p_partkey", T.date_list(F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % len(texts) + 1).cast("int")), DAY).alias("data"))


def amsterdam_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day, time = D.from_unix(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000) + F.col("event_id") * 3600)
    return e.select("event_id", day.alias("datum"), time.alias("tijd"))


QUERIES = {
    f.__name__: f
    for f in (
        robots_allowed, robots_group, sitemap_urls, page_links, event_starts, data_layer, listing_pages, listing_from_one, conflict_marker, source_statuses, crawl_delay, challenge_pages, carry_forward, year_rollover, month_rollover,
        short_dates, numeric_dates, date_lists, amsterdam_time,
    )
}

_SITE = "pages0 AS (SELECT page_id, url, html, string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[-1] AS site, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages)"
_CANC = "CASE WHEN regexp_matches({0}, 'verplaatst|postponed|rescheduled') THEN 'verplaatst' WHEN regexp_matches({0}, 'geannuleerd|afgelast|gecancel?d|cancel?led|gaat niet door') THEN 'afgelast' END".format("lower(t)")
_MONTHS = "[" + ", ".join(f"'{m}'" for m in D.MONTHS) + "]"

_LISTED = """e AS (SELECT o_custkey % 300 AS lijst, o_orderkey AS pos, month(d) AS m, day(d) AS dd, CASE WHEN o_orderkey % 3 <> 0 THEN isodow(d) END AS wd, row_number() OVER (PARTITION BY o_custkey % 300 ORDER BY o_orderkey) AS i FROM (SELECT *, o_orderdate::DATE AS d FROM orders)),
q AS (SELECT 0::BIGINT AS i, lijst, NULL::BIGINT AS pos, 1998::BIGINT AS jaar, 2::BIGINT AS maand, NULL::BIGINT AS eigen, NULL::BIGINT AS m, NULL::BIGINT AS dd FROM (SELECT DISTINCT lijst FROM e)
 UNION ALL SELECT i, lijst, pos, {jaar}, {maand}, eigen, m, dd FROM (SELECT *, CASE WHEN wd IS NOT NULL AND isodow(make_date(y, m, 1) + (dd - 1)::INT) <> wd AND isodow(make_date(ander, m, 1) + (dd - 1)::INT) = wd THEN ander ELSE y END AS eigen FROM (SELECT *, {ander} AS ander
 FROM (SELECT e.*, jaar, maand, CASE WHEN e.m < maand THEN jaar + 1 ELSE jaar END AS y FROM q JOIN e ON e.lijst = q.lijst AND e.i = q.i + 1))))
SELECT lijst, pos, TRY_CAST(eigen || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') AS DATE) AS datum FROM q WHERE i > 0"""

ORACLE_SQL = {
    "robots_allowed": f"""WITH {_SITE}, r(site, kind, pattern) AS (VALUES {', '.join(repr(r) for r in RULES)}), q AS (SELECT *, '^' || replace(regexp_replace(CASE WHEN ends_with(pattern, '$') THEN pattern[:-2] ELSE pattern END, '([.+?])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END AS re FROM r WHERE NOT (kind = 'disallow' AND pattern = '')),
b AS (SELECT page_id, arg_max(kind, (length(pattern), kind = 'allow')) AS k FROM pages0 JOIN q USING (site) WHERE regexp_matches(path, re) GROUP BY 1) SELECT page_id, coalesce(k = 'allow', true) AS allowed FROM pages0 LEFT JOIN b USING (page_id)""",
    "robots_group": f"WITH {_SITE} SELECT DISTINCT site, 2::BIGINT AS groep, 2::INT AS n, '/fr/' AS eerste FROM pages0",
    "sitemap_urls": f"WITH {_SITE} SELECT DISTINCT regexp_replace(url, '[?#].*', '') AS url FROM pages0 WHERE regexp_matches(regexp_replace(url, '[?#].*', ''), '/en/[^/?#]+$')",
    "page_links": "WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM h GROUP BY 1, 2",
    "event_starts": "SELECT page_id, list_sort([(DATE '2026-01-01' + (page_id * 7 % 365)::INT)::VARCHAR, (DATE '2026-01-01' + (page_id * 3 % 365)::INT)::VARCHAR]) AS starts FROM pages",
    "data_layer": "SELECT p_partkey, p_size::VARCHAR AS item, p_name AS naam, 12.5::DOUBLE AS prijs, p_type AS genre FROM part",
    "listing_pages": """WITH r AS (SELECT o_custkey % 20 AS site, (o_orderkey % 300) // 10 AS page, o_orderkey AS pos, o_orderkey * 7 % 60 AS key FROM orders),
f AS (SELECT site, key, min((page, pos)) AS x FROM r GROUP BY 1, 2), p AS (SELECT DISTINCT site, page FROM r), s AS (SELECT site, min(page) AS stop FROM p WHERE NOT EXISTS (FROM f WHERE f.site = p.site AND f.x[1] = p.page) GROUP BY 1)
SELECT f.site, key, x[1] AS page, x[2] AS pos FROM f LEFT JOIN s USING (site) WHERE stop IS NULL OR x[1] < stop""",
    "listing_from_one": """WITH r AS (SELECT o_custkey % 20 AS site, (o_orderkey % 300) // 10 AS page, o_orderkey AS pos, o_orderkey * 7 % 60 AS key FROM orders WHERE (o_orderkey % 300) // 10 BETWEEN 1 AND 20 AND o_custkey % 20 IN (SELECT o_custkey % 20 FROM orders WHERE (o_orderkey % 300) // 10 = 1)),
f AS (SELECT site, key, min((page, pos)) AS x FROM r GROUP BY 1, 2), p AS (SELECT DISTINCT site, page FROM r), s AS (SELECT site, min(page) AS stop FROM p WHERE NOT EXISTS (FROM f WHERE f.site = p.site AND f.x[1] = p.page) GROUP BY 1)
SELECT f.site, key, x[1] AS page, x[2] AS pos FROM f LEFT JOIN s USING (site) WHERE stop IS NULL OR x[1] < stop""",
    "conflict_marker": """WITH d AS (SELECT doc_id, doc_id % 8 = 1 AS md, string_split(coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN chr(10) || '<<<<<<< HEAD' || chr(13) || chr(10) || 'x' WHEN 1 THEN chr(10) || '=======' || chr(10) ELSE '' END, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, md, unnest(range(1, len(l) + 1)) AS n, regexp_replace(unnest(l), '\\r$', '') AS t FROM d), a AS (SELECT *, bool_or(regexp_matches(t, '^(<{7}|>{7})(\\s|$)')) OVER (PARTITION BY doc_id) AS o FROM e),
h AS (SELECT doc_id, min(n) AS n, arg_min(t, n) AS t FROM a WHERE regexp_matches(t, '^(<{7}|>{7})(\\s|$)') OR (t = '=======' AND (NOT md OR o)) GROUP BY 1) SELECT d.doc_id, h.n::INT AS regel, h.t AS tekst FROM d LEFT JOIN h USING (doc_id)""",
    "source_statuses": f"""WITH o AS (SELECT o_orderkey AS k, ['Bestel kaarten', 'Uitverkocht', 'Wachtlijst', 'Geweest', 'Verkoop elders', 'Afgelast', '', 'Info', 'Via theater X', 'LAATSTE TICKETS'][(o_orderkey % 10 + 1)::INT] AS t, ['', 'soldout'][(o_orderkey // 10 % 2 + 1)::INT] AS c,
 ['reserveren', 'uitverkocht', 'geannuleerd', 'info'][(o_orderkey % 4 + 1)::INT] AS l, [NULL, 'binnenkort'][(o_orderkey // 4 % 2 + 1)::INT] AS w, [NULL, 'wachtlijst', 'uitverkocht', 'geweest', 'geannuleerd'][(o_orderkey // 8 % 5 + 1)::INT] AS s FROM orders)
SELECT k AS o_orderkey, CASE WHEN t = '' THEN 'onbekend' WHEN t = 'Geweest' THEN NULL WHEN {_CANC} IS NOT NULL THEN {_CANC} WHEN t IN ('Verkoop elders', 'Via theater X') THEN NULL WHEN t = 'Uitverkocht' THEN 'uitverkocht' WHEN t = 'Wachtlijst' THEN 'wachtlijst' WHEN regexp_matches(lower(t), 'kaarten|tickets|bestel') THEN 'beschikbaar' ELSE 'onbekend' END AS knop,
 CASE WHEN {_CANC} IS NOT NULL THEN {_CANC} WHEN t = 'Uitverkocht' OR c = 'soldout' THEN 'uitverkocht' WHEN t = 'Wachtlijst' THEN 'wachtlijst' WHEN regexp_matches(lower(t), 'ticket|bestel') THEN 'beschikbaar' ELSE 'onbekend' END AS kaart,
 CASE WHEN l = 'geannuleerd' OR s = 'geannuleerd' THEN 'geannuleerd' WHEN s = 'geweest' THEN 'geweest' WHEN l = 'reserveren' AND w IS NOT NULL THEN w WHEN l = 'reserveren' THEN coalesce(s, l) WHEN l = 'uitverkocht' AND s = 'wachtlijst' THEN 'wachtlijst' WHEN l = 'uitverkocht' OR s = 'uitverkocht' THEN 'uitverkocht' ELSE l END AS getoond FROM o""",
    "crawl_delay": "SELECT s_suppkey, greatest(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey > 20 THEN (s_suppkey - 20) * 1000 ELSE 0 END, 1000)::DOUBLE AS ms FROM supplier",
    "challenge_pages": "SELECT page_id, page_id % 11 = 0 OR page_id % 7 = 0 OR page_id % 10 = 0 AS controle FROM pages",
    "carry_forward": "WITH e AS (SELECT user_id AS lijst, event_id AS pos, CASE WHEN event_type = 'click' THEN props END AS d FROM events) SELECT lijst, pos, coalesce(d, last_value(d IGNORE NULLS) OVER (PARTITION BY lijst ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS \"dagTekst\" FROM e",
    "year_rollover": """WITH o AS (SELECT o_custkey % 300 AS lijst, o_orderkey AS pos, o_orderdate::DATE AS d FROM orders),
k AS (SELECT *, CASE WHEN pos % 7 = 0 THEN 'jaar' WHEN pos % 11 = 0 THEN 'vandaag' WHEN pos % 13 = 0 THEN 'morgen' WHEN pos % 17 = 0 THEN 'geen' ELSE 'dag' END AS s FROM o),
m AS (SELECT *, CASE WHEN s IN ('jaar', 'dag') THEN month(d) END AS m, CASE WHEN s = 'jaar' THEN year(d) END AS y FROM k),
l AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY lijst ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS vorige FROM m),
u AS (SELECT *, sum(CASE WHEN s = 'dag' AND m < vorige THEN 1 ELSE 0 END) OVER (PARTITION BY lijst ORDER BY pos) AS ups FROM l),
z AS (SELECT *, coalesce(last_value(CASE WHEN y IS NOT NULL THEN y - ups END IGNORE NULLS) OVER (PARTITION BY lijst ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1998) + ups AS jaar FROM u)
SELECT lijst, pos, CASE s WHEN 'vandaag' THEN DATE '1998-02-10' WHEN 'morgen' THEN DATE '1998-02-11' WHEN 'geen' THEN NULL ELSE TRY_CAST(jaar::INT || '-' || lpad(month(d)::VARCHAR, 2, '0') || '-' || lpad(day(d)::VARCHAR, 2, '0') AS DATE) END AS datum FROM z""",
    "month_rollover": """WITH o AS (SELECT o_custkey % 300 AS lijst, o_orderkey AS pos, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 9 <> 0),
u AS (SELECT *, CASE WHEN month(d) < coalesce(lag(month(d)) OVER (PARTITION BY lijst ORDER BY pos), 2) THEN 1 ELSE 0 END AS terug FROM o), j AS (SELECT *, 1998 + sum(terug) OVER (PARTITION BY lijst ORDER BY pos) AS jaar FROM u)
SELECT lijst, pos, TRY_CAST(jaar::INT || '-' || lpad(month(d)::VARCHAR, 2, '0') || '-' || lpad(day(d)::VARCHAR, 2, '0') AS DATE) AS datum, '09:30' AS tijd FROM j""",
    "short_dates": "WITH RECURSIVE " + _LISTED.format(jaar="greatest(eigen, jaar)", maand="CASE WHEN eigen > jaar OR m >= maand THEN m ELSE maand END", ander="CASE WHEN y = jaar THEN jaar + 1 ELSE jaar END"),
    "numeric_dates": "WITH RECURSIVE " + _LISTED.format(jaar="eigen", maand="m", ander="y + 1"),
    "date_lists": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ['1998-11-04', '1998-11-05', '1998-11-06', '1998-11-07', '1998-11-11', '1998-11-12', '1999-01-03'] WHEN 1 THEN ['1998-10-30', '1998-10-31', '1998-11-01', '1998-11-02'] WHEN 2 THEN ['1998-10-07', '1998-10-08', '1998-10-09', '1998-10-10']
 WHEN 3 THEN ['1998-11-25', '1998-11-26', '1998-11-27', '1998-11-28', '1998-11-29'] WHEN 4 THEN []::VARCHAR[] ELSE ['1998-03-01', '1998-03-02', '1998-03-03', '1998-12-31', '1999-01-01', '1999-01-02'] END AS data FROM part""",
    "amsterdam_time": "SELECT event_id, timezone('Europe/Amsterdam', to_timestamp(floor(epoch_ms(ts) / 1000) + event_id * 3600))::DATE AS datum, strftime(timezone('Europe/Amsterdam', to_timestamp(floor(epoch_ms(ts) / 1000) + event_id * 3600)), '%H:%M') AS tijd FROM events",
}
