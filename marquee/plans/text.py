"""Text queries: each function of ``functions.text`` and ``functions.values`` on parts, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from .shows import sql_key, sql_noise, sql_norm, sql_parts, table
from .shows import shows as read_shows


def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("titel")
    rows = read_shows(spark, sf_dir).select("titel").distinct()
    return rows.select("titel", X.normal_title(t).alias("norm"), X.slug(t).alias("slug"), X.search_form(t).alias("zoekvorm"), X.one_dash(t).alias("dash"), X.without_noise(t).alias("ruisvrij"), X.capitals(t).alias("hoofdletters"))


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("titel")
    rows = read_shows(spark, sf_dir).select("titel").distinct()
    return rows.select("titel", X.title_parts(t).alias("delen"), X.wide_title(t).alias("ruim"), X.production_key(t, F.lit("v1")).alias("sleutel"), F.replace(X.form_key(t), F.lit("\x00"), F.lit("/")).alias("vorm"))


def display_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir).select("titel", "maker").distinct()
    return rows.select("titel", "maker", X.display_title(F.col("titel"), F.col("maker")).alias("weergave"))


def labels_from_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir).select("titel").distinct().select(F.explode(F.array("titel", F.concat("titel", F.lit(" – Première")), F.concat(F.lit("X (reprise) & "), "titel"))).alias("titel"))
    text, labels = X.labels_from_title(F.col("titel"))
    return rows.select("titel", text.alias("tekst"), labels.alias("labels"))


def status_from_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    forms = F.array(
        F.concat("p_name", F.lit(" – UITVERKOCHT!")), F.concat(F.lit("Afgelast | "), "p_name"), F.concat("p_name", F.lit(" (bijna uitverkocht)")), F.concat("p_name", F.lit(" - wachtlijst - "), "p_name"), F.col("p_name")
    )
    rows = p.select(F.explode(forms).alias("titel"))
    text, status = X.status_from_title(F.col("titel"))
    return rows.select("titel", text.alias("tekst"), status.alias("status"), X.without_status_word(F.col("titel")).alias("zonder"))


def series_from_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    rows = p.select(F.concat(F.initcap("p_type"), F.lit(": "), "p_name").alias("titel"))
    text, series = X.series_from_title(F.col("titel"), ["Economy", "promo", "Small"])
    return rows.select("titel", text.alias("tekst"), series.alias("reeks"))


def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.redacted(F.col("text")).alias("tekst"))


def error_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.error_line(F.col("text")).alias("fout"))


def lowest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.concat(
        F.lit("Rang 1 € "), F.floor(F.col("o_totalprice") / 100).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ",50").when(F.col("o_orderkey") % 3 == 1, ",-").otherwise(""),
        F.lit(" of € 1.250,75"), F.when(F.col("o_orderkey") % 2 == 0, " Extra kosten € 1,00").otherwise(""),
    )
    text = F.when(F.col("o_orderkey") % 7 == 0, "toegang gratis").when(F.col("o_orderkey") % 11 == 0, "prijs volgt").otherwise(text)
    return o.select("o_orderkey", V.lowest_price(text).alias("prijs"))


def extract_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", V.first_time(F.col("text")).alias("tijd"))


def availability_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    words = ["Verplaatst naar 3 mei", "Geannuleerd", "Bestel kaarten", "gaat niet door", "", "Rescheduled"]
    text = F.element_at(F.array(*map(F.lit, words)), (F.col("o_orderkey") % len(words) + 1).cast("int"))
    return o.select("o_orderkey", V.cancelled_status(text).alias("status"))


def genre_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    raw = F.concat(F.initcap("p_type"), F.lit(" & "), F.split("p_name", " ")[1], F.lit(" en "), F.split("p_name", " ")[0])
    return n.select(raw.alias("label"), V.genre_key(raw).alias("sleutel"))


def not_a_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    heads = ["Workshop ", "Danscursus ", "Pubquiz ", "Openbare rondleiding ", "Filmvertoning ", "", "Grote quizmaster ", "Kijkje achter de schermen: "]
    tags = ["Film", "Drama, film", "Theater, Film", "Workshop", "Horror; film", "Dans", ""]
    title = F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("p_partkey") % len(heads) + 1).cast("int")), "p_name")
    tag = F.element_at(F.array(*map(F.lit, tags)), (F.floor(F.col("p_partkey") / 8) % len(tags) + 1).cast("int"))
    return p.select("p_partkey", V.not_a_show(title, tag).alias("soort"))


def price_ceiling_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir)
    return rows.groupBy("theaterId").agg(
        F.count(F.when(F.col("podiumpas"), 1)).alias("n_ja"), F.count(F.when(~F.col("podiumpas"), 1)).alias("n_nee"), F.count(F.when(F.col("podiumpas").isNull(), 1)).alias("n_onbekend")
    )


QUERIES = {
    "title_forms": title_forms,
    "title_keys": title_keys,
    "display_title": display_title,
    "labels_from_title": labels_from_title,
    "status_from_title": status_from_title,
    "series_from_title": series_from_title,
    "redact_pii": redact_pii,
    "error_line": error_line,
    "lowest_price": lowest_price,
    "extract_time": extract_time,
    "availability_text": availability_text,
    "genre_keys": genre_keys,
    "not_a_show": not_a_show,
    "price_ceiling_pass": price_ceiling_pass,
}

from .shows import SHOW_SQL  # noqa: E402

_SALES = """CASE WHEN regexp_matches({0}, '^(?:uitverkocht|sold[ -]?out)$', 'i') THEN 'uitverkocht'
 WHEN regexp_matches({0}, '^(?:laatste (?:kaarten|plaatsen|tickets)|bijna uitverkocht|nog enkele kaarten)$', 'i') THEN 'beschikbaar'
 WHEN regexp_matches({0}, '^wachtlijst$', 'i') THEN 'wachtlijst'
 WHEN regexp_matches({0}, '^(?:geannuleerd|afgelast|gecancel?d|cancel?led)$', 'i') THEN 'afgelast'
 WHEN regexp_matches({0}, '^verplaatst$', 'i') THEN 'verplaatst' END"""


def _sales(x: str) -> str:
    return _SALES.format(f"trim(regexp_replace({x}, '[.!…]+$', ''))")


_LABEL = "((?:voor)?premi[eè]re|try[- ]?out|reprise)"

ORACLE_SQL = {
    "title_forms": SHOW_SQL
    + f""", t AS (SELECT DISTINCT titel FROM perf0)
SELECT titel, {sql_norm('titel')} AS norm, regexp_replace(regexp_replace(strip_accents(lower(titel)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
 trim(regexp_replace(strip_accents(lower(titel)), '\\s+', ' ', 'g')) AS zoekvorm, regexp_replace(titel, '\\s+[-|]\\s+', ' – ', 'g') AS dash, {sql_noise('titel')} AS ruisvrij,
 length(regexp_replace(titel, '\\P{{Lu}}', '', 'g'))::INT AS hoofdletters FROM t""",
    "title_keys": SHOW_SQL
    + f""", t AS (SELECT DISTINCT titel FROM perf0)
SELECT titel, {sql_parts('titel')} AS delen, array_to_string({sql_parts('titel')}, ' | ') AS ruim, {sql_key('titel', "'v1'")} AS sleutel,
 array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(titel, '\\s+[–—-]\\s+|\\s+\\|\\s+|:\\s+'), lambda d: lower(trim(regexp_replace(d, '\\s+', ' ', 'g')))), lambda d: d <> '')), '/') AS vorm FROM t""",
    "display_title": SHOW_SQL
    + f""", t AS (SELECT DISTINCT titel, maker FROM perf0)
SELECT titel, maker, CASE WHEN maker IS NULL OR contains(' ' || {sql_norm('titel')} || ' ', ' ' || {sql_norm('maker')} || ' ') THEN titel ELSE titel || ' – ' || maker END AS weergave FROM t""",
    "labels_from_title": SHOW_SQL
    + f""", t AS (SELECT unnest([titel, titel || ' – Première', 'X (reprise) & ' || titel]) AS titel FROM (SELECT DISTINCT titel FROM perf0)),
a AS (SELECT titel, regexp_replace(titel, '\\s*\\(\\s*{_LABEL}\\s*\\)', '', 'gi') AS once FROM t)
SELECT titel, trim(regexp_replace(regexp_replace(once, '\\s+[–—|-]\\s+{_LABEL}\\s*$', '', 'gi'), '\\s{{2,}}', ' ', 'g')) AS tekst,
 [x FOR x IN [CASE WHEN regexp_matches(titel, '\\(reprise\\)') THEN 'reprise' END, CASE WHEN regexp_matches(titel, '\\(try-out\\)') THEN 'try-out' END,
  CASE WHEN regexp_matches(once, '\\s–\\sPremière$') THEN 'première' END] IF x IS NOT NULL] AS labels FROM a""",
    "status_from_title": f"""WITH p AS (SELECT DISTINCT p_name FROM part), t AS (SELECT unnest([p_name || ' – UITVERKOCHT!', 'Afgelast | ' || p_name, p_name || ' (bijna uitverkocht)', p_name || ' - wachtlijst - ' || p_name, p_name]) AS titel FROM p),
a AS (SELECT titel, regexp_split_to_array(titel, '\\s+[-–|]\\s+') AS d, regexp_extract(titel, '^(.*\\S)\\s*\\(([^()]+)\\)$', 2) AS b FROM t)
SELECT titel, CASE WHEN {_sales('b')} IS NOT NULL THEN regexp_extract(titel, '^(.*\\S)\\s*\\(([^()]+)\\)$', 1)
  WHEN len(d) > 1 AND {_sales('d[-1]')} IS NOT NULL THEN array_to_string(d[:-2], ' – ')
  WHEN len(d) > 1 AND {_sales('d[1]')} IS NOT NULL THEN array_to_string(d[2:], ' – ') ELSE titel END AS tekst,
 CASE WHEN {_sales('b')} IS NOT NULL THEN {_sales('b')} WHEN len(d) > 1 THEN coalesce({_sales('d[-1]')}, {_sales('d[1]')}) END AS status,
 trim(regexp_replace(titel, '^(?:geannuleerd|afgelast|verplaatst)\\s+[-–|]\\s+', '', 'i')) AS zonder FROM a""",
    "series_from_title": """WITH p AS (SELECT DISTINCT p_name, p_type FROM part), t AS (SELECT upper(p_type[1]) || lower(p_type[2:]) || ': ' || p_name AS titel, p_name, p_type FROM p)
SELECT titel, CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN p_name ELSE titel END AS tekst, CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'SMALL') THEN upper(p_type[1]) || lower(p_type[2:]) END AS reeks FROM t""",
    "redact_pii": """WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+', '[e-mail]', 'g'), '(?:\\+|\\b0)[0-9][0-9\\s-]{7,}[0-9]', '[telefoon]', 'g'), '\\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 300 THEN x[1:300] || '…' ELSE x END AS tekst FROM a""",
    "error_line": """WITH a AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 200 THEN x[1:199] || '…' ELSE x END AS fout FROM a""",
    "lowest_price": """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'toegang gratis' WHEN o_orderkey % 11 = 0 THEN 'prijs volgt' ELSE
 'Rang 1 € ' || floor(o_totalprice / 100)::BIGINT || CASE o_orderkey % 3 WHEN 0 THEN ',50' WHEN 1 THEN ',-' ELSE '' END || ' of € 1.250,75' || CASE WHEN o_orderkey % 2 = 0 THEN ' Extra kosten € 1,00' ELSE '' END END AS x FROM orders),
a AS (SELECT o_orderkey, regexp_split_to_array(x, '(?i)extra kosten|servicekosten')[1] AS x FROM t),
b AS (SELECT o_orderkey, x, list_transform(regexp_extract_all(x, '€\\s*(\\d+(?:\\.\\d{3})*(?:[,.]\\d{2})?)', 1), lambda v: CASE WHEN regexp_matches(v, '[,.]\\d{2}$') THEN replace(v[:-4], '.', '') || '.' || v[-2:] ELSE replace(v, '.', '') END::DOUBLE) AS v FROM a)
SELECT o_orderkey, CASE WHEN len(v) > 0 THEN list_min(v) WHEN regexp_matches(x, 'gratis', 'i') THEN 0.0::DOUBLE END AS prijs FROM b""",
    "extract_time": """SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\\d{1,2}[:.]\\d{2}') THEN lpad(regexp_extract(text, '(\\d{1,2})[:.](\\d{2})', 1), 2, '0') || ':' || regexp_extract(text, '(\\d{1,2})[:.](\\d{2})', 2) END AS tijd FROM documents""",
    "availability_text": """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'verplaatst' WHEN 1 THEN 'afgelast' WHEN 3 THEN 'afgelast' WHEN 5 THEN 'verplaatst' END AS status FROM orders""",
    "genre_keys": """WITH t AS (SELECT DISTINCT upper(p_type[1]) || lower(p_type[2:]) || ' & ' || split_part(p_name, ' ', 2) || ' en ' || split_part(p_name, ' ', 1) AS label FROM part)
SELECT label, array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower(trim(label)), '\\s*(?:&|/|,|\\+|\\s+en\\s+)\\s*'), lambda p: trim(p)), lambda p: p <> '')), ' & ') AS sleutel FROM t""",
    "not_a_show": """WITH t AS (SELECT p_partkey, ['Workshop ', 'Danscursus ', 'Pubquiz ', 'Openbare rondleiding ', 'Filmvertoning ', '', 'Grote quizmaster ', 'Kijkje achter de schermen: '][(p_partkey % 8 + 1)::INT] AS h,
 ['film', 'drama, film', 'theater, film', 'workshop', 'horror; film', 'dans', ''][(p_partkey // 8 % 7 + 1)::INT] AS g FROM part)
SELECT p_partkey, CASE WHEN h IN ('Workshop ', 'Danscursus ') OR g = 'workshop' THEN 'workshop' WHEN g IN ('film', 'drama, film', 'horror; film') OR h = 'Filmvertoning ' THEN 'film'
 WHEN h IN ('Openbare rondleiding ', 'Kijkje achter de schermen: ') THEN 'rondleiding' WHEN h = 'Pubquiz ' THEN 'quiz' END AS soort FROM t""",
    "price_ceiling_pass": SHOW_SQL + "SELECT theaterId, count(*) FILTER (podiumpas) AS n_ja, count(*) FILTER (NOT podiumpas) AS n_nee, count(*) FILTER (podiumpas IS NULL) AS n_onbekend FROM perf GROUP BY 1",
}
