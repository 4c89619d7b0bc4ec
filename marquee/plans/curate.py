"""Queries of the nightly curation: duplicates, votes and links between productions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedupe as U
from ..operators import linkage as L
from ..operators import votes as M
from .shows import SHOW_SQL, sql_noise, sql_norm, sql_parts, table
from .shows import shows as read_shows


def dedupe_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.keep_best(read_shows(spark, sf_dir)).select("seq", "theaterId", "titel", "maker", "genre", "prijs", "podiumpas", "beschikbaarheid")


def dedupe_removed_per_venue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.removed_per_venue(read_shows(spark, sf_dir))


def unique_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.unique_count(read_shows(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of venue pairs: v0 before v1, v1 before v2, and so on."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("v"), "s_suppkey").alias("winner"), F.concat(F.lit("v"), F.col("s_suppkey") + 1).alias("loser"), F.col("s_suppkey").alias("pos"))


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shows by week and without times, so that neighbouring venues meet."""
    return read_shows(spark, sf_dir).withColumn("datum", F.to_date(F.date_trunc("month", "datum"))).withColumn("tijd", F.lit(None).cast("string"))


def pair_priority_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.pair_priority(_coarse(spark, sf_dir), _pairs(spark, sf_dir))[0].groupBy("theaterId").agg(F.count(F.lit(1)).alias("n"))


def pair_priority_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.pair_priority(_coarse(spark, sf_dir), _pairs(spark, sf_dir))[1].select("seq", "theaterId", "voorrang", "titel")


def running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.running_ids(read_shows(spark, sf_dir)).select("seq", "id")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_shows(spark, sf_dir)
    return rows.groupBy(U.completeness(rows).cast("long").alias("velden")).agg(F.count(F.lit(1)).alias("n"))


def genre_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.genre_majority(read_shows(spark, sf_dir)).select("seq", "genre", "genreBron", "genreGewijzigd", "genres")


def display_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.display_majority(read_shows(spark, sf_dir)).select("seq", "titel", "titelBron")


def maker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.maker_scores(read_shows(spark, sf_dir))


def maker_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.maker_votes(read_shows(spark, sf_dir))


def maker_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.maker_majority(read_shows(spark, sf_dir)).select("seq", "maker", "makerBron", "makerGewijzigd")


def agreed_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.agreed_info(read_shows(spark, sf_dir))


def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.known_keys(read_shows(spark, sf_dir))


def title_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.title_index(read_shows(spark, sf_dir))


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that venues spell in their own way: an article, an addition, a year, a letter less."""
    p = table(spark, sf_dir, "part")
    way = F.col("p_partkey") % 6
    name = (
        F.when(way == 0, F.col("p_name")).when(way == 1, F.concat(F.lit("De "), "p_name")).when(way == 2, F.concat("p_name", F.lit(" live")))
        .when(way == 3, F.concat("p_name", F.lit(" 2026"))).when(way == 4, F.substring("p_name", 1, 99)).otherwise(F.regexp_replace("p_name", "(.)$", ""))
    )
    rows = p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("v"), F.col("p_partkey") % 13).alias("theaterId"), F.concat(name, F.lit(" – "), F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("titel"))
    return rows.withColumn("sleutel", X.production_key(F.col("titel"), F.col("theaterId")))


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.similar_keys(_spelled(spark, sf_dir))


def difference_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the names of parts next to each other differ, and a name from its own variants."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    forms = F.array(F.concat(F.lit("de "), "p_name"), F.concat("p_name", F.lit(" en friends")), F.concat("p_name", F.lit(" 3e editie")), F.concat(F.lit("x"), "p_name"), F.replace("p_name", F.lit(" "), F.lit("")), F.concat("p_name", F.lit(" 2")), F.reverse("p_name"))
    pairs = p.select("p_partkey", F.col("p_name").alias("a"), F.posexplode(forms).alias("vorm", "b"))
    return pairs.select("p_partkey", "vorm", L.difference(F.col("a"), F.col("b")).alias("soort"))


def unambiguous_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unambiguous_mapping(_renamed(spark, sf_dir))


def multi_target_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.multi_target_keys(_renamed(spark, sf_dir))


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose source title was a word of the name and the size."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("v"), F.col("p_partkey") % 13).alias("theaterId"), F.col("p_name").alias("titel"), F.concat(F.split("p_name", " ")[1], F.lit(" "), F.col("p_size") * (F.col("p_partkey") % 40)).alias("titelBron"))
    return rows.withColumn("sleutel", X.production_key(F.col("titel"), F.col("theaterId")))


def alias_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer points to an earlier one (those of one nation to none): chains followed to their end."""
    c = table(spark, sf_dir, "customer").filter("c_nationkey <> 3 AND c_custkey > 0")
    return L.resolve_chains(c.select(F.col("c_custkey").cast("string").alias("van"), F.floor(F.col("c_custkey") / 2).cast("string").alias("naar")))


def merge_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by the same maker with and without a subtitle become one production."""
    p = table(spark, sf_dir, "part")
    title = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" – "), F.initcap("p_type"))).otherwise(F.concat("p_name", F.lit(" | "), F.initcap("p_type"), F.lit(" special")))
    rows = p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("v"), F.col("p_partkey") % 13).alias("theaterId"), title.alias("titel"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("maker"), F.date_add(F.lit("1998-01-01"), (F.col("p_partkey") % 50).cast("int")).alias("datum"), F.lit(None).cast("string").alias("tijd"), F.lit(False).alias("volgordeZeker"))
    return L.merge_prefixes(rows.withColumn("sleutel", X.production_key(F.col("titel"), F.col("theaterId")))).select("seq", "titel", "titelBron", "beschrijving")


def source_index_makers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.source_index(read_shows(spark, sf_dir))[0]


def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.candidate_groups(_spelled(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_keep_best, dedupe_removed_per_venue, unique_count, pair_priority_kept, pair_priority_removed, running_ids, completeness, genre_majority, display_majority, maker_scores, maker_votes,
        maker_majority, agreed_info, known_keys, title_index, similar_pairs, difference_kind, unambiguous_mapping, multi_target_keys, alias_chain, merge_prefix, source_index_makers, candidate_groups,
    )
}

_CANC = "beschikbaarheid IN ('afgelast', 'verplaatst')"
_DUP = f"concat_ws('|', theaterId, datum, coalesce(tijd, ''), norm, CASE WHEN {_CANC} THEN 'vervallen' END)"
_SCORE = "(11 + (maker IS NOT NULL)::INT + (tijd IS NOT NULL)::INT + (genre IS NOT NULL)::INT + (podiumpas IS NOT NULL)::INT - 2 - (beschikbaarheid = 'onbekend')::INT)"
_COARSE = "coarse AS (SELECT *, concat_ws('|', date_trunc('month', datum)::DATE, '', norm) AS same FROM perf), pairs AS (SELECT 'v' || s_suppkey AS winner, 'v' || (s_suppkey + 1) AS loser, s_suppkey AS pos FROM supplier), has AS (SELECT DISTINCT theaterId AS winner, same FROM coarse), beaten AS (SELECT c.seq, arg_min(p.winner, p.pos) AS voorrang FROM coarse c JOIN pairs p ON p.loser = c.theaterId JOIN has h ON h.winner = p.winner AND h.same = c.same GROUP BY 1)"
_SPECIFIC = "coalesce(list_position(['Familie & Jeugd', 'Musical', 'Cabaret', 'Dans', 'Muziektheater', 'Muziek & Concert', 'Toneel'], genre), 8)"
_ORDER = "list_position(['Toneel', 'Musical', 'Cabaret', 'Muziektheater', 'Dans', 'Familie & Jeugd', 'Muziek & Concert', 'Overig'], genre)"
_SEP = "'\\s+[–—-]\\s+|\\s+\\|\\s+|:\\s+'"
_FORM = f"array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(titel, {_SEP}), lambda d: lower(trim(regexp_replace(d, '\\s+', ' ', 'g')))), lambda d: d <> '')), chr(1))"
_LAST = f"lower(trim(regexp_split_to_array(titel, {_SEP})[-1]))"
_CAPS = "length(regexp_replace({0}, '\\P{{Lu}}', '', 'g'))"


def _bare(x: str) -> str:
    """A part as it counts in keys, as in ``text.normal_part``."""
    out = sql_noise(x)
    out = f"regexp_replace(regexp_replace({out}, '\\s\\d+\\s*\\+\\s*$', ' '), '[\\s–-]+(?:reprise|try-?out)\\s*$', ' ', 'i')"
    return sql_norm(f"regexp_replace(regexp_replace({out}, '(?:^|[\\s–-]+)(?:reprise|try-?out)\\s*$', ' ', 'i'), '(?:^|\\s)\\d+\\s*\\+\\s*$', ' ')")


_SPELLED = f"""WITH spelled0 AS (SELECT p_partkey AS seq, 'v' || (p_partkey % 13) AS theaterId, CASE p_partkey % 6 WHEN 1 THEN 'De ' || p_name WHEN 2 THEN p_name || ' live' WHEN 3 THEN p_name || ' 2026' WHEN 5 THEN p_name[:-2] ELSE p_name END || ' – ' || replace(p_brand, '#', ' ') AS titel FROM part),
spelled AS (SELECT *, array_to_string({sql_parts('titel')}, ' | ') AS sleutel FROM spelled0)"""
_UNDATED = "trim(regexp_replace(regexp_replace({0}, '\\b(?:20\\d\\d(?:\\s*2\\d{{3}})?|\\d+\\s*(?:e|ste|de)\\s+editie|editie)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_ADD = "'\\s+(?:en\\s+friends|and\\s+friends|live|derniere|reprise|premiere|tournee|jubileum|presenteert|en\\s+\\S+(?:\\s+\\S+){0,2})$'"


def _differ(a: str, b: str) -> str:
    ua, ub = _UNDATED.format(a), _UNDATED.format(b)
    short, long_ = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    least = f"least(length({a}), length({b}))"
    return f"""CASE WHEN {a} = {b} THEN NULL WHEN {ua} = {ub} AND {ua} <> '' THEN 'jaartal'
 WHEN regexp_replace({a}, '\\d+', '#', 'g') = regexp_replace({b}, '\\d+', '#', 'g') THEN NULL
 WHEN regexp_replace({a}, '^(?:de|het|the|een|a)\\s+', '') = regexp_replace({b}, '^(?:de|het|the|een|a)\\s+', '') THEN 'lidwoord'
 WHEN starts_with({long_}, {short} || ' ') AND regexp_matches({long_}, {_ADD}) AND regexp_replace({long_}, {_ADD}, '') = {short} THEN 'toevoeging'
 WHEN least(levenshtein({a}, {b}), levenshtein(replace({a}, ' ', ''), replace({b}, ' ', ''))) <= least(2, greatest(1, floor({least} * 0.2))) AND {least} >= 5 THEN 'spelling' END"""


_RENAMED = f"""WITH renamed AS (SELECT {sql_norm('p_name')} AS nieuw, {sql_norm("split_part(p_name, ' ', 2) || ' ' || (p_size * (p_partkey % 40))")} AS oud FROM part),
doel AS (SELECT DISTINCT oud, nieuw FROM renamed WHERE oud <> nieuw)"""

ORACLE_SQL = {
    "dedupe_keep_best": SHOW_SQL + f", r AS (SELECT *, min(seq) OVER (PARTITION BY {_DUP}) AS eerste, row_number() OVER (PARTITION BY {_DUP} ORDER BY {_SCORE} DESC, seq) AS k FROM perf) SELECT eerste AS seq, theaterId, titel, maker, genre, prijs, podiumpas, beschikbaarheid FROM r WHERE k = 1",
    "dedupe_removed_per_venue": SHOW_SQL + f"SELECT theaterId, (count(*) - count(DISTINCT {_DUP}))::BIGINT AS verwijderd FROM perf GROUP BY 1 HAVING count(*) > count(DISTINCT {_DUP})",
    "unique_count": SHOW_SQL + f"SELECT theaterId, count(DISTINCT {_DUP}) AS aantal FROM perf GROUP BY 1",
    "pair_priority_kept": SHOW_SQL + f", {_COARSE} SELECT theaterId, count(*) AS n FROM coarse WHERE seq NOT IN (SELECT seq FROM beaten) GROUP BY 1",
    "pair_priority_removed": SHOW_SQL + f", {_COARSE} SELECT seq, theaterId, voorrang, titel FROM coarse JOIN beaten USING (seq)",
    "running_ids": SHOW_SQL + """, b AS (SELECT seq, concat_ws('-', theaterId, regexp_replace(regexp_replace(strip_accents(lower(titel)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), datum, coalesce(replace(tijd, ':', ''), 'tbd')) AS base FROM perf),
n AS (SELECT seq, base, row_number() OVER (PARTITION BY base ORDER BY seq) AS k FROM b) SELECT seq, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS id FROM n""",
    "completeness": SHOW_SQL + f"SELECT ({_SCORE})::BIGINT AS velden, count(*) AS n FROM perf GROUP BY 1",
    "genre_majority": SHOW_SQL + f""", c AS (SELECT sleutel, theaterId, genre, count(*) AS n FROM perf WHERE genre <> 'Overig' AND NOT contains(sleutel, '::') GROUP BY 1, 2, 3),
v AS (SELECT sleutel, theaterId, arg_min(genre, (-n, {_SPECIFIC})) AS genre FROM c GROUP BY 1, 2), t AS (SELECT sleutel, genre, count(*) AS n FROM v GROUP BY 1, 2),
g AS (SELECT sleutel, arg_min(genre, (-n, {_SPECIFIC})) AS gekozen FROM t GROUP BY 1), a AS (SELECT sleutel, list(genre ORDER BY {_ORDER}) AS alle FROM (SELECT DISTINCT sleutel, genre FROM c) GROUP BY 1)
SELECT seq, coalesce(gekozen, genre) AS genre, CASE WHEN gekozen IS DISTINCT FROM genre AND gekozen IS NOT NULL THEN genre END AS genreBron, gekozen IS NOT NULL AND gekozen IS DISTINCT FROM genre AS genreGewijzigd, CASE WHEN len(alle) > 1 THEN alle END AS genres
FROM perf LEFT JOIN g USING (sleutel) LEFT JOIN a USING (sleutel)""",
    "display_majority": SHOW_SQL + f""", f AS (SELECT *, {_FORM} AS vorm, {_LAST} AS deel FROM perf),
s AS (SELECT deel, count(*) AS score FROM (SELECT DISTINCT theaterId, titel, deel FROM f WHERE volgordeZeker AND len(regexp_split_to_array(titel, {_SEP})) > 1) GROUP BY 1),
c AS (SELECT sleutel, vorm, theaterId, titel, deel, count(*) AS n, bool_or(volgordeZeker) AS zeker FROM f WHERE vorm <> '' AND NOT contains(sleutel, '::') GROUP BY 1, 2, 3, 4, 5),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sleutel, vorm, theaterId ORDER BY n DESC, titel) AS k FROM c) WHERE k = 1),
t AS (SELECT sleutel, vorm, titel, deel, count(*) AS v, count(*) FILTER (zeker) AS z FROM v GROUP BY 1, 2, 3, 4),
u AS (SELECT t.*, coalesce(score, 0) - sum(z) OVER (PARTITION BY sleutel, vorm, t.deel) AS maker, sum(v) OVER w AS venues, max(z) OVER w AS mz FROM t LEFT JOIN s ON s.deel = t.deel WINDOW w AS (PARTITION BY sleutel, vorm)),
w AS (SELECT *, mz > 0 AND count(*) FILTER (z = mz) OVER (PARTITION BY sleutel, vorm) = 1 AS zeker FROM u WHERE venues >= 2),
k AS (SELECT sleutel, vorm, titel AS gekozen, row_number() OVER (PARTITION BY sleutel, vorm ORDER BY CASE WHEN zeker THEN -z ELSE -v END, CASE WHEN zeker THEN 0 ELSE -z END, CASE WHEN zeker THEN 0 ELSE -maker END,
 CASE WHEN regexp_matches(titel, '^\\p{{Lu}}') THEN 0 ELSE 1 END, {_CAPS.format('titel')}, titel) AS k FROM w)
SELECT seq, coalesce(gekozen, titel) AS titel, CASE WHEN gekozen <> titel THEN titel END AS titelBron FROM f LEFT JOIN (SELECT * FROM k WHERE k = 1) USING (sleutel, vorm)""",
    "maker_scores": SHOW_SQL + f"SELECT deel, count(*) AS score FROM (SELECT DISTINCT theaterId, titel, {_LAST} AS deel FROM perf WHERE volgordeZeker AND len(regexp_split_to_array(titel, {_SEP})) > 1) GROUP BY 1",
    "maker_votes": SHOW_SQL + "SELECT sleutel, theaterId, maker, count(*) AS n FROM perf WHERE maker IS NOT NULL AND NOT contains(sleutel, '::') GROUP BY 1, 2, 3",
    # the data have one spelling a maker and no slash: the vote is that of the maker with most venues, and one that has just one venue is known elsewhere
    "maker_majority": SHOW_SQL + """, c AS (SELECT sleutel, theaterId, maker, count(*) AS n FROM perf WHERE maker IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT sleutel, theaterId, arg_min(maker, (-n, length(regexp_replace(maker, '\\P{Lu}', '', 'g')), maker)) AS maker FROM c GROUP BY 1, 2), t AS (SELECT sleutel, maker, count(*) AS n FROM v GROUP BY 1, 2),
m AS (SELECT sleutel, max(n) AS n FROM t GROUP BY 1), g AS (SELECT sleutel, min(maker) AS gekozen FROM t JOIN m USING (sleutel, n) GROUP BY 1 HAVING count(*) = 1)
SELECT seq, coalesce(gekozen, maker) AS maker, CASE WHEN gekozen IS DISTINCT FROM maker AND gekozen IS NOT NULL THEN maker END AS makerBron, gekozen IS NOT NULL AND gekozen IS DISTINCT FROM maker AS makerGewijzigd FROM perf LEFT JOIN g USING (sleutel)""",
    "agreed_info": SHOW_SQL + "SELECT sleutel, CASE WHEN count(DISTINCT maker) = 1 THEN max(maker) END AS maker, CASE WHEN count(DISTINCT genre) = 1 THEN max(genre) END AS genre FROM perf GROUP BY 1 HAVING count(DISTINCT maker) = 1 OR count(DISTINCT genre) = 1",
    "known_keys": SHOW_SQL + "SELECT sleutel, arg_min(titel, seq) AS titel FROM perf GROUP BY 1",
    "title_index": SHOW_SQL + f", t AS (SELECT DISTINCT titel, sleutel FROM perf), e AS (SELECT unnest(list_prepend(titel, regexp_split_to_array(titel, {_SEP})[:-2])) AS t, sleutel FROM t) SELECT DISTINCT array_to_string({sql_parts('t')}, ' | ') AS ruim, sleutel FROM e WHERE array_to_string({sql_parts('t')}, ' | ') <> ''",
    "similar_pairs": _SPELLED + f""", k AS (SELECT sleutel, string_split(sleutel, ' | ') AS delen, min(theaterId) AS v1, max(theaterId) AS v2 FROM spelled GROUP BY 1 HAVING contains(sleutel, ' | ')),
j AS (SELECT a.sleutel AS a, b.sleutel AS b, list_filter(a.delen, lambda d: NOT list_contains(b.delen, d)) AS da, list_filter(b.delen, lambda d: NOT list_contains(a.delen, d)) AS db FROM k a JOIN k b ON a.sleutel < b.sleutel AND len(a.delen) = len(b.delen) AND NOT (a.v1 = a.v2 AND b.v1 = b.v2 AND a.v1 = b.v1)),
o AS (SELECT a, b, da[1] AS deelA, db[1] AS deelB FROM j WHERE len(da) = 1 AND len(db) = 1)
SELECT a, b, deelA, deelB, {_differ('deelA', 'deelB')} AS soort FROM o WHERE {_differ('deelA', 'deelB')} IS NOT NULL""",
    "difference_kind": f"""WITH f AS (SELECT p_partkey, p_name AS a, ['de ' || p_name, p_name || ' en friends', p_name || ' 3e editie', 'x' || p_name, replace(p_name, ' ', ''), p_name || ' 2', reverse(p_name)] AS v FROM part),
e AS (SELECT p_partkey, a, unnest(range(7))::INT AS vorm, unnest(v) AS b FROM f) SELECT p_partkey, vorm, {_differ('a', 'b')} AS soort FROM e""",
    "unambiguous_mapping": _RENAMED + "SELECT oud, min(nieuw) AS nieuw FROM doel WHERE oud NOT IN (SELECT nieuw FROM renamed) GROUP BY 1 HAVING count(*) = 1",
    "multi_target_keys": _RENAMED + "SELECT oud AS sleutel, list(nieuw ORDER BY nieuw) AS doelen FROM doel WHERE oud NOT IN (SELECT nieuw FROM renamed) GROUP BY 1 HAVING count(*) > 1",
    "alias_chain": """WITH RECURSIVE l AS (SELECT c_custkey AS van, c_custkey // 2 AS naar FROM customer WHERE c_nationkey <> 3 AND c_custkey > 0),
w AS (SELECT van, naar, 1 AS stappen FROM l UNION ALL SELECT w.van, l.naar, w.stappen + 1 FROM w JOIN l ON l.van = w.naar) SELECT van::VARCHAR AS van, arg_max(naar, stappen)::VARCHAR AS naar, max(stappen)::INT AS stappen FROM w GROUP BY 1""",
    "merge_prefix": f"""WITH r AS (SELECT p_partkey AS seq, 'v' || (p_partkey % 13) AS theaterId, p_partkey % 50 AS dag, p_name AS naam, upper(p_type[1]) || lower(p_type[2:]) AS soort, p_partkey % 3 AS k, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS maker FROM part),
q AS (SELECT *, CASE k WHEN 0 THEN naam WHEN 1 THEN naam || ' – ' || soort ELSE naam || ' | ' || soort || ' special' END AS titel FROM r),
d AS (SELECT DISTINCT maker, naam FROM q WHERE k = 0 AND maker IS NOT NULL),
n AS (SELECT q.*, CASE WHEN k = 1 AND d.naam IS NOT NULL THEN q.naam END AS nieuw FROM q LEFT JOIN d ON d.maker = q.maker AND d.naam = q.naam),
c AS (SELECT *, count(*) OVER (PARTITION BY theaterId, dag, {sql_norm("coalesce(nieuw, titel)")}) AS m FROM n)
SELECT seq, CASE WHEN nieuw IS NOT NULL AND m < 2 THEN nieuw ELSE titel END AS titel, CASE WHEN nieuw IS NOT NULL AND m < 2 THEN titel END AS titelBron, CASE WHEN nieuw IS NOT NULL AND m < 2 THEN soort END AS beschrijving FROM c""",
    "source_index_makers": SHOW_SQL + f"SELECT {_bare('maker')} AS k, min(theaterId) AS v1, max(theaterId) AS v2 FROM perf WHERE maker IS NOT NULL GROUP BY 1",
    "candidate_groups": _SPELLED + f""", k AS (SELECT DISTINCT sleutel, string_split(sleutel, ' | ') AS delen FROM spelled), e AS (SELECT sleutel, unnest(delen) AS anker FROM k),
f AS (SELECT * FROM e WHERE length(anker) >= 4 AND NOT regexp_matches(anker, '^(?:oudejaars\\S*(?: \\d{{4}})?|best of|live|concert|try ?out|premiere|reprise|\\d{{4}}|\\d{{4}} \\d{{4}})$')),
m AS (SELECT anker FROM f GROUP BY 1 HAVING count(*) >= 2), b AS (SELECT sleutel, arg_max(anker, (length(anker), anker)) AS anker FROM f JOIN m USING (anker) GROUP BY 1),
g AS (SELECT anker FROM b GROUP BY 1 HAVING count(*) >= 2)
SELECT anker, sleutel, list_filter(delen, lambda d: d <> anker) AS rest FROM b JOIN g USING (anker) JOIN k USING (sleutel)""",
}
