"""Queries on groups of productions and what becomes of them in the alias list."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import curation, groups
from ..storage import checkpointed
from .shows import TODAY, sql_key, sql_norm, table

DAY = date.fromisoformat(TODAY)
#: Four parts are the variants of one show: bare, with its maker, with a maker of its own, and with something else.
_SOURCE = """SELECT p_partkey AS seq, concat('v', p_partkey % 4) AS theaterId, p_partkey {div} 4 AS b, p_partkey % 4 AS r,
  concat('Stuk ', p_partkey {div} 4, CASE WHEN p_partkey % 4 IN (0, 2) THEN '' WHEN p_partkey % 4 = 1 THEN ' – Ada Lint' WHEN p_partkey {div} 4 % 5 = 0 THEN ' – het vervolg' WHEN p_partkey {div} 4 % 5 = 1 THEN ' – Het origineel!' WHEN p_partkey {div} 4 % 5 = 2 THEN ', met o.a. Bo' ELSE ': Ada Lindt' END) AS titel,
  CASE WHEN p_partkey % 4 = 2 THEN CASE WHEN p_partkey {div} 4 % 3 = 0 THEN 'Mia Kast' WHEN p_partkey {div} 4 % 6 = 1 THEN 'Ada Lint en Co' WHEN p_partkey {div} 4 % 6 = 4 THEN 'Ada Lint' END END AS maker,
  CASE WHEN p_partkey {div} 4 % 7 = 0 AND p_partkey % 4 = 1 THEN 'Toneel' WHEN p_partkey {div} 4 % 7 = 1 THEN 'Overig' ELSE 'Cabaret' END AS genre,
  cast(date '{day}' + cast(p_partkey % 4 + CASE WHEN p_partkey {div} 4 % 11 = 0 AND p_partkey % 4 = 0 THEN -5 WHEN p_partkey {div} 4 % 13 = 0 AND p_partkey % 4 = 3 THEN 500 ELSE 0 END AS int) AS date) AS datum
FROM {part}"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_SOURCE.format(div="div", day=TODAY, part="{part}"), part=table(spark, sf_dir, "part"))
    return rows.withColumn("sleutel", X.production_key(F.col("titel"), F.col("theaterId")))


def alias_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.groups(groups.members(_variants(spark, sf_dir), DAY))


def alias_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.proposals(groups.for_proposals(groups.members(_variants(spark, sf_dir), DAY)))


def alias_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias list after taking over proposals without doubts, beside what a reviewer chose and kept apart."""
    members = checkpointed(groups.for_proposals(groups.members(_variants(spark, sf_dir), DAY)))
    b = table(spark, sf_dir, "part").select(F.expr("p_partkey div 4").alias("b")).distinct()
    none = F.lit(None).cast("string")
    chosen = b.filter("b % 5 = 4").select(F.concat(F.lit("ada lint | stuk "), "b").alias("sleutel"), F.concat(F.lit("Gekozen "), "b").alias("titel"), none.alias("maker"), F.lit(False).alias("makerVast"), F.concat(F.lit("stuk "), "b").alias("groep"), F.lit("keuze").alias("regel"))
    never = b.filter("b % 5 = 3").select(F.concat(F.lit("stuk "), "b").alias("sleutel"))
    return curation.accept_proposals(curation.proposals(members), members, chosen, never)[0]


def alias_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alias list after a reviewer's choices; sources with two targets are rows of rule "conflict"."""
    part = table(spark, sf_dir, "part")
    aliases, choices, never = (spark.sql(LISTS[k].format(div="div", str="string", part="{part}"), part=part) for k in ("aliases", "choices", "never"))
    merged, conflicts = curation.merge_choices(aliases, choices, never)
    none = F.lit(None).cast("string")
    return merged.drop("makerVast").unionByName(conflicts.select(F.col("bron").alias("sleutel"), none.alias("titel"), none.alias("maker"), none.alias("groep"), F.lit("conflict").alias("regel")))


QUERIES = {f.__name__: f for f in (alias_groups, alias_proposals, alias_accepted, alias_import)}

_GENERIC = "|".join(groups.GENERIC)
_SLOGAN, _CAST = "|".join(groups.SLOGANS), "|".join(groups.CASTS)
_CUT = f"list_filter(list_transform(regexp_split_to_array(titel, '{groups.SPLIT}'), lambda x: trim(x)), lambda x: x <> '')"
_NAME = groups.NAME.replace("'", "''")
#: Anchors by joins of parts with themselves, clusters of names by a look at all earlier ones.
_MEMBERS = f"""WITH s AS ({_SOURCE.format(div="//", day=TODAY, part="part")}),
p AS (SELECT *, {sql_key('titel', 'theaterId')} AS sleutel, {_CUT} || CASE WHEN maker IS NULL THEN []::VARCHAR[] ELSE [maker] END AS delen FROM s WHERE datum >= DATE '{TODAY}'),
d AS (SELECT seq, unnest(delen) AS ruw, unnest(range(len(delen))) AS plek FROM p),
k AS (SELECT seq, ruw, plek, {sql_norm('ruw')} AS norm, CASE WHEN regexp_matches(ruw, '(?i){_CAST}') THEN 'cast' WHEN regexp_matches(ruw, '(?i){_SLOGAN}') THEN 'slogan'
  WHEN regexp_matches(ruw, '{_NAME}') AND len(regexp_split_to_array(ruw, '\\s+')) <= 5 THEN 'naam' ELSE 'ander' END AS soort FROM d),
a AS (SELECT norm AS anker, seq, min(plek) AS plek FROM k WHERE norm <> '' AND NOT regexp_matches(norm, '^(?:{_GENERIC})$') AND (norm LIKE '% %' OR length(norm) >= 5) GROUP BY 1, 2),
rest AS (SELECT a.anker, a.seq, k.ruw, k.norm, k.soort, k.plek FROM a JOIN k ON k.seq = a.seq AND k.norm <> a.anker),
fine AS (SELECT anker, min((seq, plek)) AS eerst FROM a JOIN p USING (seq) GROUP BY 1 HAVING count(DISTINCT sleutel) >= 2 AND anker NOT IN (SELECT anker FROM rest WHERE soort = 'ander' GROUP BY 1 HAVING count(DISTINCT norm) > 1)),
names AS (SELECT anker, ruw, norm, min((seq, plek)) AS om FROM rest SEMI JOIN fine USING (anker) WHERE soort = 'naam' GROUP BY 1, 2, 3),
founders AS (SELECT x.anker FROM names x WHERE NOT EXISTS (FROM names y WHERE y.anker = x.anker AND y.om < x.om AND (x.norm = y.norm OR starts_with(x.norm, y.norm || ' ') OR starts_with(y.norm, x.norm || ' ') OR levenshtein(x.norm, y.norm) <= 2))),
good AS (SELECT * FROM fine WHERE anker NOT IN (SELECT anker FROM founders GROUP BY 1 HAVING count(*) > 1)),
own AS (SELECT a.seq, a.anker, g.eerst FROM a JOIN good g USING (anker) QUALIFY row_number() OVER (PARTITION BY a.seq ORDER BY length(anker) DESC, eerst) = 1),
kept AS (SELECT anker, list_sort(list(DISTINCT sleutel)) AS sleutels, min(eerst) AS e FROM own JOIN p USING (seq) GROUP BY 1 HAVING count(DISTINCT sleutel) >= 2 QUALIFY row_number() OVER (PARTITION BY array_to_string(list_sort(list(DISTINCT sleutel)), '|') ORDER BY min(eerst)) = 1),
m AS (SELECT anker, sleutels, p.* FROM own JOIN kept USING (anker) JOIN p USING (seq)),
h AS (SELECT m.anker, m.seq, coalesce(bool_or(soort = 'slogan'), false) AS a, coalesce(bool_or(soort = 'cast'), false) AS b, coalesce(bool_or(soort = 'naam'), false) AS naam FROM m LEFT JOIN rest ON rest.anker = m.anker AND rest.seq = m.seq GROUP BY 1, 2)"""
_EXCLUDED = ", ".join(f"'{t}'" for t in X.VENUE_BOUND_TITLES)
_PROPOSED = """, t AS (SELECT anker, titel, count(DISTINCT theaterId) AS v FROM m GROUP BY 1, 2),
c AS (SELECT anker, titel AS canoniek FROM t QUALIFY row_number() OVER (PARTITION BY anker ORDER BY v DESC, length(titel) DESC, titel) = 1),
z AS (SELECT anker, any_value(sleutels) AS sleutels, list_sort(coalesce(list(DISTINCT maker) FILTER (maker IS NOT NULL), [])) AS makers FROM m GROUP BY 1),
x AS (SELECT DISTINCT anker FROM (SELECT DISTINCT anker, sleutel FROM m) QUALIFY count(*) OVER (PARTITION BY sleutel) > 1),
prop AS (SELECT anker AS groep, canoniek, sleutels, makers, CASE WHEN len(makers) > 1 THEN ['verschillende makers'] ELSE [] END || CASE WHEN anker IN (SELECT anker FROM x) THEN ['conflict met een andere groep'] ELSE [] END AS twijfel FROM c JOIN z USING (anker))"""
def _bare(x: str) -> str:
    """Parts of a title as they count when variants are compared."""
    cut = f"regexp_split_to_array({x}, '\\s+[–—-]\\s+|\\s+\\|\\s+')"
    return f"list_distinct(list_filter(list_transform({cut}, lambda d: {sql_norm('d')}), lambda d: d <> ''))"


#: An alias list, what a reviewer chose, and keys never to be merged.
LISTS = {
    "aliases": "SELECT concat('k', p_partkey) AS sleutel, concat('Oud ', p_partkey {div} 4) AS titel, cast(NULL AS {str}) AS maker, false AS makerVast, concat('g', p_partkey {div} 4) AS groep, CASE WHEN p_partkey % 3 = 0 THEN 'R2' ELSE 'keuze' END AS regel FROM {part} WHERE p_partkey % 4 IN (1, 2)",
    "choices": " UNION ALL ".join(
        f"""SELECT concat('g', p_partkey {{div}} 4) AS groep, concat('k', p_partkey + {add}) AS bron, CASE WHEN p_partkey {{div}} 4 % 2 = 0 THEN concat('STUK ', p_partkey {{div}} 24) ELSE concat('Stuk ', p_partkey {{div}} 24) END AS titel,
  CASE WHEN p_partkey {{div}} 4 % 4 = 0 THEN 'Ada Lint' WHEN p_partkey {{div}} 4 % 13 = 0 THEN 'Bo' END AS maker FROM {{part}} WHERE p_partkey {{div}} 4 % {each} = 0 AND p_partkey % 4 IN (1, 3)"""
        for add, each in ((0, 3), (24, 15))
    ),
    "never": "SELECT concat('k', p_partkey) AS sleutel, concat('g', p_partkey {div} 4) AS groep FROM {part} WHERE p_partkey % 4 = 2 AND p_partkey {div} 4 % 7 = 0",
}
_LISTS = "WITH " + ", ".join(f"{k} AS ({v.format(div='//', str='VARCHAR', part='part')})" for k, v in LISTS.items())
ORACLE_SQL = {
    "alias_groups": _MEMBERS + f""", n AS (SELECT anker, list(ruw ORDER BY om) AS namen FROM names GROUP BY 1),
g AS (SELECT m.anker, sleutels, count(*) AS n, bool_or(h.a) AS a, bool_or(h.b) AS b, bool_or(regexp_matches(titel, ',\\s+|:\\s+')) AS c, bool_or(h.naam) AND bool_or(NOT h.naam) AS e, list_sort(coalesce(list(DISTINCT genre) FILTER (genre <> 'Overig'), [])) AS genres,
  max(datum) - min(datum) AS dagen, bool_or(m.anker IN ({_EXCLUDED}) OR m.sleutel IN ({_EXCLUDED})) AS uit FROM m JOIN h ON h.anker = m.anker AND h.seq = m.seq GROUP BY 1, 2),
f AS (SELECT g.*, coalesce(namen, []) AS namen FROM g LEFT JOIN n USING (anker))
SELECT anker, sleutels, namen, n, CASE WHEN a OR b OR c OR e OR len(namen) > 1 THEN list_filter([CASE WHEN a THEN 'a' END, CASE WHEN b THEN 'b' END, CASE WHEN c THEN 'c' END, CASE WHEN len(namen) > 1 THEN 'd' END, CASE WHEN e THEN 'e' END], lambda x: x IS NOT NULL) ELSE ['overig'] END AS soorten,
  list_filter([CASE WHEN len(genres) > 1 THEN 'ander genre: ' || array_to_string(genres, ' / ') END, CASE WHEN anker NOT LIKE '% %' THEN 'korte titel "' || anker || '": meer producties met die naam mogelijk' END, CASE WHEN uit THEN 'op de uitsluitlijst (bekend als verschillende producties)' END,
    CASE WHEN len(namen) > 1 THEN 'makernamen: ' || array_to_string(namen, ' / ') END, CASE WHEN dagen > {groups.APART_DAYS} THEN 'speeldata ruim een jaar uit elkaar' END], lambda x: x IS NOT NULL) AS twijfel FROM f""",
    "alias_proposals": _MEMBERS + _PROPOSED + " SELECT * FROM prop",
    "alias_accepted": _MEMBERS + _PROPOSED + f""", chosen AS (SELECT 'ada lint | stuk ' || b AS sleutel, 'Gekozen ' || b AS titel, NULL::VARCHAR AS maker, false AS makerVast, 'stuk ' || b AS groep, 'keuze' AS regel FROM (SELECT DISTINCT p_partkey // 4 AS b FROM part) WHERE b % 5 = 4),
never AS (SELECT 'stuk ' || b AS sleutel FROM (SELECT DISTINCT p_partkey // 4 AS b FROM part) WHERE b % 5 = 3),
field AS (SELECT anker AS groep, maker FROM m WHERE maker IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY anker ORDER BY count(*) DESC, maker) = 1),
fit AS (SELECT prop.groep, canoniek, {sql_key('canoniek', "''")} AS doel, CASE WHEN contains(canoniek, ' – ') THEN CASE WHEN NOT ends_with(canoniek, '!') THEN string_split(canoniek, ' – ')[-1] END ELSE maker END AS m FROM prop LEFT JOIN field USING (groep) WHERE len(twijfel) = 0),
ok AS (SELECT * FROM fit WHERE m IS NOT NULL AND groep NOT IN (SELECT anker FROM m SEMI JOIN never USING (sleutel)) AND doel NOT IN (SELECT sleutel FROM chosen)),
src AS (SELECT groep, sleutel, canoniek, ok.m AS maker, {_bare("bron")} AS v, {_bare("canoniek")} AS c, {sql_norm("ok.m")} AS mk FROM ok JOIN (SELECT anker AS groep, sleutel, min(titel) AS bron FROM m GROUP BY 1, 2) USING (groep) WHERE sleutel <> doel AND sleutel NOT IN (SELECT sleutel FROM chosen)),
good_src AS (SELECT * FROM src WHERE len(list_filter(v, lambda d: NOT list_contains(c, d) AND d <> mk)) = 0 AND (len(list_filter(c, lambda d: NOT list_contains(v, d) AND d <> mk)) = 0 OR (len(v) = 1 AND list_contains(v, mk))))
SELECT * FROM chosen UNION ALL SELECT sleutel, min(canoniek), min(maker), false, min(groep), 'R2' FROM good_src GROUP BY 1 HAVING count(DISTINCT canoniek) = 1""",
    "alias_import": _LISTS + """, k AS (SELECT *, lower(titel) AS kern, lower(maker) AS m FROM choices),
o AS (SELECT kern, count(DISTINCT m) AS makers, arg_min({'t': titel, 'm': maker}, (maker IS NULL, groep)) AS x FROM k GROUP BY 1),
t AS (SELECT groep, bron, CASE WHEN makers <= 1 THEN x.t ELSE titel END AS titel, CASE WHEN makers <= 1 THEN x.m ELSE maker END AS maker FROM k JOIN o USING (kern)),
per AS (SELECT bron, count(DISTINCT titel) AS n, arg_min({'t': titel, 'm': maker, 'g': groep}, groep) AS x FROM t GROUP BY 1),
goal AS (SELECT groep, min({'t': titel, 'm': maker}) AS x FROM t GROUP BY 1),
seen AS (SELECT groep FROM choices UNION SELECT groep FROM never)
SELECT bron AS sleutel, CASE WHEN n = 1 THEN x.t END AS titel, CASE WHEN n = 1 THEN x.m END AS maker, CASE WHEN n = 1 THEN x.g END AS groep, CASE WHEN n = 1 THEN 'keuze' ELSE 'conflict' END AS regel FROM per
UNION ALL SELECT sleutel, x.t, x.m, groep, 'keuze' FROM aliases JOIN goal USING (groep) WHERE regel = 'keuze' AND sleutel NOT IN (SELECT bron FROM choices) AND sleutel NOT IN (SELECT sleutel FROM never)
UNION ALL SELECT sleutel, titel, maker, groep, regel FROM aliases WHERE regel = 'keuze' AND groep NOT IN (FROM seen)
UNION ALL SELECT sleutel, titel, maker, groep, regel FROM aliases WHERE regel <> 'keuze' AND sleutel NOT IN (SELECT bron FROM choices) AND sleutel NOT IN (SELECT sleutel FROM never)""",
}
