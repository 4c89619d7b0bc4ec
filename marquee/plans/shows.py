"""The ``show`` fact table (one row a performance) over the driver's tables, as a DataFrame and as SQL.

Roles: venue = supplier, city = nation, province = region; title, maker and genre come from the part; date, time,
price, availability and pass eligibility from the line.  Titles come in the spellings that sources use: maker first
or last, with a label, with other separators and capitals.  ``seq`` is the input order: unique, and the tie-break
wherever the first row wins.  Keys are computed once a row, when the table is written, and carried as columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.agenda import search_forms
from ..storage import new_folder

TODAY = "1998-02-10"
ARTISTS = (("ECONOMY", "Ada Lint"), ("LARGE", "De Grote Kast"), ("MEDIUM", "Mia en Co"), ("PROMO", "Trio Vers"), ("SMALL", "Bo Café"), ("STANDARD", "Théâtre Nul"))
GENRES = ("Toneel", "Musical", "Cabaret", "Muziektheater", "Dans", "Familie & Jeugd", "Muziek & Concert", "Overig")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ARTIST = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ARTISTS) + " END"
_BASE = f"""
SELECT concat(lpad(cast(l_orderkey AS {{s}}), 10, '0'), '-', l_linenumber, '-', lpad(cast(l_partkey AS {{s}}), 9, '0'), '-',
              lpad(cast(l_suppkey AS {{s}}), 8, '0'), '-', cast(cast(round(l_extendedprice * 100) AS bigint) AS {{s}})) AS seq,
       concat('v', l_suppkey) AS theaterId, s_name AS theaterNaam, n_name AS stad, r_name AS provincie,
       CASE l_linenumber % 4
         WHEN 0 THEN concat(p_name, ' – ', {_ARTIST})
         WHEN 1 THEN concat({_ARTIST}, ' - ', p_name)
         WHEN 2 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), CASE WHEN p_size % 3 = 0 THEN ' (try-out)' ELSE '' END, ' | ', {_ARTIST})
         ELSE concat(upper(p_name), CASE WHEN p_size % 5 = 0 THEN ' 8+' ELSE '' END) END AS titel,
       CASE WHEN p_size % 4 <> 0 THEN {_ARTIST} END AS maker,
       cast(date '1998-01-01' + cast(cast(floor(l_orderkey + l_quantity) AS bigint) % 120 AS int) AS date) AS datum,
       CASE WHEN l_linenumber <> 7 THEN concat(cast(cast(12 + l_linenumber AS int) AS {{s}}), CASE WHEN l_tax > 0.04 THEN ':30' ELSE ':00' END) END AS tijd,
       CASE WHEN l_returnflag = 'N' THEN 'Overig'
            WHEN l_returnflag = 'R' AND p_size % 7 = 0 THEN NULL
            ELSE CASE p_size % 4 WHEN 0 THEN 'Cabaret' WHEN 1 THEN 'Toneel' WHEN 2 THEN 'Dans' ELSE 'Musical' END END AS genre,
       CASE WHEN l_quantity >= 49 THEN 'afgelast' WHEN l_quantity >= 47 THEN 'verplaatst' WHEN l_quantity >= 40 AND l_returnflag = 'R' THEN 'uitverkocht'
            WHEN l_quantity >= 40 AND l_returnflag = 'A' THEN 'wachtlijst' WHEN l_linestatus = 'O' THEN 'beschikbaar' ELSE 'onbekend' END AS beschikbaarheid,
       CASE WHEN p_type = 'SMALL' THEN NULL ELSE l_extendedprice <= 50000 END AS podiumpas,
       floor(l_extendedprice / 10) / 100 AS prijs,
       l_linenumber % 4 = 0 AS volgordeZeker
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
"""


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table with ``norm`` (normal title), ``sleutel`` (production key), ``vorm`` (form key) and ``zoek`` (what a search looks at)."""
    tables = {name: table(spark, sf_dir, name) for name in ("lineitem", "part", "supplier", "nation", "region")}
    source = _BASE.format(s="string")
    for name in tables:
        source = source.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    rows = spark.sql(source, **tables).withColumn("_ruim", X.wide_title(F.col("titel")))
    bound = F.col("_ruim").isin(*X.VENUE_BOUND_TITLES)
    key = F.when(bound, F.concat("theaterId", F.lit("::"), "_ruim")).otherwise(F.col("_ruim"))
    return rows.select("*", X.normal_title(F.col("titel")).alias("norm"), key.alias("sleutel"), X.form_key(F.col("titel")).alias("vorm"), search_forms(rows).alias("zoek")).drop("_ruim")


_written: dict[tuple[str, str], str] = {}


def shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, written below the shared folder at its first use in an application and read from there.

    All queries read it: keys are not worked out again, and filters on date, venue or city reach the scan.
    """
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _written:
        folder = new_folder(spark, "shows")
        derive(spark, sf_dir).write.option("compression", "zstd").parquet(folder)
        _written[at] = folder
    return spark.read.parquet(_written[at])


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def sql_noise(x: str) -> str:
    """Whole-title noise, as in ``text.without_noise``."""
    out = f"regexp_replace(coalesce({x}, ''), '\\s*&\\s*', ' en ', 'g')"
    for pattern, option in (
        ("\\((\\s*\\d+(?:[.,]\\d+)?\\s*\\+|\\s*\\d+\\s*(?:-|t/m|tot)\\s*\\d+\\s*(?:jaar|maanden)?|\\s*try-?out|\\s*reprise|\\s*premi[eè]re|\\s*nieuw)\\s*\\)", "gi"),
        ("/\\s*\\d+\\s*\\+", "g"),
        ("[\\s,:–-]+(?:de|the)\\s+musical\\b", "gi"),
    ):
        out = f"regexp_replace({out}, '{pattern}', ' ', '{option}')"
    return out


def sql_parts(x: str) -> str:
    end = "regexp_replace(regexp_replace(d, '(?:^|[\\s–-]+)(?:reprise|try-?out)\\s*$', ' ', 'i'), '(?:^|\\s)\\d+\\s*\\+\\s*$', ' ')"
    split = f"regexp_split_to_array({sql_noise(x)}, '\\s+[–—-]\\s+|\\s+\\|\\s+|:\\s+')"
    return f"list_sort(list_distinct(list_filter(list_transform({split}, lambda d: {sql_norm(end)}), lambda p: p <> '')))"


_BOUND = ", ".join(f"'{t}'" for t in X.VENUE_BOUND_TITLES)


def sql_key(x: str, venue: str) -> str:
    return f"CASE WHEN array_to_string({sql_parts(x)}, ' | ') IN ({_BOUND}) THEN {venue} || '::' || array_to_string({sql_parts(x)}, ' | ') ELSE array_to_string({sql_parts(x)}, ' | ') END"


#: Start of each SQL on shows: WITH perf AS (...), to be followed by a SELECT or by ", other AS (...)".
SHOW_SQL = f"""WITH perf0 AS ({_BASE.format(s="varchar")}),
titles AS (SELECT DISTINCT titel, theaterId FROM perf0),
keyed AS (SELECT titel, theaterId, {sql_norm('titel')} AS norm, {sql_key('titel', 'theaterId')} AS sleutel FROM titles),
perf AS (SELECT s.*, k.norm, k.sleutel FROM perf0 s JOIN keyed k USING (titel, theaterId))
"""
