"""Queries on cards of saved pages: a page for every hundred parts, its cards in three layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import tree
from .shows import table

_PANEL = """<div class="wrap"><div><div id='show{k}Dates'><ul><li class="location-group-toggle-wrapper subshow"><div class="date"><b class="start">kop</b></div></li>
<li class="{own} subshow"><ul><li class=x data-event-start="1998-03-{d} 20:15:00">los</li></ul><div class='date'><span class='start'>{d} <i>mrt</i></span></div><div class="time"><span class="start">20:15</span></div><span class=venue>Zaal {s}</span>
<div class="buttonBox"><a class="mobile-button btn" href="#">mobiel</a><div><a href='/t/{k}' class='btn'>{t}</a></div></div></li>{more}</ul></div></div></div>"""
_MORE = '<li class="subshow in-other-location"><div class="buttonBox">  Uitverkocht\n </div></li>'
_INNER = """<div class="dateTimeInner"><div class="date"><b class="start">{d}&nbsp;mrt</b></div><button class="btn expand-sub">+</button><em class="is-status-{s}">{t}</em></div>"""
_DESC = """<div class='desc'><div class="top-date"><span class="start">{d} mrt</span> <span class="time">19:30</span></div><span class="location">Hier</span></div><div class="button meta-group"><a data-event-hall="Zaal {s}" href="/b/{k}" data-event-location="{b}">{t}</a></div>"""


def _sql(layout: str) -> str:
    """A layout as an SQL expression of the columns of part."""
    values = {"k": "p_partkey", "d": "10 + p_size % 18", "s": "p_size", "b": "p_brand", "t": "p_type", "own": "CASE WHEN p_size % 2 = 0 THEN 'in-own-location' ELSE 'last' END", "more": f"CASE WHEN p_size % 3 = 0 THEN '{_MORE}' ELSE '' END"}
    out = "'" + layout.replace("'", "\\'") + "'"
    for name, of in values.items():
        out = out.replace(f"{{{name}}}", f"', {of.replace(chr(10), ' ')}, '")
    return f"concat({out})"


_CARD = f"""concat('<li', CASE WHEN p_size % 2 = 0 THEN concat(' data-entry-id="', p_partkey, '" class="card production-type-', lower(p_type), '"') ELSE concat(" class='production-type-", lower(p_type), " card' data-entry-id=", p_partkey) END, '>',
 '<a href="/p/', p_partkey, '?x=1&amp;y=2" class="link desc"><h3 class="title"><span>', p_name, '</span> &amp; <b>', p_brand, '</b></h3></a>', CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('<p class="subtitle">', p_type, '<ul><li class="genres__link">A', p_size, '<li class="genres__link"> B </ul>') END,
 CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN {_sql(_INNER)} ELSE {_sql(_DESC)} END, '</li>', CASE WHEN p_partkey % 3 = 0 THEN {_sql(_PANEL)} ELSE '' END)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = _CARD.replace("\n", " ")
    pages = spark.sql(f"SELECT p_partkey div 100 AS pagina, concat('<ul>', array_join(collect_list({card}), ' '), '</ul>') AS html FROM {{part}} GROUP BY 1", part=table(spark, sf_dir, "part"))
    return tree.elements(pages, "pagina")


def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.cards(_tree(spark, sf_dir), "pagina")


def card_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.card_rows(_tree(spark, sf_dir), "pagina")


QUERIES = {f.__name__: f for f in (card_fields, card_layouts)}

ORACLE_SQL = {
    "card_fields": """SELECT p_partkey // 100 AS pagina, p_partkey::VARCHAR AS entry, lower(p_type) AS soort, p_name || ' & ' || p_brand AS titel, CASE WHEN p_size % 5 <> 0 THEN p_type END AS ondertitel, NULL::VARCHAR AS slagzin,
 '/p/' || p_partkey || '?x=1&y=2' AS href, CASE WHEN p_size % 5 <> 0 THEN ['A' || p_size, 'B'] ELSE [] END AS genres, NULL::VARCHAR AS prijs FROM part""",
    "card_layouts": """WITH b AS (SELECT p_partkey // 100 AS pagina, p_partkey::VARCHAR AS entry, p_partkey % 3 AS r, (10 + p_size % 18)::VARCHAR AS d, * FROM part)
SELECT pagina, entry, 1 AS plaats, CASE WHEN r = 0 AND p_size % 2 = 0 THEN true END AS eigen, CASE WHEN r = 0 THEN '1998-03-' || d || ' 20:15:00' END AS start, d || ' mrt' AS datum, CASE r WHEN 0 THEN '20:15' WHEN 2 THEN '19:30' END AS tijd,
 CASE WHEN r = 2 THEN p_brand END AS locatie, CASE WHEN r <> 1 THEN 'Zaal ' || p_size END AS zaal, p_type AS knop, CASE r WHEN 0 THEN '/t/' || p_partkey WHEN 2 THEN '/b/' || p_partkey END AS link FROM b
UNION ALL SELECT pagina, entry, 2, false, NULL, NULL, NULL, NULL, NULL, 'Uitverkocht', NULL FROM b WHERE r = 0 AND p_size % 3 = 0""",
}
