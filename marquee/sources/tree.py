"""Elements of saved pages as rows, and listing cards read from them.

A page's tree is cut up once, in Python, page by page; all else is joins of an element with what stands inside it: the
rows whose number lies between its own and that of its last descendant.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import checkpointed

#: Fixed: elements without content, those that end where the next of their kind begins, and what such an end stops at;
#: before all of BLOCKS an open p ends.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
FOLLOWED = {"li": ("ul", "ol"), "option": ("select",), "tr": ("table",), "td": ("tr", "table")}
BLOCKS = frozenset(("address", "article", "aside", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
TEXT = "#text"
_COLUMNS = "nr int, laatste int, diepte int, naam string, klassen array<string>, attributen map<string,string>, boven array<string>, tekst string"


class _Cut(HTMLParser):
    """Rows [nr, last, depth, name, classes, attributes, classes above, text] of one page; texts are rows, too."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def _add(self, name, classes=(), attributes=None, text=None):
        above = self.open[-1][6] + self.open[-1][4] if self.open else []
        self.rows.append([len(self.rows), len(self.rows), len(self.open), name, list(classes), attributes or {}, above, text])
        return self.rows[-1]

    def _end(self, name, stops=()):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][3] == name:
                for row in self.open[i:]:
                    row[1] = len(self.rows) - 1
                del self.open[i:]
                return
            if self.open[i][3] in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in FOLLOWED:
            self._end(tag, FOLLOWED[tag])
        if tag in BLOCKS:
            self._end("p", BLOCKS - {"p"})
        own = {k: v or "" for k, v in reversed(attrs)}  # of equal attributes the first counts
        row = self._add(tag, own.get("class", "").split(), own)
        if tag not in VOID:
            self.open.append(row)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # a slash closes nothing but elements without content

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        if data and not (self.open and self.open[-1][3] in ("script", "style")):
            self._add(TEXT, text=data)

    def done(self):
        for row in self.open:
            row[1] = len(self.rows) - 1
        return self.rows


def elements(pages: DataFrame, id: str, column: str = "html") -> DataFrame:
    """id, nr, laatste, diepte, naam, klassen, attributen, boven (classes of all elements around it) and tekst, a row an element or text.

    nr counts in the order of the page; what is inside an element has numbers from nr + 1 to laatste.  Null pages have none.
    The rows are written to the checkpoint folder: cards read them many times, and from pages alone Spark would take
    them for as few as to be broadcast.  Joins with them are merged, as they are many times larger than their file.
    """
    kind = pages.schema[id].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["nr", "laatste", "diepte", "naam", "klassen", "attributen", "boven", "tekst"]
        for batch in batches:
            for key, html in zip(batch["id"], batch["html"]):
                page = _Cut()
                page.feed(html or "")
                page.close()
                rows = pd.DataFrame(page.done(), columns=names)
                rows.insert(0, "id", pd.Series([key] * len(rows), dtype=batch["id"].dtype))
                yield rows

    found = pages.select(F.col(id).alias("id"), F.col(column).alias("html")).filter("html IS NOT NULL")
    return checkpointed(found.mapInPandas(cut, f"id {kind}, {_COLUMNS}").withColumnRenamed("id", id))


def _has(*classes: str) -> Column:
    """An element with the last of ``classes``, inside ones with the others."""
    cond = F.array_contains("e.klassen", classes[-1])
    for c in classes[:-1]:
        cond = cond & F.array_contains("e.boven", c)
    return cond


def _tag(name: str) -> Column:
    return F.col("e.naam") == name


#: Fixed: what counts as a button: element, class, and a class that it must not have; and any class with these letters.
BUTTONS = (("a", "btn-order", ""), ("a", "btn", "mobile-button"), ("button", "btn", "expand-sub"), ("span", "btn", ""))
BUTTON_CLASS = "status-"


def _button() -> Column:
    cond = F.exists("e.klassen", lambda c: F.contains(c, F.lit(BUTTON_CLASS)))
    for name, has, without in BUTTONS:
        cond = cond | (_tag(name) & _has(has) & ~_has(without))
    return cond


def _first(cond: Column) -> Column:
    """The first element for which ``cond`` holds, with the attributes that are asked for."""
    of = lambda name: F.col("e.attributen")[name].alias(name.removeprefix("data-event-"))
    return F.min(F.when(cond & (F.col("e.naam") != TEXT), F.struct("e.nr", "e.laatste", of("href"), of("data-event-start"), of("data-event-location"), of("data-event-hall"))))


def _texts(found: DataFrame, tree: DataFrame, id: str, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, and for each of ``fields`` (columns of picked elements) its text, squeezed; null where there is none."""
    each = found.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias("veld"), F.col(f"{f}.nr").alias("_van"), F.col(f"{f}.laatste").alias("_einde")) for f in fields])).alias("f")).select(*keys, "f.*").filter("_van IS NOT NULL")
    pieces = tree.filter(F.col("naam") == TEXT).select(F.col(id).alias("_id"), "nr", "tekst").hint("merge")
    said = each.join(pieces, (F.col(id) == F.col("_id")) & (F.col("nr") > F.col("_van")) & (F.col("nr") <= F.col("_einde")))
    text = F.nullif(X.squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "tekst"))), lambda x: x["tekst"]), "")), F.lit(""))
    one = said.groupBy(*keys, "veld").agg(text.alias("tekst"))
    return one.groupBy(*keys).agg(*[F.max(F.when(F.col("veld") == f, F.col("tekst"))).alias(f"{f}_tekst") for f in fields])


def _joined(found: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    same = None
    for k in keys:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = c if same is None else same & c
    return found.alias("l").join(texts.alias("r"), same, "left").select("l.*", *[f"r.{c}" for c in texts.columns if c not in keys])


def cards(tree: DataFrame, id: str) -> DataFrame:
    """id, entry, soort, titel, ondertitel, slagzin, href, genres and prijs of the cards in pages' ``elements``, a row a card."""
    keys = [id, "kaart", "tot"]
    found = _inside(_cards(tree, id), tree, id).groupBy(*keys, "entry", "soort").agg(
        _first(_tag("h3") & _has("title")).alias("titel"), _first(_has("subtitle")).alias("ondertitel"), _first(_has("tagline")).alias("slagzin"), _first(_tag("a") & _has("desc")).alias("link"), _first(_has("price")).alias("prijs"),
        F.array_sort(F.collect_list(F.when(_has("genres__link") & (F.col("e.naam") != TEXT), F.struct("e.nr", "e.laatste")))).alias("g"),
    )
    out = _joined(found, _texts(found, tree, id, keys, ["titel", "ondertitel", "slagzin", "prijs"]), keys)
    genre = found.select(*keys, F.explode("g").alias("genre"))
    genre = _texts(genre.select(*keys, "genre", F.col("genre.nr").alias("plaats")), tree, id, [*keys, "plaats"], ["genre"])
    genres = genre.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("plaats", "genre_tekst"))), lambda x: x["genre_tekst"]).alias("genres"))
    text = lambda f: F.col(f"{f}_tekst").alias(f)
    return _joined(out, genres, keys).select(id, "entry", "soort", text("titel"), text("ondertitel"), text("slagzin"), F.col("link.href").alias("href"), F.coalesce("genres", F.array().cast("array<string>")).alias("genres"), text("prijs"))


def _cards(tree: DataFrame, id: str) -> DataFrame:
    kind = F.get(F.filter("klassen", lambda c: F.startswith(c, F.lit("production-type-"))), 0)
    return tree.filter("naam = 'li' AND attributen['data-entry-id'] IS NOT NULL").select(id, F.col("nr").alias("kaart"), F.col("laatste").alias("tot"), F.col("attributen")["data-entry-id"].alias("entry"), F.regexp_replace(kind, "^production-type-", "").alias("soort"))


def _inside(outer: DataFrame, tree: DataFrame, id: str, start: str = "kaart", end: str = "tot") -> DataFrame:
    """Each row of ``outer`` with the elements ``e`` between its numbers; a row with none stays."""
    o = outer.alias("o")
    return o.join(tree.hint("merge").alias("e"), (F.col(f"o.{id}") == F.col(f"e.{id}")) & (F.col("e.nr") > F.col(f"o.{start}")) & (F.col("e.nr") <= F.col(f"o.{end}")), "left").select("o.*", F.struct("e.*").alias("e"))


def card_rows(tree: DataFrame, id: str) -> DataFrame:
    """id, entry, plaats, eigen, start, datum, tijd, locatie, zaal, knop, link: the dates of each card, in one of three layouts.

    With a panel of dates (an element of id ``show<entry>Dates``, wherever it stands) its rows of class ``subshow`` count;
    else the card itself has one date, in ``dateTimeInner`` or in its description.
    """
    cards_ = _cards(tree, id)
    panels = tree.filter("attributen['id'] IS NOT NULL").select(F.col(id).alias("_id"), F.col("attributen")["id"].alias("_naam"), F.col("nr").alias("_nr"), F.col("laatste").alias("_tot"))
    first = panels.groupBy("_id", "_naam").agg(F.min(F.struct("_nr", "_tot")).alias("p"))  # of equal ids the first element
    held = cards_.join(first, (F.col(id) == F.col("_id")) & (F.col("_naam") == F.concat(F.lit("show"), "entry", F.lit("Dates"))), "left").select(*cards_.columns, F.col("p._nr").alias("van"), F.col("p._tot").alias("einde"))
    shows_ = _inside(held.filter("van IS NOT NULL"), tree, id, "van", "einde").filter(_tag("li") & _has("subshow") & ~_has("location-group-toggle-wrapper") & ~_has("load-more-panel"))
    shows_ = shows_.select(id, "kaart", "entry", F.col("e.nr").alias("rij"), F.col("e.laatste").alias("tot"), F.when(_has("in-own-location"), True).when(_has("in-other-location"), False).alias("eigen"))
    keys = [id, "kaart", "rij", "tot"]
    one = _inside(shows_, tree, id, "rij").groupBy(*keys, "entry", "eigen").agg(
        _first(F.col("e.attributen")["data-event-start"].isNotNull()).alias("begin"), _first(_has("date", "start")).alias("datum"), _first(_has("time", "start")).alias("tijd"), _first(_has("location")).alias("locatie"),
        _first(_has("venue")).alias("zaal"), _first(_button() & F.array_contains("e.boven", "buttonBox")).alias("knop"), _first(_has("buttonBox")).alias("doos"),
    )
    one = _joined(one, _texts(one, tree, id, keys, ["datum", "tijd", "locatie", "zaal", "knop", "doos"]), keys)
    t = lambda f: F.col(f"{f}_tekst")
    panel = one.select(id, "entry", "kaart", "rij", "eigen", F.col("begin.start").alias("start"), t("datum").alias("datum"), t("tijd").alias("tijd"), t("locatie").alias("locatie"), t("zaal").alias("zaal"), F.coalesce(t("knop"), t("doos")).alias("knop"), F.col("knop.href").alias("link"))
    alone = cards_.join(shows_.select(id, "kaart").distinct(), [id, "kaart"], "left_anti")
    keys = [id, "kaart", "tot"]
    ways = ["k1", "k2", "k3", "k4"]
    one = _inside(alone, tree, id).groupBy(*keys, "entry").agg(
        _first(F.col("e.attributen")["data-event-start"].isNotNull()).alias("begin"), _first(_has("dateTimeInner", "date", "start")).alias("d1"), _first(_has("desc", "top-date", "start")).alias("d2"), _first(_has("dateTimeInner", "time", "start")).alias("t1"),
        _first(_has("desc", "top-date", "time")).alias("t2"), _first(_has("desc", "location")).alias("l"), _first(_has("desc", "venue")).alias("z"), _first(_tag("a") & _has("btn-order")).alias("k1"),
        _first(_tag("a") & F.array_contains("e.boven", "meta-group") & F.array_contains("e.boven", "button")).alias("k2"), _first(_button() & F.array_contains("e.boven", "dateTimeInner")).alias("k3"), _first(_button()).alias("k4"),
    )
    one = one.withColumn("k", F.coalesce(*ways))
    one = _joined(one, _texts(one, tree, id, keys, ["d1", "d2", "t1", "t2", "l", "z", "k"]), keys)
    none = F.lit(None).cast("boolean")
    card = one.select(id, "entry", "kaart", F.lit(0).alias("rij"), none.alias("eigen"), F.col("begin.start").alias("start"), F.coalesce(t("d1"), t("d2")).alias("datum"), F.coalesce(t("t1"), t("t2")).alias("tijd"), F.coalesce("k.location", t("l")).alias("locatie"), F.coalesce("k.hall", t("z")).alias("zaal"), t("k").alias("knop"), F.col("k.href").alias("link"))
    place = F.row_number().over(W.partitionBy(id, "kaart").orderBy("rij"))
    return panel.unionByName(card).withColumn("plaats", place).select(id, "entry", "plaats", "eigen", "start", "datum", "tijd", "locatie", "zaal", "knop", "link")
