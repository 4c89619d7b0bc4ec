"""Documents made of tables: venue view, report by province, run summary, invitation text; and marked blocks of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from .agenda import pass_state

PAUSED = "Agenda tijdelijk niet beschikbaar. Bekijk de voorstellingen op de website van het theater."


def venue_view(venues: DataFrame) -> DataFrame:
    """theaterId and json: what a reader needs of each venue; a paused one without a notice gets one with a link."""
    paused = F.coalesce("gepauzeerd", F.lit(False))
    default = paused & F.col("melding").isNull()
    view = F.struct("naam", "stad", "podiumpas", F.when(default, PAUSED).otherwise(F.col("melding")).alias("melding"), F.when(default, F.col("agendaUrl")).alias("meldingLink"), "lat", "lng", F.when(paused, True).alias("gepauzeerd"))
    return venues.select("theaterId", F.to_json(view).alias("json"))


def report(venues: DataFrame, shows: DataFrame, status: DataFrame) -> DataFrame:
    """provincie, n, tekst: a Markdown table of the venues of each province."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("–")), F.lit("|"), F.lit("\\|"))
    passes = pass_state(shows).select("theaterId", "aandeel")
    rows = venues.join(passes, "theaterId", "left").join(status.select("theaterId", "status"), "theaterId", "left")
    line = F.concat(F.lit("| "), cell(F.col("naam")), F.lit(" | "), cell(F.col("stad")), F.lit(" | "), F.coalesce("aandeel", F.lit("–")), F.lit(" | "), cell(F.coalesce("status", F.lit("onbekend"))), F.lit(" |"))
    sums = rows.groupBy("provincie").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("stad", "naam", line.alias("l")))).alias("r"))
    head = F.concat(F.lit("**"), "provincie", F.lit("** ("), F.col("n").cast("string"), F.lit(")\n\n| Theater | Stad | Podiumpas | Status |\n|---|---|---|---|\n"))
    return sums.select("provincie", "n", F.concat(head, F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("tekst"))


def counts(venues: DataFrame, shows: DataFrame) -> DataFrame:
    """One row: theaters, titels (a title at a venue), speeldata."""
    some = lambda d, *aggs: d.agg(*aggs).withColumn("_k", F.lit(0))
    a = some(shows, F.countDistinct("theaterId", "titel").alias("titels"), F.count(F.lit(1)).alias("speeldata"))
    return some(venues, F.count(F.lit(1)).alias("theaters")).join(a, "_k").drop("_k")


def replace_blocks(text: Column, blocks: dict[str, Column]) -> Column:
    """Text between ``<!-- AUTO:name:start -->`` and ``<!-- AUTO:name:end -->`` replaced; a marker that is missing, there twice or behind its end is an error."""
    out = text
    for name, body in blocks.items():
        start, end = f"<!-- AUTO:{name}:start -->", f"<!-- AUTO:{name}:end -->"
        once = lambda m, t: (F.length(t) - F.length(F.replace(t, F.lit(m)))) == len(m)
        fine = once(start, out) & once(end, out) & (F.instr(out, start) < F.instr(out, end))
        made = F.concat(F.substring_index(out, start, 1), F.lit(start + "\n"), X.strip(body), F.lit("\n" + end), F.substring_index(out, end, -1))
        out = F.when(fine, made).otherwise(F.raise_error(F.lit(f"marker {name}")).cast("string"))
    return out


def run_summary(verdict: DataFrame, day: Column) -> DataFrame:
    """niveau and tekst: the summary of a run's verdict (``runs.verdict``)."""
    head = F.when(F.col("niveau") == "ok", "Nachtrun ok").when(F.col("niveau") == "waarschuwing", "Nachtrun ok, met terugval").otherwise("Nachtrun: aandacht nodig")
    reasons = F.array_join(F.transform("redenen", lambda r: F.concat(F.lit("- "), r)), "\n")
    table = F.concat_ws(" | ", F.lit("|"), *[F.col(c).cast("string") for c in ("ok", "leeg", "gepauzeerd", "terugval")])
    return verdict.select("niveau", F.concat(F.lit("## "), head, F.lit(" ("), day.cast("string"), F.lit(")\n\n"), reasons, F.lit("\n\n| ok | leeg | gepauzeerd | terugval |\n|---|---|---|---|\n"), F.regexp_replace(table, "^\\| \\|", "|"), F.lit(" |")).alias("tekst"))


def invitation(rows: DataFrame, app_url: str) -> DataFrame:
    """onderwerp, tekst and html of invitations (gebruikersnaam, naam, titel, theaterNaam, stad, datum, tijd); all on one line each, html escaped."""
    line = lambda c: X.squeeze(F.coalesce(c, F.lit("")))
    who = F.concat(F.lit("@"), line(F.col("gebruikersnaam")))
    name = F.when(line(F.col("naam")) != "", F.concat(F.lit(" ("), line(F.col("naam")), F.lit(")"))).otherwise("")
    when = F.array_join(F.filter(F.array(D.day_text(F.col("datum")), line(F.col("tijd"))), lambda x: x != ""), " · ")
    where = F.array_join(F.filter(F.array(line(F.col("theaterNaam")), line(F.col("stad"))), lambda x: x != ""), ", ")
    url = app_url.rstrip("/") + "/#/berichten"
    title = line(F.col("titel"))
    text = F.concat_ws("\n", F.lit("Hoi,"), F.lit(""), F.concat(who, name, F.lit(" nodigt je uit om samen naar een voorstelling te gaan:")), F.lit(""), title, when, where, F.lit(""), F.lit(url))
    e = X.escaped_html
    html = F.concat(F.lit("<p>"), e(F.concat(who, name)), F.lit(" nodigt je uit:</p><p><b>"), e(title), F.lit("</b><br>"), e(when), F.lit("<br>"), e(where), F.lit(f'</p><p><a href="{url}">{url}</a></p>'))
    return rows.select(*rows.columns, F.concat(who, F.lit(" nodigt je uit voor "), title).alias("onderwerp"), text.alias("tekst"), html.alias("html"))
