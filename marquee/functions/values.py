"""Prices, times, availability and genre from source texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD_END, WORD_START, S, cut, fold, squeeze, strip

CANCELLED = ("afgelast", "verplaatst")
FULL = ("uitverkocht", "wachtlijst")
AVAILABILITY = ("beschikbaar", "uitverkocht", "wachtlijst", "onbekend", *CANCELLED)
GENRES = ("Toneel", "Musical", "Cabaret", "Muziektheater", "Dans", "Familie & Jeugd", "Muziek & Concert", "Overig")
#: Decides ties between genres.
SPECIFIC_FIRST = ("Familie & Jeugd", "Musical", "Cabaret", "Dans", "Muziektheater", "Muziek & Concert", "Toneel")

# Words by which titles and tags are told to be something else than a performance.
_LETTER = "[^\\p{L}]"
WORKSHOP = f"(?i)^(?:[^\\s–:]+{S}+){{0,2}}(?:workshop|cursus|masterclass){WORD_END}"
WORKSHOP_WORD = f"(?iu)(^|{_LETTER})(?:\\p{{L}}+(?:workshops?|cursus(?:sen)?|masterclass(?:es)?)|workshops|cursussen|masterclasses)($|{_LETTER})"
WORKSHOP_TAGS = ("workshop", "workshops", "cursus", "cursussen", "masterclass")
STILL_A_SHOW = (f"(?i)^masterclass igone de jongh{WORD_END}", f"(?i)^masterclass revolta{WORD_END}")
FILM_TAGS = ("film", "films", "familiefilm", "jeugdfilm", "animatie", "actie", "arthouse", "drama", "komedie", "documentaire", "jeugd")
FILM = ("film", "films", "familiefilm", "jeugdfilm")
STAGE = "(?i)theater|theatre|toneel|dans|ballet|muziek|music|concert|cabaret|comedy|stand-up|musical|opera|klassiek|show|performance|circus|kleinkunst|spoken word|poëzie|jazz|(^|\\s)pop($|\\s)|voorstelling"
FILM_TITLES = (
    f"(?i)^cinekid festival{WORD_END}",
    f"(?i)^underground cinema{WORD_END}",
    f"(?i)^european outdoor film tour{WORD_END}",
    f"(?i)^diner zin in film{WORD_END}",
    f"(?i)^filmvertoning{WORD_END}",
    f"(?i){WORD_START}film{S}*(?::|{S}[–|]{S}|\\((?:al|\\d+\\+)\\)|$)",
)
TOUR = f"(?iu)(^|{_LETTER})rondleiding(?:en)?($|{_LETTER})|(^|{_LETTER})(?:guided|public) tours?($|{_LETTER})|^kijkje achter de schermen($|{_LETTER})"
QUIZ = f"(?iu)(^|{_LETTER})\\p{{L}}*quiz($|{_LETTER})"
QUIZ_STILL_A_SHOW = (f"(?i)^niet zomaar een pubquiz{WORD_END}", f"(?i)^interactieve muziekquiz{WORD_END}")
EXTRA_COSTS = "(?i)extra kosten|servicekosten"
AMOUNT = f"€{S}*(\\d+(?:\\.\\d{{3}})*)(?:[,.](\\d{{2}})|,-)?"


def lowest_price(text: Column) -> Column:
    """Lowest amount in euro before any extra costs; 0 for "gratis"; null without either."""
    relevant = F.element_at(F.split(text, EXTRA_COSTS, -1), 1)
    whole, cents = F.regexp_extract_all(relevant, F.lit(AMOUNT), F.lit(1)), F.regexp_extract_all(relevant, F.lit(AMOUNT), F.lit(2))
    amounts = F.zip_with(whole, cents, lambda w, c: F.concat(F.replace(w, F.lit("."), F.lit("")), F.lit("."), F.when(c == "", "00").otherwise(c)).cast("double"))
    return F.when(F.size(amounts) > 0, F.array_min(amounts)).when(relevant.rlike("(?i)gratis"), F.lit(0.0))


def first_time(text: Column) -> Column:
    """First h:mm or h.mm of a text as hh:mm, whatever its range."""
    pattern = "([0-9]{1,2})[:.]([0-9]{2})"
    return F.when(text.rlike(pattern), F.concat(F.lpad(F.regexp_extract(text, pattern, 1), 2, "0"), F.lit(":"), F.regexp_extract(text, pattern, 2)))


def cancelled_status(text: Column) -> Column:
    """verplaatst, afgelast or null from the text of a button or label."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return F.when(t.rlike("verplaatst|postponed|rescheduled"), "verplaatst").when(t.rlike("geannuleerd|afgelast|gecancel?d|cancel?led|gaat niet door"), "afgelast")


def is_cancelled(status: Column) -> Column:
    return F.coalesce(status.isin(*CANCELLED), F.lit(False))


def is_full(status: Column) -> Column:
    return F.coalesce(status.isin(*FULL), F.lit(False))


def genre_key(label: Column) -> Column:
    """A label's parts, lower-cased and sorted: "Jeugd en familie" is "familie & jeugd"."""
    parts = cut(F.lower(strip(label)), f"{S}*(?:&|/|,|\\+|{S}+en{S}+){S}*")
    return F.array_join(F.array_sort(F.filter(F.transform(parts, strip), lambda p: p != "")), " & ")


def with_genre(rows: DataFrame, label: str, genres: DataFrame, into: str = "genre") -> DataFrame:
    """``rows`` with the category of ``label``: by the label itself, else by its key, else "Overig"; null without a label.

    ``genres`` are label and category, a small dimension; labels that repeat are taken once.
    """
    exact = genres.groupBy(F.lower(strip(F.col("label"))).alias("_exact")).agg(F.max("category").alias("_by_label"))
    keyed = genres.groupBy(genre_key(F.col("label")).alias("_key")).agg(F.max("category").alias("_by_key"))
    named = rows.withColumns({"_exact": F.lower(strip(F.col(label))), "_key": genre_key(F.col(label))})
    out = named.join(exact, "_exact", "left").join(keyed, "_key", "left")
    found = F.when(F.coalesce(F.col(label), F.lit("")) != "", F.coalesce("_by_label", "_by_key", F.lit("Overig")))
    return out.withColumn(into, found).drop("_exact", "_key", "_by_label", "_by_key")


def first_genre(rows: DataFrame, tags: str, id: str, genres: DataFrame) -> DataFrame:
    """id and genre of the first tag that is a known label; null where none is."""
    exploded = rows.select(id, F.posexplode(tags).alias("pos", "tag"))
    known = with_genre(exploded, "tag", genres)
    named = genres.select(genre_key(F.col("label")).alias("k")).distinct()
    hits = known.withColumn("k", genre_key(F.col("tag"))).join(named, "k", "left_semi")
    first = hits.groupBy(id).agg(F.min_by("genre", "pos").alias("genre"))
    return rows.select(id).join(first, id, "left")


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def not_a_show(title: Column, tags: Column) -> Column:
    """workshop, film, rondleiding, quiz, or null for a performance; ``tags`` is the source's genre text."""
    t = strip(F.coalesce(title, F.lit("")))
    g = F.filter(F.transform(cut(F.coalesce(tags, F.lit("")), f"{S}*[,|/;]{S}*"), lambda x: F.lower(strip(x))), lambda x: x != "")
    workshop = t.rlike(WORKSHOP) | t.rlike(WORKSHOP_WORD) | ((F.size(g) > 0) & F.forall(g, lambda x: x.isin(*WORKSHOP_TAGS)))
    film = F.exists(g, lambda x: x.isin(*FILM)) & (F.forall(g, lambda x: x.isin(*FILM_TAGS)) | ~F.exists(g, lambda x: x.rlike(STAGE)))
    return (
        F.when(workshop & ~_any(t, STILL_A_SHOW), "workshop")
        .when(film | _any(t, FILM_TITLES), "film")
        .when(t.rlike(TOUR), "rondleiding")
        .when(t.rlike(QUIZ) & ~_any(t, QUIZ_STILL_A_SHOW), "quiz")
    )


def first_name_in(names: list[str], *texts: Column) -> Column:
    """The first of ``names`` that stands in any of the texts, whatever their case and accents."""
    hay = fold(F.lower(F.concat_ws(" ", *texts)))
    return F.get(F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(hay, fold(F.lower(n)))), F.lit(0))


def text_drift(body: Column, expected: str, start: str) -> Column:
    """gelijk, gewijzigd or weg: does a page still hold an expected text, or a text that starts as it does?"""
    seen = squeeze(F.coalesce(body, F.lit("")))
    return F.when(F.contains(seen, F.lit(" ".join(expected.split()))), "gelijk").when(F.contains(seen, F.lit(start)), "gewijzigd").otherwise("weg")


def valid_rating(rating: Column) -> Column:
    """1 to 5 in steps of a half."""
    return F.coalesce(rating.between(1, 5) & (rating * 2 == F.floor(rating * 2)), F.lit(False))


def rating_text(rating: Column) -> Column:
    shown = F.when(rating == F.floor(rating), rating.cast("int").cast("string")).otherwise(rating.cast("string"))
    return F.when(valid_rating(rating), F.replace(shown, F.lit("."), F.lit(",")))


def count_text(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, "Geen komende voorstellingen").otherwise(F.concat(n.cast("string"), F.lit(" komende voorstelling"), F.when(n == 1, "").otherwise("en")))
