"""Title rules on small examples of our own."""

import pytest
from pyspark.sql import functions as F

from marquee.functions import dates as D
from marquee.functions import text as X
from marquee.functions import values as V


def each(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *[c(F.col("t")).alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r["c0"] for r in rows]


def test_fold_and_forms(spark):
    assert each(spark, ["ÀÉÎõü Ø ß", "é å", None], X.fold) == ["AEIou Ø ß", "e a", None]
    assert each(spark, ["  Café-Théâtre !  Nr. 7 "], X.normal_title, X.slug, X.search_form) == [("cafe theatre nr 7", "cafe-theatre-nr-7", "cafe-theatre ! nr. 7")]


@pytest.mark.parametrize(
    "title, key",
    [
        ("Winterlicht – Ada Lint", "ada lint | winterlicht"),
        ("Ada Lint - Winterlicht (6+)", "ada lint | winterlicht"),
        ("winterlicht: Ada Lint 8+", "ada lint | winterlicht"),
        ("Winterlicht (try-out) | Ada Lint – reprise", "ada lint | winterlicht"),
        ("Mia & Co", "mia en co"),
        ("Het Bos – De Musical (3-7 jaar)", "het bos"),
        ("Winter-licht", "winter licht"),
        ("reprise", ""),
        ("Cabaret", "v1::cabaret"),
        (None, ""),
    ],
)
def test_production_key(spark, title, key):
    assert each(spark, [title], lambda t: X.production_key(t, F.lit("v1"))) == [key]


def test_display_title(spark):
    rows = spark.createDataFrame([("Ada Lint zingt", "Ada Lint"), ("Winterlicht", " Ada Lint "), ("Winterlicht", None), ("Adagio", "Ada"), (None, "x")], "t string, m string")
    assert [r[0] for r in rows.select(X.display_title(F.col("t"), F.col("m"))).collect()] == ["Ada Lint zingt", "Winterlicht – Ada Lint", "Winterlicht", "Adagio – Ada", " – x"]


def test_labels_status_series(spark):
    labels = lambda t: F.concat_ws("/", X.labels_from_title(t)[0], F.array_join(X.labels_from_title(t)[1], ","))
    assert each(spark, ["Bos (Try-out) – Mia", "Bos – première", "(reprise)", "Bos (reprise) & Zee (try out)", "Kooi – Try-out – Mia"], labels) == ["Bos – Mia/try-out", "Bos/première", "(reprise)/", "Bos & Zee/reprise,try out", "Kooi – Mia/try-out"]
    status = lambda t: F.concat_ws("/", *X.status_from_title(t))
    assert each(spark, ["Bos – UITVERKOCHT!", "Laatste kaarten", "wachtlijst | Bos", "Bos (bijna uitverkocht)", "Bos - Verplaatst"], status) == ["Bos/uitverkocht", "Laatste kaarten", "Bos/wachtlijst", "Bos/beschikbaar", "Bos/verplaatst"]
    assert each(spark, ["Bos - geannuleerd", "Afgelast | Bos", "Bos (verplaatst) – Mia", "Geannuleerd"], X.without_status_word) == ["Bos", "Bos", "Bos – Mia", "Geannuleerd"]
    series = lambda t: F.concat_ws("/", *X.series_from_title(t, ["Herfst*", "Zomer"]))
    assert each(spark, ["herfst*: Het Bos", "Zomer:", "Zomerlicht: x"], series) == ["Het Bos/herfst*", "Zomer:", "Zomerlicht: x"]


def test_makers(spark):
    assert each(spark, ["Met: Jan", "12+", "(8 t/m 12 jaar)", "40 jaar", "Live", "Ada Lint", "try-out", "Live in Theater (reprise)"], X.never_maker) == [True, True, True, True, True, False, True, False]
    texts = ["De officiële show", "Het Bos de Musical", "Ada Lint e.a.", "Ada als Mia", "Bos is terug!", "LUDIQUE!", "Ada, Bo, Cas", "Ensemble Gamut!", "een lied over de lange weg naar huis", "Ada Lint en Bo Kast", "Nationaal Musical Theater", None]
    assert each(spark, texts, X.slogan_kind) == ["officieel", "musical", "cast", "cast", "uitroep", None, "cast", None, "zin", None, None, None]
    assert each(spark, ["Ada / Toneelhuis", "Ada/Bo", "a/d Kade", "Ada"], X.maker_core) == ["Ada", "Ada", "a/d Kade", "Ada"]


def test_values(spark):
    assert each(spark, ["€ 22,50 of € 15,-", "v.a. € 1.250,75", "gratis", "€ 9 Extra kosten € 1", "nog niet", None], V.lowest_price) == [15.0, 1250.75, 0.0, 9.0, None, None]
    assert each(spark, ["om 8.30 uur", "20:15-22:00", "geen", None], V.first_time) == ["08:30", "20:15", None, None]
    assert each(spark, ["4.5", "5.5", "3.3", "1.0", None], lambda c: V.rating_text(c.cast("double"))) == ["4,5", None, None, "1", None]
    assert each(spark, ["Jeugd & familie", "familie / jeugd", "Jeugd en familie"], V.genre_key) == ["familie & jeugd"] * 3


def test_genres(spark):
    genres = spark.createDataFrame([("jeugd & familie", "Familie & Jeugd"), ("kleinkunst", "Cabaret"), ("kleinkunst", "Cabaret")], "label string, category string")
    rows = spark.createDataFrame([(1, " Kleinkunst "), (2, "Familie en jeugd"), (3, "onbekend"), (4, ""), (5, None)], "i int, raw string")
    assert [r["genre"] for r in V.with_genre(rows, "raw", genres).orderBy("i").collect()] == ["Cabaret", "Familie & Jeugd", "Overig", None, None]
    tags = spark.createDataFrame([(1, ["PREMIÈRE", "Kleinkunst", "Jeugd & Familie"]), (2, ["x"]), (3, [])], "i int, tags array<string>")
    assert [r["genre"] for r in V.first_genre(tags, "tags", "i", genres).orderBy("i").collect()] == ["Cabaret", None, None]


def test_redaction_and_escapes(spark):
    assert each(spark, ["mail a.b+c@x-y.nl  of bel 06 1234 5678", "+31 20-123 4567 nu", "nr 12345"], X.redacted) == ["mail [e-mail] of bel [telefoon]", "[telefoon] nu", "nr 12345"]
    assert each(spark, ["a" * 301], X.redacted) == ["a" * 300 + "…"]
    assert each(spark, ["<a & \"b\" 'c'>"], X.escaped_html) == ["&lt;a &amp; &quot;b&quot; &#39;c&#39;&gt;"]
    assert each(spark, ["a,b;c\\d\ne"], X.escaped_ics) == ["a\\,b\\;c\\\\d\\ne"]


def test_date_choices():
    w = D.When.clean(quick="week", first="x", last=None, weekdays=[7, 1, 1, 9, True, "2"])
    assert w == D.When("week", None, None, (1, 7))
    assert D.When.clean(quick="week", first="2026-01-02").quick is None
    assert w.toggle_quick("week").quick is None and w.toggle_weekday(1).weekdays == (7,) and w.with_date(first=D.date(2026, 1, 1)).quick is None


def test_dates(spark):
    assert [str(d) for d in each(spark, ["vr 13 November 2026", "30 februari 2026", "13 nov 2026"], D.with_year)] == ["2026-11-13", "None", "None"]
    rows = spark.createDataFrame([("2026-03-28T22:59:59", "2026-03-29T22:00:00")], "a string, b string").selectExpr("to_timestamp(a) a", "to_timestamp(b) b")
    assert rows.select(D.nights(F.col("a"), F.col("b"))).first()[0] == 3


def test_names_and_drift(spark):
    assert each(spark, ["Met ADÉ en Bo", "niemand", None], lambda t: V.first_name_in(["Bo K", "ade", "bo"], t, F.lit(None))) == ["ade", None, None]
    assert each(spark, ["x  De lijst:\n a, b  y", "De lijst: a, c", "anders"], lambda t: V.text_drift(t, "De lijst: a, b", "De lijst")) == ["gelijk", "gewijzigd", "weg"]


def test_cuts_are_splits(spark):
    bits = [" – ", " | ", ": ", " - ", "/", " & ", "Ada", "é", " ", "8+", "(try-out)", " reprise", ",", " en ", ""]
    rows = [("".join(bits[(i * 7 + j * j * (i + 3)) % len(bits)] for j in range(i % 9)),) for i in range(400)] + [("",), (None,), (" – ",), (" – Ada – ",)]
    df = spark.createDataFrame(rows, "t string")
    for pattern in (X.SEPARATOR, X.RAW_SEPARATOR, X.CORE_SEPARATOR, f"{X.S}*(?:&|/|,|\\+|{X.S}+en{X.S}+){X.S}*"):
        assert df.filter(~X.cut(F.col("t"), pattern).eqNullSafe(F.split("t", pattern, -1))).isEmpty()
    # patterns that a title cannot meet are skipped, with the same result
    noise = F.regexp_replace(F.coalesce("t", F.lit("")), X.AMPERSAND, " en ")
    for pattern in (X.BRACKETS, X.SLASH_AGE, X.THE_MUSICAL):
        noise = F.regexp_replace(noise, pattern, " ")
    assert df.filter(X.without_noise(F.col("t")) != noise).isEmpty()
    assert df.filter(~X.without_end_noise(F.col("t")).eqNullSafe(F.regexp_replace(F.regexp_replace("t", X.END_WORD, " "), X.END_AGE, " "))).isEmpty()
