"""Elements of pages as rows, and cards in three layouts."""

from marquee.sources import tree

PANEL = """
<ul class="listing"><!-- <li data-entry-id="99"> -->
 <li class='card production-type-comedy' data-entry-id="7"><div class="x"><div class="y"></div><a class="desc" href="/p/7?a=1&amp;b=2"><h3 class="big title">Caf&eacute;
   <em>Noir</em> &amp; Co</h3></a></div><p class="subtitle">Ada <b>Lint</b><p class=tagline>Kort
   <ul><li class="genres__link"> Cabaret </li><li class="genres__link">Dans</li></ul><span class="price">&euro; 12,50</span><script>var x = '<h3 class="title">nee</h3>';</script></li>
 <li data-entry-id="8" class="card"><h3 class="title">Leeg</h3></li>
</ul>
<div id="show7Dates"><ul>
 <li class="subshow location-group-toggle-wrapper"><span class="venue">kop</span></li>
 <li class="subshow in-own-location"><ul><li data-event-start="2026-11-02 20:15:00"></li></ul><div class="date"><i class="start">ma 2</i></div><div class="time"><i class="start">20:15</i></div>
   <span class="location">Hier</span><span class="venue">Zaal 1</span><div class="buttonBox"><a class="btn mobile-button" href="/m">Mobiel</a><div><a href='/t/7' class='btn'>Bestel</a></div></div></li>
 <li class="in-other-location subshow"><div class="buttonBox"> Uit&shy;verkocht </div></li>
 <li class="subshow"><div class="buttonBox"><em class="is-status-late">Laatste</em></div></li>
 <li class="subshow load-more-panel">meer</li></ul></div>
<div id="show7Dates"><li class="subshow">nogmaals</li></div>
"""
ONE = """<li data-entry-id=1><span class="btn">los</span><div class="dateTimeInner"><div class="date"><b class="start">do 5</b></div><div class="time"><b class="start">19.30</b></div><button class="btn expand-sub">+</button><button class="btn">Info</button></div></li>
<li data-entry-id="2" class="production-type-a production-type-b"><div class="desc"><div class="top-date"><span class="start">vr 6</span><span class="time">21:00</span></div><span class="location">Hier</span><span class="venue">Daar</span></div>
<div class="meta-group button"><a href="/b" data-event-location="Elders" data-event-hall="Grote zaal">Tickets</a></div></li>"""


def found(spark, *pages):
    return tree.elements(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "pagina int, html string").repartition(2), "pagina")


def test_nested_elements_of_one_name(spark):
    rows = found(spark, "<div a=1 A=2 class='q r'>x<div>y<br/>z</div>&lt;<DIV></div></div><li>a<li>b<ul><li>c</ul>d", None, "").collect()
    assert {r["pagina"] for r in rows} == {0}
    by = {r["nr"]: r for r in rows}
    tags = [(r["naam"], r["diepte"]) for r in sorted(rows, key=lambda r: r["nr"]) if r["naam"] != tree.TEXT]
    assert tags == [("div", 0), ("div", 1), ("br", 2), ("div", 1), ("li", 0), ("li", 0), ("ul", 1), ("li", 2)]
    assert by[0]["attributen"] == {"a": "1", "class": "q r"} and by[0]["klassen"] == ["q", "r"]
    inside = lambda nr: "".join(by[i]["tekst"] or "" for i in range(nr + 1, by[nr]["laatste"] + 1))
    assert inside(0) == "xyz<" and [inside(r["nr"]) for r in rows if r["naam"] == "li"] == ["a", "bcd", "c"]
    assert next(r for r in rows if r["tekst"] == "y")["boven"] == ["q", "r"]


def test_cards(spark):
    got = {r["entry"]: r for r in tree.cards(found(spark, PANEL, ONE), "pagina").collect()}
    assert set(got) == {"7", "8", "1", "2"}
    r = got["7"]
    assert (r["soort"], r["titel"], r["ondertitel"], r["slagzin"], r["href"], r["genres"], r["prijs"]) == ("comedy", "Café Noir & Co", "Ada Lint", "Kort", "/p/7?a=1&b=2", ["Cabaret", "Dans"], "€ 12,50")
    assert (got["8"]["titel"], got["8"]["genres"], got["8"]["prijs"], got["8"]["soort"]) == ("Leeg", [], None, None)
    assert got["2"]["soort"] == "a"


def test_three_layouts(spark):
    rows = sorted((tuple(r)[1:] for r in tree.card_rows(found(spark, PANEL, ONE), "pagina").collect()), key=str)
    assert rows == sorted([
        ("7", 1, True, "2026-11-02 20:15:00", "ma 2", "20:15", "Hier", "Zaal 1", "Bestel", "/t/7"),
        ("7", 2, False, None, None, None, None, None, "Uit\xadverkocht", None),
        ("7", 3, None, None, None, None, None, None, "Laatste", None),
        ("8", 1, None, None, None, None, None, None, None, None),
        ("1", 1, None, None, "do 5", "19.30", None, None, "Info", None),
        ("2", 1, None, None, "vr 6", "21:00", "Elders", "Grote zaal", "Tickets", "/b"),
    ], key=str)


def test_empty(spark):
    assert tree.card_rows(found(spark, "", "<p>"), "pagina").collect() == [] and tree.cards(found(spark, "x"), "pagina").collect() == []
