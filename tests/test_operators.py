"""Operators on small tables with worked-out results, and properties that hold for any."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from marquee.functions import text as X
from marquee.operators import agenda, dating, dedupe, linkage, social, state, votes
from marquee.plans.sources import ROBOTS
from marquee.sources import crawl

SHOW = "seq string, theaterId string, titel string, maker string, datum date, tijd string, genre string, beschikbaarheid string, podiumpas boolean, volgordeZeker boolean, beschrijving string"


def shows(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = dict(seq=f"{i:04d}", theaterId="v1", titel="Bos", maker=None, datum=date(2026, 1, 1), tijd="20:00", genre=None, beschikbaarheid="beschikbaar", podiumpas=None, volgordeZeker=False, beschrijving=None)
        full.append(tuple((d | r).values()))
    df = spark.createDataFrame(full, SHOW).repartition(3)
    return df.withColumn("norm", X.normal_title(F.col("titel"))).withColumn("sleutel", X.production_key(F.col("titel"), F.col("theaterId")))


def column(df, name, by="seq"):
    return [r[name] for r in df.orderBy(by).collect()]


def test_keep_best(spark):
    rows = shows(spark, [dict(titel="Bos!"), dict(titel="BOS", maker="Ada", genre="Dans"), dict(titel="bos", beschikbaarheid="afgelast"), dict(titel="Bos", tijd=None), dict(titel="bos", maker="Mia", genre="Toneel")])
    out = dedupe.keep_best(rows).orderBy("seq").collect()
    assert [(r["seq"], r["titel"], r["maker"]) for r in out] == [("0000", "BOS", "Ada"), ("0002", "bos", None), ("0003", "Bos", None)]
    assert [tuple(r) for r in dedupe.removed_per_venue(rows).collect()] == [("v1", 2)]
    again = dedupe.keep_best(dedupe.keep_best(rows))
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_pair_chain_looks_at_what_came_in(spark):
    rows = shows(spark, [dict(theaterId="a"), dict(theaterId="b"), dict(theaterId="c"), dict(theaterId="c", tijd="21:00")])
    pairs = spark.createDataFrame([("a", "b", 0), ("b", "c", 1), ("a", "c", 2)], "winner string, loser string, pos int")
    kept, removed = dedupe.pair_priority(rows, pairs)
    assert column(kept, "seq") == ["0000", "0003"]
    assert [(r["seq"], r["voorrang"]) for r in removed.orderBy("seq").collect()] == [("0001", "a"), ("0002", "b")]


def test_running_ids(spark):
    rows = shows(spark, [{}, dict(titel="BÖS"), dict(titel="bos"), dict(tijd=None), {}])
    assert column(dedupe.running_ids(rows), "id") == ["v1-bos-2026-01-01-2000", "v1-bos-2026-01-01-2000-2", "v1-bos-2026-01-01-2000-3", "v1-bos-2026-01-01-tbd", "v1-bos-2026-01-01-2000-4"]


def test_genre_votes(spark):
    rows = [dict(theaterId="a", genre="Toneel"), dict(theaterId="a", genre="Toneel"), dict(theaterId="a", genre="Musical"), dict(theaterId="b", genre="Musical"), dict(theaterId="c", genre="Overig"), dict(theaterId="d"), dict(titel="Medusa", genre="Dans"), dict(titel="Medusa", theaterId="b")]
    out = votes.genre_majority(shows(spark, rows)).orderBy("seq").collect()
    # one vote each for Toneel and Musical: the more specific one wins
    assert [r["genre"] for r in out] == ["Musical"] * 6 + ["Dans", None]
    assert [r["genreBron"] for r in out] == ["Toneel", "Toneel", None, None, "Overig", None, None, None]
    assert out[0]["genres"] == ["Toneel", "Musical"] and out[6]["genres"] is None


def test_display_votes(spark):
    a, b = "Het Bos – Ada Lint", "Ada Lint – Het Bos"
    sure = votes.display_majority(shows(spark, [dict(theaterId="a", titel=a, volgordeZeker=True), dict(theaterId="b", titel=b), dict(theaterId="c", titel=b)]))
    assert column(sure, "titel") == [a] * 3 and column(sure, "titelBron") == [None, b, b]
    most = votes.display_majority(shows(spark, [dict(theaterId="a", titel=a), dict(theaterId="b", titel=b), dict(theaterId="c", titel=b)]))
    assert column(most, "titel") == [b] * 3
    # a tie: the last part is a maker elsewhere
    maker = dict(theaterId="z", titel="Zee – Ada Lint", volgordeZeker=True)
    tie = votes.display_majority(shows(spark, [dict(theaterId="a", titel=b), dict(theaterId="b", titel=a), maker]))
    assert column(tie, "titel") == [a, a, "Zee – Ada Lint"]
    # a tie: starts with a capital, then fewest capitals
    assert column(votes.display_majority(shows(spark, [dict(theaterId="a", titel="het bos"), dict(theaterId="b", titel="HET BOS"), dict(theaterId="c", titel="Het bos")])), "titel") == ["Het bos"] * 3
    assert column(votes.display_majority(shows(spark, [dict(theaterId="a", titel="het bos")] * 2 + [dict(theaterId="a", titel="HET BOS")])), "titel") == ["het bos", "het bos", "HET BOS"]


def test_maker_votes(spark):
    def chosen(rows):
        return {r["sleutel"]: (r["soort"], r["maker"]) for r in votes.maker_choices(shows(spark, rows)).collect()}

    core = [dict(theaterId="a", maker="Nina Bos / Theater Zee"), dict(theaterId="b", maker="Nina Bos / Zee Producties"), dict(theaterId="c", maker="Ada Lint"), dict(theaterId="d")]
    assert chosen(core) == {"bos": ("gekozen", "Nina Bos")}
    tie = [dict(theaterId="a", maker="Ada"), dict(theaterId="b", maker="Bo")]
    assert chosen(tie) == {"bos": ("gelijk", None)}
    alone = [dict(theaterId="a", maker="Ada Lint"), dict(theaterId="b")]
    assert chosen(alone) == {"bos": ("verdacht", "Ada Lint")}
    known = alone + [dict(theaterId="c", titel="Zee", maker="Ada Lint")]
    assert chosen(known) == {"bos": ("gekozen", "Ada Lint")}
    number = [dict(theaterId="a", maker="Ada 3"), dict(theaterId="b"), dict(theaterId="c", titel="Zee", maker="Ada 3")]
    assert chosen(number) == {"bos": ("verdacht", "Ada 3")}
    slogan = [dict(theaterId="a", maker="Bos is weer terug!"), dict(theaterId="b")]
    assert chosen(slogan) == {}
    spelled = [dict(theaterId="a", maker="COLLECTIEF Bos"), dict(theaterId="b", maker="Collectief Bos"), dict(theaterId="c")]
    assert chosen(spelled) == {"bos": ("gekozen", "Collectief Bos")}
    out = votes.maker_majority(shows(spark, core))
    assert column(out, "maker") == ["Nina Bos"] * 4 and column(out, "makerBron")[3] is None and column(out, "makerGewijzigd") == [True] * 4


def test_merge_prefixes(spark):
    rows = [
        dict(titel="Koning – 250 jaar", maker="Ada", theaterId="a"), dict(titel="KONING", maker="ada", theaterId="b"), dict(titel="Koning | Paas special", maker="Ada", theaterId="c"),
        dict(titel="Koning – deel 1", maker="Ada", theaterId="d"), dict(titel="Koning – deel 2", maker="Ada", theaterId="d"), dict(titel="Koning – Première", maker="Ada", theaterId="e", beschrijving="Mooi."),
        dict(titel="Koning – x", maker="Bo", theaterId="a"), dict(titel="live", maker="Ada"), dict(titel="Live – in zee", maker="Ada"), dict(titel="Koning – lang – Ada", volgordeZeker=True, theaterId="f"),
    ]
    out = linkage.merge_prefixes(shows(spark, rows))
    assert column(out, "titel") == ["Koning", "KONING", "Koning | Paas special", "Koning – deel 1", "Koning – deel 2", "Koning", "Koning – x", "live", "Live – in zee", "Koning – Ada"]
    assert column(out, "titelBron")[0] == "Koning – 250 jaar" and column(out, "titelBron")[1] is None
    assert column(out, "beschrijving")[0] == "250 jaar" and column(out, "beschrijving")[5] == "Première. Mooi."


def test_title_from_description(spark):
    rows = [
        dict(titel="Ada Lint", theaterId="a", beschrijving="KONING | 250 jaar"), dict(titel="Koning", maker="Ada Lint", theaterId="b"), dict(titel="Bo Kast", theaterId="a", beschrijving="KONING | x"),
        dict(titel="Zee", theaterId="a", beschrijving="KONING | x"), dict(titel="Zee", theaterId="c", maker="Ada Lint"),
    ]
    out = linkage.title_from_description(shows(spark, rows))
    assert column(out, "titel") == ["KONING – 250 jaar – Ada Lint", "Koning", "Bo Kast", "Zee", "Zee"]
    assert column(out, "volgordeZeker")[0] and column(out, "beschrijving")[0] is None


def test_aliases(spark):
    aliases = spark.createDataFrame([("firma mes", "Wapens – Firma Mes", None, False), ("bos", "Het Bos", "Ada", False), ("zee", "De Zee", None, True), ("joes 3", "Voor Haar", None, False)], "sleutel string, titel string, maker string, makerVast boolean")
    rows = shows(spark, [dict(titel="Firma Mes", maker="Wapens"), dict(titel="Bos"), dict(titel="Bos", maker="Mia"), dict(titel="Zee", maker="Weg"), dict(titel="Anders", maker="x"), dict(titel="Joes – 3", maker="Voor Haar")])
    out = linkage.apply_aliases(rows.withColumn("sleutel", F.when(F.col("titel") == "Joes – 3", "joes 3").otherwise(F.col("sleutel"))), aliases)
    assert column(out, "titel") == ["Wapens – Firma Mes", "Het Bos", "Het Bos", "De Zee", "Anders", "Voor Haar"]
    assert column(out, "maker") == [None, "Ada", "Mia", None, "x", "Joes"]
    assert column(out, "titelBron") == ["Firma Mes", "Bos", "Bos", "Zee", None, "Joes – 3"]


def test_slogan_choice(spark):
    rows = shows(spark, [dict(titel="Ada Lint", maker="Bos is terug! – extra", theaterId="a"), dict(titel="Bos is terug!", theaterId="b", maker="Ada Lint"), dict(titel="Zee", maker="Ada als Mia", theaterId="a"), dict(titel="Meer", maker="Dat is wat!", theaterId="a")])
    out = linkage.slogan_choice(rows, *linkage.source_index(rows)).orderBy("seq").collect()
    assert [(r["keuze"], r["titel"], r["rest"]) for r in out] == [("omdraaien", "Bos is terug! – Ada Lint", "extra"), ("beschrijving", None, None), ("laten", None, None)]


def test_chains_end(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s")] + [(f"n{i}", f"n{i + 1}") for i in range(70)], "van string, naar string")
    out = {r["van"]: (r["naar"], r["stappen"]) for r in linkage.resolve_chains(links).collect()}
    assert out["a"] == ("c", 2) and out["b"] == ("c", 1) and out["x"] == ("x", 2) and "s" not in out
    assert out["n0"] == ("n70", 70)


def test_search(spark):
    rows = shows(spark, [dict(titel="Brandt"), dict(titel="Blast", maker="NDT 2"), dict(titel="Introdans"), dict(titel="Café (x)")])
    found = lambda q: column(rows.filter(agenda.matches_search(rows, q)), "seq")
    assert found("NDT") == ["0001"] and found("dans") == ["0002"] and found(" CAFE (X") == ["0003"] and found("(x)") == ["0003"] and len(found("  ")) == 4


def _lists(rnd, months):
    return [(lijst, pos, f"{rnd.choice(['zo', 'ma', 'di', 'wo', 'do', 'vr', 'za', ''])} {rnd.randint(1, 31)}{months(rnd)}".strip()) for lijst in range(20) for pos in range(15)]


def _weekday(y, m, d):
    from datetime import timedelta

    return (date(y, m, 1) + timedelta(days=d - 1)).isoweekday()


def _iso(y, m, d):
    try:
        return str(date(y, m, d))
    except ValueError:
        return "None"


NAMES = "jan feb mrt apr mei jun jul aug sep okt nov dec".split()
DAYS = "ma di wo do vr za zo".split()


def test_short_dates_fold(spark):
    rows = _lists(random.Random(3), lambda r: " " + r.choice([*NAMES, "xyz"]))
    df = spark.createDataFrame(rows, "lijst int, pos int, label string").repartition(4)
    got = {(r["lijst"], r["pos"]): str(r["datum"]) for r in dating.short_dates(df, date(2026, 9, 1)).collect()}
    for lijst in range(20):
        year, last = 2026, 9
        for _, pos, label in (r for r in rows if r[0] == lijst):
            *wd, d, m = label.split()
            if m not in NAMES:
                assert got[lijst, pos] == "None"
                continue
            d, m = int(d), NAMES.index(m) + 1
            y = year + (m < last)
            if wd and _weekday(y, m, d) != DAYS.index(wd[0]) + 1:
                other = year + 1 if y == year else year
                y = other if _weekday(other, m, d) == DAYS.index(wd[0]) + 1 else y
            if y > year:
                year, last = y, m
            elif m >= last:
                last = m
            assert got[lijst, pos] == _iso(y, m, d)


def test_numeric_dates_fold(spark):
    rows = _lists(random.Random(5), lambda r: f".{r.randint(0, 13):02d}")
    df = spark.createDataFrame(rows, "lijst int, pos int, label string").repartition(4)
    got = {(r["lijst"], r["pos"]): str(r["datum"]) for r in dating.numeric_dates(df, date(2026, 9, 1)).collect()}
    for lijst in range(20):
        year, last = 2026, 9
        for _, pos, label in (r for r in rows if r[0] == lijst):
            *wd, num = label.split()
            d, m = map(int, num.split("."))
            if not 1 <= m <= 12:
                assert got[lijst, pos] == "None"
                continue
            year += m < last
            if wd and _weekday(year, m, d) != DAYS.index(wd[0]) + 1 and _weekday(year + 1, m, d) == DAYS.index(wd[0]) + 1:
                year += 1
            last = m
            assert got[lijst, pos] == _iso(year, m, d)


def test_robots(spark):
    (chosen,) = crawl.group_for(crawl.robots_groups(spark.createDataFrame([("x", ROBOTS)], "site string, text string")), "marquee").collect()
    assert chosen["groep"] == 2 and [tuple(r) for r in chosen["rules"]] == [("allow", "/fr/"), ("disallow", "/")]
    (rest,) = crawl.group_for(crawl.robots_groups(spark.createDataFrame([("x", ROBOTS)], "site string, text string")), "nobody").collect()
    assert rest["delay"] == 5.0


ITEMS = "user bigint, sleutel string, titel string, theaterId string, op bigint, maker string, genre string, seq bigint"


def test_merges_do_not_depend_on_order_or_devices(spark):
    rnd = random.Random(7)
    adds = [(rnd.randrange(3), f"k{rnd.randrange(4)}", f"t{i % 3}", rnd.choice([None, "v1"]), rnd.randrange(5), rnd.choice([None, "M"]), None, i) for i in range(120)]
    gone = [(rnd.randrange(3), f"k{rnd.randrange(4)}", rnd.randrange(5)) for _ in range(20)]

    def merged(a, d):
        items, tombs = state.merge_watchlist(spark.createDataFrame(a, ITEMS).repartition(3), spark.createDataFrame(d, "user bigint, sleutel string, op bigint"))
        return sorted(map(str, items.collect())), sorted(map(str, tombs.collect())), items, tombs

    one = merged(adds, gone)
    two = merged(rnd.sample(adds, len(adds)), rnd.sample(gone, len(gone)))
    assert one[:2] == two[:2]
    again_a = [(*r[:5], *r[5:7], i) for i, r in enumerate(tuple(x) for x in one[2].collect())]
    again_d = [tuple(x) for x in one[3].select("user", "sleutel", "op").collect()] or gone[:0]
    if again_a:
        three = merged(again_a, again_d or [(99, "x", 0)])
        assert three[0] == one[0]


def test_equal_times_mean_deleted(spark):
    items, tombs = state.merge_watchlist(spark.createDataFrame([(1, "k", "t", None, 5, None, None, 1), (1, "q", "t", None, 5, None, None, 2), (1, "q", "u", "v", 5, "M", None, 3)], ITEMS), spark.createDataFrame([(1, "k", 5), (2, "z", 1)], "user bigint, sleutel string, op bigint"))
    assert [(r["sleutel"], r["titel"], r["theaterId"]) for r in items.collect()] == [("q", "u", "v")]
    assert sorted((r["user"], r["sleutel"], r["op"]) for r in tombs.collect()) == [(1, "k", 5), (2, "z", 1)]


def test_combined_quota(spark):
    rnd = random.Random(1)
    rows = [(i, f"d{i % 3}", rnd.randrange(6), rnd.randrange(8)) for i in range(400)]
    got = {r["seq"]: r["reden"] for r in state.combined_quota(spark.createDataFrame(rows, "seq bigint, dag string, afzender int, ontvanger int"), 30, 8, 5).collect()}
    seen = {}
    for i, dag, a, b in rows:
        n, sent, rec = seen.setdefault(dag, [0, {}, {}])
        why = "totaal" if n >= 30 else "afzender" if sent.get(a, 0) >= 8 else "ontvanger" if rec.get(b, 0) >= 5 else None
        assert got[i] == why
        if why is None:
            seen[dag][0] += 1
            sent[a], rec[b] = sent.get(a, 0) + 1, rec.get(b, 0) + 1


def test_plan_events(spark):
    log = [
        (1, "p", "uitnodigen", "eig", "a"), (2, "p", "uitnodigen", "eig", "b"), (3, "p", "gaat", "a", None), (4, "p", "intrekken", "eig", "b"), (5, "p", "gaat", "b", None),
        (6, "p", "uitnodigen", "eig", "c"), (7, "p", "kan-niet", "c", None), (8, "p", "opheffen", "eig", None), (9, "p", "gaat", "c", None),
        (10, "q", "uitnodigen", "eig", "a"), (11, "q", "gaat", "a", None), (12, "q", "uitnodigen", "eig", "a"), (13, "q", "weg", "a", None),
    ] + [(20 + i, "r", "uitnodigen", "eig", f"g{i:02d}") for i in range(12)]
    members, messages = social.plan_states(spark.createDataFrame(log, "seq bigint, plan string, actie string, door string, wie string"))
    got = {(r["plan"], r["uid"]): r["status"] for r in members.collect()}
    assert {k: v for k, v in got.items() if k[0] != "r"} == {("p", "a"): "gaat", ("p", "c"): "kan-niet", ("q", "a"): "weg"}
    assert sorted(u for p, u in got if p == "r") == [f"g{i:02d}" for i in range(10)]
    sent = sorted((r["plan"], r["van"], r["naar"], r["soort"]) for r in messages.na.fill("").collect())
    assert sent == [("p", "a", "", "gaat-mee"), ("p", "c", "", "kan-niet"), ("p", "eig", "a", "opgeheven"), ("q", "a", "", "gaat-mee"), ("q", "a", "", "weg")]


def test_no_pairs_by_product(spark):
    """Searches over all pairs are planned as equi joins."""
    rows = shows(spark, [dict(titel="Bos – Ada"), dict(titel="Bas – Ada", theaterId="b")])
    for df in (linkage.similar_keys(rows), linkage.merge_prefixes(rows), agenda.also_playing_at(rows, rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_alias_errors(spark):
    aliases = spark.createDataFrame([("a", "B", "keuze"), ("b", "C", "R2"), ("c", "C", "keuze")], "sleutel string, titel string, regel string")
    never = spark.createDataFrame([("b",), ("c",)], "sleutel string")
    assert sorted(map(tuple, linkage.alias_errors(aliases, never).collect())) == [("a", "keten"), ("b", "verboden")]


def test_similar_keys_against_all_pairs(spark):
    """Random edits of one part: the blocks miss no pair that a comparison of all finds."""
    rnd = random.Random(11)
    names = set()
    for _ in range(60):
        word = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(5, 14))).strip()
        for _ in range(4):
            x = list(word)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(x) + 1)
                x[k : k + rnd.randint(0, 1)] = rnd.choice(["", "f", " ", "g"])
            names.add(" ".join("".join(x).split()))
            names.add(" ".join(("de " * rnd.randint(0, 1) + word + rnd.choice(["", " live", " 2026", " en friends"])).split()))
    rows = spark.createDataFrame([(f"{n} | zz maker", f"v{i}") for i, n in enumerate(sorted(names)) if n], "sleutel string, theaterId string").repartition(4)
    found = {(r["a"], r["b"], r["soort"]) for r in linkage.similar_keys(rows).collect()}
    p = rows.select("sleutel", F.split("sleutel", " \\| ")[0].alias("d"))
    q = p.select(F.col("sleutel").alias("s2"), F.col("d").alias("d2"))
    every = p.join(q, F.col("sleutel") < F.col("s2")).select("sleutel", "s2", linkage.difference(F.col("d"), F.col("d2")).alias("k")).filter("k is not null")
    assert found == {tuple(r) for r in every.collect()} and len(found) > 100


def test_agenda_order(spark):
    """By date and time, a missing time last, then in input order; places say the same within a date."""
    from marquee.operators import agenda

    rows = [("s3", "1998-02-11", None), ("s1", "1998-02-11", "20:00"), ("s2", "1998-02-11", "20:00"), ("s0", "1998-02-12", "09:00"), ("s4", "1998-02-10", None), ("s5", "1998-02-11", "08:30")]
    df = spark.createDataFrame(rows, "seq string, d string, tijd string").selectExpr("seq", "cast(d AS date) AS datum", "tijd").repartition(3)
    assert [r["seq"] for r in agenda.in_order(df).collect()] == ["s4", "s5", "s1", "s2", "s3", "s0"]
    assert {r["seq"]: r["plaats"] for r in agenda.places(df).collect()} == {"s4": 1, "s5": 1, "s1": 2, "s2": 3, "s3": 4, "s0": 1}


def test_common_names_meet_no_more_people_than_can_matter(spark):
    """A searcher who is blocked by the first people of a name still gets ten of it."""
    from marquee.operators import social

    profiles = spark.createDataFrame([(f"p{i}", f"u{i:03}", "Anna de Vries", True) for i in range(60)], "uid string, gebruikersnaam string, naam string, vindbaar boolean")
    blocks = spark.createDataFrame([(f"p{i}", "p7") for i in range(5)] + [("p7", f"p{i}") for i in range(3, 9)], "a string, b string")
    searches = spark.createDataFrame([("z", "p7", "anna de vries"), ("y", "p50", "Anna De Vries")], "zoek string, uid string, naam string")
    found = social.search_names(searches, profiles, blocks).collect()
    hits = {z: [r["gebruikersnaam"] for r in sorted(found, key=lambda r: r["plaats"]) if r["zoek"] == z] for z in "zy"}
    assert hits == {"z": [f"u{i:03}" for i in range(9, 19)], "y": [f"u{i:03}" for i in range(10)]}


def test_tables_between_steps_are_read_back_and_cleared(spark):
    from marquee import storage

    df = storage.checkpointed(spark.range(10).withColumnRenamed("id", "x"))
    assert df.count() == 10 and df.inputFiles() and "RDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_listing_with_an_empty_first_page_is_an_error(spark):
    from marquee.sources import crawl

    rows = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 2, "y"), ("a", 2, 3, "y"), ("b", 2, 4, "z")], "site string, page int, pos int, key string")
    sites = lambda *names: spark.createDataFrame([(n,) for n in names], "site string")
    assert [(r["key"], r["page"]) for r in crawl.listing_from_one(rows, sites("a"))[0].collect()] == [("y", 1)]
    with pytest.raises(Exception, match="nothing on page 1 of b"):
        crawl.listing_from_one(rows, sites("a", "b"))[0].collect()
