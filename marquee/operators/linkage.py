"""Links between productions: merging longer titles, similar keys, aliases, key changes.

The two searches that compare all pairs are equi joins here: keys that differ in one part meet on what is left when a
part is taken away, and a longer title meets a shorter one on its own beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import checkpointed

# Beginnings that say nothing, parts that make an event of its own, and what may differ between spellings.
GENERIC = "^(?:oudejaars\\S*(?: \\d{4})?|best of|live|concert|try ?out|premiere|reprise|\\d{4}|\\d{4} \\d{4})$"
APART = f"(?i){X.WORD_START}special$"
PREMIERE = "(?i)^premi[eè]re$"
YEAR_OR_EDITION = f"{X.WORD_START}(?:20\\d\\d(?:\\s*2\\d{{3}})?|\\d+\\s*(?:e|ste|de)\\s+editie|editie){X.WORD_END}"
ARTICLE = "^(?:de|het|the|een|a)\\s+"
ADDITION = "\\s+(?:en\\s+friends|and\\s+friends|live|derniere|reprise|premiere|tournee|jubileum|presenteert|en\\s+\\S+(?:\\s+\\S+){0,2})$"
SEPARATOR = " – "


def unbound(shows: DataFrame) -> DataFrame:
    """Rows whose key is not bound to a venue."""
    return shows.filter(~F.contains("sleutel", F.lit("::")))


def difference(a: Column, b: Column) -> Column:
    """jaartal, lidwoord, toevoeging, spelling, or null where two normal parts are not alike."""
    undated = lambda c: X.squeeze(F.regexp_replace(c, YEAR_OR_EDITION, " "))
    digits = lambda c: F.regexp_replace(c, "\\d+", "#")
    bare = lambda c: F.regexp_replace(c, ARTICLE, "")
    tight = lambda c: F.regexp_replace(c, "\\s+", "")
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    least = F.least(F.length(a), F.length(b))
    distance = F.least(F.levenshtein(a, b), F.levenshtein(tight(a), tight(b)))
    bound = F.least(F.lit(2), F.greatest(F.lit(1), F.floor(least * 0.2)))
    return (
        F.when(a == b, None)
        .when((undated(a) == undated(b)) & (undated(a) != ""), "jaartal")
        .when(digits(a) == digits(b), None)
        .when(bare(a) == bare(b), "lidwoord")
        .when(F.startswith(longer, F.concat(shorter, F.lit(" "))) & longer.rlike(ADDITION) & (F.regexp_replace(longer, ADDITION, "") == shorter), "toevoeging")
        .when((distance <= bound) & (least >= 5), "spelling")
    )


def _pieces(text: str, probe: bool) -> Column:
    """Blocks for texts within two edits of each other: one of three pieces of the shorter stands in the longer, moved by two at most.

    The text of the column ``text`` is cut for its own length or, to ``probe``, looked at in all places where a piece of
    a text of its own length or up to two less could stand.
    """
    lengths = f"sequence(greatest(3, length({text}) - 2), greatest(3, length({text})))" if probe else f"array(length({text}))"
    moves = "sequence(-2, 2)" if probe else "array(0)"
    # pieces are a third long, the last ones longer by one where the length does not divide
    piece = "named_struct('n', l, 'i', i, 'at', i * (l div 3) + greatest(0, i - (3 - l % 3)) + m, 'len', l div 3 + if(i >= 3 - l % 3, 1, 0))"
    every = f"flatten(flatten(transform({lengths}, l -> transform(sequence(0, 2), i -> transform({moves}, m -> {piece})))))"
    inside = f"filter({every}, p -> p.at >= 0 and p.at + p.len <= length({text}) and p.len > 0)"
    return F.expr(f"transform({inside}, p -> concat_ws('|', 's', p.n, p.i, substring({text}, p.at + 1, p.len)))")


def _shortened(text: str) -> Column:
    """Blocks for texts within one edit of each other: the text itself, and it without one of its characters."""
    return F.expr(f"concat(array(concat('e|', {text})), transform(sequence(1, greatest(1, length({text}))), i -> concat('e|', substring({text}, 1, i - 1), substring({text}, i + 1))))")


def similar_keys(shows: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """a, b, deelA, deelB, soort: pairs of keys (two parts or more) that differ in one part, and how.

    Pairs that both play only at one and the same venue are left out, and those in ``judged`` (a, b).  Keys meet on the
    parts that they share and on what each kind of difference leaves alike in the other part: the text without year,
    without article, without addition, without one character, or a third of it.  So keys that share a part, however many, are not compared all
    with all.
    """
    none = F.array().cast("array<string>")
    venues = unbound(shows).groupBy("sleutel").agg(F.min("theaterId").alias("v1"), F.max("theaterId").alias("v2"))
    keys = venues.withColumn("delen", F.split("sleutel", " \\| ", -1)).filter("size(delen) >= 2")
    parts = keys.select("sleutel", "v1", "v2", F.explode("delen").alias("deel"), "delen", F.size("delen").alias("n"))
    parts = parts.withColumns({"rest": F.array_join(F.filter("delen", lambda d: d != F.col("deel")), " | "), "dicht": F.regexp_replace("deel", "\\s+", "")})
    same = F.array(F.concat(F.lit("j|"), X.squeeze(F.regexp_replace("deel", YEAR_OR_EDITION, " "))), F.concat(F.lit("l|"), F.regexp_replace("deel", ARTICLE, "")))
    # one edit apart (the shorter part below ten characters): what is left without one character; two edits apart: a third
    near = F.when((F.length("deel") >= 5) & (F.length("dicht") <= 10), _shortened("dicht")).otherwise(none)
    spelled = lambda probe: F.concat(near, F.when((F.length("deel") >= 10) & (F.length("dicht") >= 3), _pieces("dicht", probe)).otherwise(none))
    shorter = F.when(F.col("deel").rlike(ADDITION), F.array(F.concat(F.lit("t|"), F.regexp_replace("deel", ADDITION, "")))).otherwise(none)
    laid = parts.select("rest", "n", F.struct("sleutel", "deel", "v1", "v2").alias("x"), F.explode(F.array_distinct(F.concat(same, F.array(F.concat(F.lit("t|"), "deel")), spelled(False)))).alias("blok"))
    sought = parts.select("rest", "n", F.struct("sleutel", "deel", "v1", "v2").alias("y"), F.explode(F.array_distinct(F.concat(same, shorter, spelled(True)))).alias("blok"))
    met = laid.join(sought, ["rest", "n", "blok"]).filter("x.sleutel <> y.sleutel").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = met.withColumn("soort", difference(F.col("x.deel"), F.col("y.deel"))).filter("soort is not null")
    pairs = pairs.filter("not (x.v1 = x.v2 and y.v1 = y.v2 and x.v1 = y.v1)")
    out = pairs.select(F.col("x.sleutel").alias("a"), F.col("y.sleutel").alias("b"), F.col("x.deel").alias("deelA"), F.col("y.deel").alias("deelB"), "soort").distinct()
    if judged is not None:
        both = judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        out = out.join(both, ["a", "b"], "left_anti")
    return out


def show_and_maker(shows: DataFrame) -> DataFrame:
    """Adds ruw (raw parts of the show), v (their normal forms), wie (the maker or null) and inTitel.

    The maker is the field, else the last part of a title whose order is certain.
    """
    parts = X.raw_parts(F.col("titel"))
    field = F.nullif(X.strip(F.coalesce("maker", F.lit(""))), F.lit(""))
    in_title = field.isNull() & (F.size(parts) >= 2) & F.coalesce("volgordeZeker", F.lit(False))
    raw = F.when(in_title, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    out = shows.withColumn("inTitel", in_title).withColumn("ruw", raw)
    normal = F.filter(F.transform("ruw", X.normal_part), lambda p: p != "")
    return out.withColumn("v", normal).withColumn("wie", F.coalesce(field, F.when(F.col("inTitel"), F.element_at(parts, -1))))


def merge_prefixes(shows: DataFrame) -> DataFrame:
    """shows with titel shortened to the shortest beginning that its maker has as a production of its own.

    titelBron is the title before, beschrijving takes what was dropped if it was empty (a premiere is put before it).
    Nothing happens for beginnings that say nothing or are shorter than four characters, and where what is dropped
    ends on "special".  Rows whose new venue, date, time and title then occur twice keep their title.  Titles bound to
    a venue take no part.
    """
    rows = show_and_maker(shows).withColumn("_mk", X.normal_part(F.col("wie"))).withColumn("_v", F.array_join("v", "\x00"))
    usable = rows.filter(F.col("wie").isNotNull() & (F.size("v") > 0) & ~F.contains("sleutel", F.lit("::")))
    made = usable.select("_mk", "_v", "v").distinct()
    longer = made.filter("size(v) > 1").select("_mk", "_v", F.explode(F.expr("transform(sequence(1, size(v) - 1), n -> named_struct('n', n, 'b', array_join(slice(v, 1, n), '\\u0000'), 'begin', array_join(slice(v, 1, n), ' ')))")).alias("x")).select("_mk", "_v", "x.*")
    shortest = longer.join(made.select("_mk", F.col("_v").alias("b")), ["_mk", "b"]).groupBy("_mk", "_v").agg(F.min(F.struct("n", "begin")).alias("x"))
    target = shortest.filter(~F.col("x.begin").rlike(GENERIC) & (F.length(F.regexp_replace("x.begin", "\\s", "")) >= 4)).select("_mk", "_v", F.col("x.n").alias("lengte"))
    out = rows.join(target, ["_mk", "_v"], "left").withColumn("lengte", F.when(F.col("wie").isNotNull() & ~F.contains("sleutel", F.lit("::")), F.col("lengte")))
    # raw parts up to the one that completes the beginning; parts without a normal form do not count
    upto = F.aggregate(
        "ruw",
        F.struct(F.lit(0).alias("seen"), F.lit(0).alias("upto")),
        lambda a, r: F.struct((a["seen"] + F.when((a["seen"] < F.col("lengte")) & (X.normal_part(r) != ""), 1).otherwise(0)).alias("seen"), (a["upto"] + F.when(a["seen"] < F.col("lengte"), 1).otherwise(0)).alias("upto")),
        lambda a: a["upto"],
    )
    out = out.withColumn("_upto", F.when(F.col("lengte").isNotNull(), upto))
    dropped = F.array_join(F.slice("ruw", F.col("_upto") + 1, F.size("ruw")), SEPARATOR)
    kept = F.slice("ruw", F.lit(1), F.col("_upto"))
    title = F.array_join(F.when(F.col("inTitel"), F.concat(kept, F.array("wie"))).otherwise(kept), SEPARATOR)
    out = out.withColumn("_weg", dropped).withColumn("_nieuw", F.when(F.col("lengte").isNotNull() & ~dropped.rlike(APART), title))
    spot = F.concat_ws("|", "theaterId", F.col("datum").cast("string"), F.coalesce("tijd", F.lit("")), X.normal_title(F.coalesce("_nieuw", "titel", F.lit(""))))
    out = out.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(spot)))
    done = F.col("_nieuw").isNotNull() & (F.col("_n") < 2)
    text = F.col("beschrijving") if "beschrijving" in shows.columns else F.lit(None).cast("string")
    empty = F.coalesce(text, F.lit("")) == ""
    described = F.when(done & empty & (F.col("_weg") != ""), F.col("_weg")).when(done & ~empty & F.col("_weg").rlike(PREMIERE), F.concat(F.lit("Première. "), text)).otherwise(text)
    source = F.coalesce("titelBron", "titel") if "titelBron" in shows.columns else F.col("titel")
    old = F.col("titelBron") if "titelBron" in shows.columns else F.lit(None).cast("string")
    rest = [c for c in shows.columns if c not in ("titel", "titelBron", "beschrijving")]
    return out.select(*rest, F.when(done, F.col("_nieuw")).otherwise(F.col("titel")).alias("titel"), F.when(done, source).otherwise(old).alias("titelBron"), described.alias("beschrijving"))


def title_from_description(shows: DataFrame) -> DataFrame:
    """Where the title is only the artist and the description starts "NAME | subtitle", the title becomes "NAME – subtitle – artist".

    Only if the artist is a maker at another venue, NAME is the first part of one of their shows, and the title is no
    show of its own at another venue.
    """
    rows = show_and_maker(shows)
    first = rows.filter("size(v) > 0").select(F.col("v")[0].alias("begin"), "theaterId", "wie").distinct()
    plays = first.groupBy("begin").agg(F.collect_set("theaterId").alias("venues"))
    makers = first.filter("wie is not null").select(X.normal_part(F.col("wie")).alias("artiest"), "theaterId", "begin")
    artists = makers.groupBy("artiest").agg(F.min("theaterId").alias("a1"), F.max("theaterId").alias("a2"))
    starts = makers.select("artiest", F.col("begin").alias("naam")).distinct().withColumn("_bekend", F.lit(True))
    pattern = f"^(.+?){X.S}+\\|{X.S}+(.+)$"
    text = F.coalesce("beschrijving", F.lit(""))
    alone = (F.coalesce("maker", F.lit("")) == "") & (F.size(X.raw_parts(F.col("titel"))) == 1) & ~F.contains("sleutel", F.lit("::")) & text.rlike(pattern)
    keyed = shows.withColumn("artiest", F.when(alone, X.normal_part(F.col("titel")))).withColumn("naam", F.when(alone, X.normal_part(F.regexp_extract(text, pattern, 1))))
    out = keyed.join(artists, "artiest", "left").join(starts, ["artiest", "naam"], "left").join(plays.withColumnRenamed("begin", "artiest"), "artiest", "left")
    elsewhere = (F.col("a1") != F.col("theaterId")) | (F.col("a2") != F.col("theaterId"))
    own_show = F.size(F.array_except(F.coalesce("venues", F.array().cast("array<string>")), F.array("theaterId"))) > 0
    does = F.coalesce(alone & F.col("_bekend") & elsewhere & ~own_show, F.lit(False))
    title = F.concat_ws(SEPARATOR, X.strip(F.regexp_extract(text, pattern, 1)), X.strip(F.regexp_extract(text, pattern, 2)), X.strip(F.col("titel")))
    rest = [c for c in shows.columns if c not in ("titel", "beschrijving", "titelBron", "volgordeZeker")]
    source = F.coalesce("titelBron", "titel") if "titelBron" in shows.columns else F.col("titel")
    old = F.col("titelBron") if "titelBron" in shows.columns else F.lit(None).cast("string")
    return out.select(
        *rest,
        F.when(does, title).otherwise(F.col("titel")).alias("titel"),
        F.when(does, source).otherwise(old).alias("titelBron"),
        F.when(does, None).otherwise(F.col("beschrijving")).alias("beschrijving"),
        (does | F.coalesce("volgordeZeker", F.lit(False))).alias("volgordeZeker"),
    )


def old_keys(shows: DataFrame) -> DataFrame:
    """oud, nieuw: keys of source titles (titelBron, titelVoorAlias) that differ from the present key; distinct."""
    sources = F.array(*[F.col(c) for c in ("titelBron", "titelVoorAlias") if c in shows.columns])
    rows = shows.select("sleutel", "theaterId", F.explode(sources).alias("bron")).filter("bron <> ''")
    return rows.select(X.production_key(F.col("bron"), F.col("theaterId")).alias("oud"), F.col("sleutel").alias("nieuw")).filter("oud <> nieuw").distinct()


def unambiguous_mapping(shows: DataFrame) -> DataFrame:
    """oud, nieuw: old keys with one target that are not in use any more."""
    one = old_keys(shows).groupBy("oud").agg(F.min("nieuw").alias("nieuw"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return one.join(shows.select(F.col("sleutel").alias("oud")).distinct(), "oud", "left_anti")


def multi_target_keys(shows: DataFrame) -> DataFrame:
    """sleutel, doelen: old keys with several targets that are not in use any more."""
    many = old_keys(shows).groupBy("oud").agg(F.array_sort(F.collect_set("nieuw")).alias("doelen")).filter("size(doelen) > 1")
    return many.join(shows.select(F.col("sleutel").alias("oud")).distinct(), "oud", "left_anti").select(F.col("oud").alias("sleutel"), "doelen")


def apply_aliases(shows: DataFrame, aliases: DataFrame) -> DataFrame:
    """shows with titel and maker by the alias of their key; aliases are sleutel, titel, maker, makerVast.

    A fixed maker is taken as it is (none if the new title ends on them).  Else a maker that the new title names goes,
    an empty maker is filled with the alias's, and where the maker was the show's name the old title becomes the maker,
    without age parts.
    """
    named = aliases.select("sleutel", F.col("titel").alias("_t"), F.col("maker").alias("_m"), F.coalesce("makerVast", F.lit(False)).alias("_vast"))
    out = shows.join(named, "sleutel", "left")
    bare = lambda c: X.normal_title(X.without_noise_ends(c))
    new = X.normal_title(F.col("_t"))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    new_parts = X.cut(F.col("_t"), SEPARATOR)
    last = F.coalesce((F.size(new_parts) > 1) & (bare(F.element_at(new_parts, -1)) == bare(F.col("_m"))), F.lit(False))
    m = bare(F.col("maker"))
    inside = F.coalesce((F.col("maker") != "") & (F.length(m) >= 4) & F.contains(padded(new), padded(m)), F.lit(False))
    filled = F.when(~last & (F.col("_m") != ""), F.col("_m"))
    first = F.coalesce(F.nullif(F.when(~inside, F.col("maker")), F.lit("")), filled)
    rest = F.filter(X.cut(F.col("titel"), SEPARATOR), lambda d: ~X.strip(d).rlike("^\\(?\\d") & ~F.contains(padded(new), padded(bare(d))))
    turned = F.when(inside & first.isNull() & ~last & (F.size(rest) > 0), F.array_join(rest, SEPARATOR))
    maker = F.when(F.col("_vast"), F.when(~last, F.col("_m"))).otherwise(F.coalesce(first, turned))
    hit = F.col("_t").isNotNull()
    columns = [c for c in shows.columns if c not in ("titel", "maker", "titelBron", "titelVoorAlias")]
    source = F.coalesce("titelBron", "titel") if "titelBron" in shows.columns else F.col("titel")
    before = F.col("titelVoorAlias") if "titelVoorAlias" in shows.columns else F.lit(None).cast("string")
    changed = hit & (F.col("_t") != F.col("titel"))
    return out.select(
        *columns,
        F.when(hit, F.col("_t")).otherwise(F.col("titel")).alias("titel"),
        F.when(hit, maker).otherwise(F.col("maker")).alias("maker"),
        F.nullif(F.when(hit & (F.col("_t") == source), None).when(changed | hit, source).otherwise(F.col("titelBron") if "titelBron" in shows.columns else F.lit(None)), F.lit("")).alias("titelBron"),
        F.when(changed & (F.col("titel") != source), F.coalesce(before, "titel")).otherwise(before).alias("titelVoorAlias"),
    )


def alias_errors(aliases: DataFrame, never: DataFrame) -> DataFrame:
    """sleutel, soort: aliases whose target is itself a source with another title (keten), and ones of a rule on a key that is never to be merged (verboden)."""
    targets = aliases.select("sleutel", "titel", X.production_key(F.col("titel"), F.lit(None).cast("string")).alias("doel"))
    sources = aliases.select(F.col("sleutel").alias("doel"), F.col("titel").alias("_verder"))
    chains = targets.join(sources, "doel").filter("doel <> sleutel and _verder <> titel").select("sleutel", F.lit("keten").alias("soort"))
    barred = aliases.filter("regel <> 'keuze'").join(never.select("sleutel").distinct(), "sleutel", "left_semi").select("sleutel", F.lit("verboden").alias("soort"))
    return chains.unionByName(barred)


def loose_sources(shows: DataFrame, aliases: DataFrame) -> DataFrame:
    """sleutel, titel, theaters: keys that an alias should have replaced and that are still in use."""
    open_ = aliases.select("sleutel", X.production_key(F.col("titel"), F.lit(None).cast("string")).alias("doel")).filter("doel <> sleutel")
    return shows.join(open_.select("sleutel").distinct(), "sleutel").groupBy("sleutel").agg(F.min_by("titel", "seq").alias("titel"), F.array_sort(F.collect_set("theaterId")).alias("theaters"))


def resolve_chains(links: DataFrame, most: int = 20) -> DataFrame:
    """van, naar, stappen: each link followed to its last target; in a circle no key is left twice.

    ``links`` are van and naar, van unique; links to themselves are left out.  Each round doubles how far every row has
    looked, so the rounds grow with the logarithm of the longest chain (``most`` rounds reach 2 ** most links), and each
    is written to the checkpoint folder.  A row carries the keys that it has passed.
    """
    hop = links.filter("van <> naar").select("van", "naar", F.array("van").alias("pad"))
    for _ in range(most):
        ahead = hop.select(F.col("van").alias("naar"), F.col("naar").alias("verder"), F.col("pad").alias("pad2"))
        joined = hop.join(ahead, "naar", "left")
        # keys of the chain ahead up to the first that was passed already
        met = F.filter(F.transform("pad2", lambda x, i: F.when(F.array_contains("pad", x), i)), lambda i: i.isNotNull())
        ahead_by = joined.withColumn("free", F.coalesce(F.get(met, F.lit(0)), F.size("pad2")))
        target = F.when(F.col("free") < F.size("pad2"), F.get("pad2", F.col("free"))).otherwise(F.col("verder"))
        told = ahead_by.withColumn("moved", F.coalesce(F.col("free") > 0, F.lit(False)))
        step = told.select("van", F.when(F.col("moved"), target).otherwise(F.col("naar")).alias("naar"), F.when(F.col("moved"), F.concat("pad", F.slice("pad2", F.lit(1), F.col("free")))).otherwise(F.col("pad")).alias("pad"), "moved")
        step = checkpointed(step)
        hop = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    return hop.select("van", "naar", F.size("pad").alias("stappen"))


def source_index(shows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(makers, titles): normal form k with the smallest and largest venue that has it (to ask for another one)."""
    title = X.one_dash(F.coalesce("titel", F.lit("")))
    rows = shows.select("theaterId", "maker", title.alias("titel")).distinct()
    fine = (F.coalesce("maker", F.lit("")) != "") & ~X.never_maker(F.col("maker")) & X.slogan_kind(F.col("maker")).isNull() & ~F.coalesce(X.slogan_kind(F.col("titel")).isin("cast", "zin"), F.lit(False))
    ends = lambda d: d.filter("k <> ''").groupBy("k").agg(F.min("theaterId").alias("v1"), F.max("theaterId").alias("v2"))
    makers = ends(rows.filter(fine).select(X.normal_part(F.col("maker")).alias("k"), "theaterId"))
    titles = ends(rows.select(F.explode(F.array("titel", F.element_at(X.cut(F.col("titel"), SEPARATOR), 1))).alias("t"), "theaterId").select(X.normal_part(F.col("t")).alias("k"), "theaterId"))
    return makers, titles


def slogan_choice(shows: DataFrame, makers: DataFrame, titles: DataFrame) -> DataFrame:
    """seq, keuze (omdraaien, laten, beschrijving), titel and rest for rows whose maker is a slogan or cast.

    Swapped where the maker (or its first part) is a title elsewhere and the title is a maker elsewhere.
    """
    rows = shows.select("seq", "theaterId", "titel", "maker", X.slogan_kind(F.col("maker")).alias("soort")).filter("soort is not null")
    rows = rows.withColumns({"km": X.normal_part(F.col("maker")), "delen": X.cut(F.col("maker"), SEPARATOR), "kt": X.normal_part(F.col("titel"))}).withColumn("kd", F.when(F.size("delen") > 1, X.normal_part(F.col("delen")[0])))
    other = lambda s: F.coalesce((F.col(f"v1_{s}") != F.col("theaterId")) | (F.col(f"v2_{s}") != F.col("theaterId")), F.lit(False))
    for index, key, s in ((titles, "km", "m"), (titles, "kd", "d"), (makers, "kt", "t")):
        rows = rows.join(index.select(F.col("k").alias(key), F.col("v1").alias(f"v1_{s}"), F.col("v2").alias(f"v2_{s}")), key, "left")
    name = F.when(other("m"), F.col("maker")).when(other("d"), F.col("delen")[0])
    swap = name.isNotNull() & other("t") & (F.col("soort") != "cast")
    title = F.when(F.contains(X.normal_part(name), F.col("kt")), name).otherwise(F.concat_ws(SEPARATOR, name, "titel"))
    rest = F.when(~other("m"), F.array_join(F.slice("delen", F.lit(2), F.size("delen")), SEPARATOR))
    choice = F.when(F.col("soort") == "cast", "beschrijving").when(swap, "omdraaien").otherwise("laten")
    return rows.select("seq", choice.alias("keuze"), F.when(swap, title).alias("titel"), F.when(swap, rest).alias("rest"))


def candidate_groups(shows: DataFrame) -> DataFrame:
    """anker, sleutel, rest: keys that share a part ("anchor") that is not generic, with two keys or more, a row a key.

    Each key stays in the group of its longest anchor only, so groups never overlap; rest are the key's other parts.
    """
    keys = unbound(shows).select("sleutel").distinct().withColumn("delen", F.split("sleutel", " \\| ", -1))
    by_part = keys.select("sleutel", F.explode("delen").alias("anker"), "delen").filter(~F.col("anker").rlike(GENERIC) & (F.length("anker") >= 4))
    several = lambda d: d.groupBy("anker").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("anker")
    best = by_part.join(several(by_part), "anker").groupBy("sleutel").agg(F.max_by(F.struct("anker", F.array_except("delen", F.array("anker")).alias("rest")), F.struct(F.length("anker").alias("l"), F.col("anker"))).alias("x"))
    kept = best.select("x.anker", "sleutel", "x.rest")
    return kept.join(several(kept), "anker")
