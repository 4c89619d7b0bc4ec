"""Title text as Column expressions: folding, normal forms, parts, keys, labels and status words.

Everything here stays in the JVM.  White space is that of the web (no-break and other wide spaces included), and word
boundaries are ASCII ones.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word boundaries as classes that mean the same in Java.
S = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
WORD_END = "(?![A-Za-z0-9_])"
WORD_START = "(?<![A-Za-z0-9_])"

# The patterns, words and titles below decide which titles count as the same production.
SEPARATOR = f"{S}+[–—-]{S}+|{S}+\\|{S}+|:{S}+"
RAW_SEPARATOR = f"{S}+[–—-]{S}+|{S}+\\|{S}+"
AMPERSAND = f"{S}*&{S}*"
BRACKETS = f"(?i)\\(({S}*\\d+(?:[.,]\\d+)?{S}*\\+|{S}*\\d+{S}*(?:-|t/m|tot){S}*\\d+{S}*(?:jaar|maanden)?|{S}*try-?out|{S}*reprise|{S}*premi[eè]re|{S}*nieuw){S}*\\)"
SLASH_AGE = f"/{S}*\\d+{S}*\\+"
THE_MUSICAL = f"(?i)[\\s,:–-]+(?:de|the){S}+musical{WORD_END}"
#: What each noise pattern needs: most titles have none of it and skip the costlier patterns.
MAY_BE_NOISE = "[&(/]|(?i:musical)"
MAY_BE_END_NOISE = "\\+|(?i:reprise|try)"
END_WORD = f"(?i)(?:^|[\\s–-]+)(?:reprise|try-?out){S}*$"
END_AGE = f"(?:^|{S})\\d+{S}*\\+{S}*$"
VENUE_BOUND_TITLES = ("medusa", "contra", "diep", "pan", "nora", "adem", "cabaret", "blind date")
LABEL = "((?:voor)?premi[eè]re|try[- ]?out|reprise)"
LABEL_BRACKETS = f"(?i){S}*\\({S}*{LABEL}{S}*\\)"
LABEL_PART = f"(?i){S}+[–—|-]{S}+{LABEL}(?={S}+[–—|-]{S}+|{S}*$)"
SALES_STATUS = (
    ("^(?:uitverkocht|sold[ -]?out)$", "uitverkocht"),
    ("^(?:laatste (?:kaarten|plaatsen|tickets)|bijna uitverkocht|nog enkele kaarten)$", "beschikbaar"),
    ("^wachtlijst$", "wachtlijst"),
    ("^(?:geannuleerd|afgelast|gecancel?d|cancel?led)$", "afgelast"),
    ("^verplaatst$", "verplaatst"),
)
STATUS_WORD = "(?:geannuleerd|afgelast|verplaatst)"


def _folding() -> tuple[str, str]:
    """Every letter whose canonical decomposition is one letter and combining marks, and that letter."""
    accented, plain = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(bare) == 1 and bare != chr(code):
            accented.append(chr(code))
            plain.append(bare)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _folding()


def let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: A noncharacter, which no text holds: it marks where a text is to be cut.
_MARK = "\uffff"


def cut(text: Column, pattern: str) -> Column:
    """``split(text, pattern, -1)`` for patterns of some length: replacing keeps a compiled pattern, splitting compiles it for each row."""
    return F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)


def fold(text: Column) -> Column:
    """Text without accents: combining marks (U+0300 to U+036F) dropped, composed or not; ø, ß, ł stay."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), "[\\x{300}-\\x{36F}]", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{S}+|{S}+$", "")


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{S}+", " "))


def normal_title(title: Column) -> Column:
    """Lower case, no accents, all but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(fold(F.lower(title)), "[^\\p{L}\\p{N}]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(F.lower(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def search_form(text: Column) -> Column:
    """As typed into a search box: lower case, no accents, punctuation kept."""
    return squeeze(fold(F.lower(F.coalesce(text, F.lit("")))))


def without_noise(title: Column) -> Column:
    """Title without ages, "(try-out)", "the musical" and the like; "&" is "en"."""
    given = F.coalesce(title, F.lit(""))
    out = F.regexp_replace(given, AMPERSAND, " en ")
    for pattern in (BRACKETS, SLASH_AGE, THE_MUSICAL):
        out = F.regexp_replace(out, pattern, " ")
    return F.when(given.rlike(MAY_BE_NOISE), out).otherwise(given)


def without_end_noise(part: Column) -> Column:
    return F.when(part.rlike(MAY_BE_END_NOISE), F.regexp_replace(F.regexp_replace(part, END_WORD, " "), END_AGE, " ")).otherwise(part)


def title_parts(title: Column) -> Column:
    """Distinct normal parts of a title, sorted."""
    parts = F.transform(cut(without_noise(title), SEPARATOR), lambda p: normal_title(without_end_noise(p)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def wide_title(title: Column) -> Column:
    return F.array_join(title_parts(title), " | ")


def production_key(title: Column, venue: Column) -> Column:
    """Key that the same production has at every venue; titles known to be ambiguous are bound to their venue."""
    known = F.coalesce(venue, F.lit("")) != ""
    return let(wide_title(title), lambda wide: F.when(known & wide.isin(*VENUE_BOUND_TITLES), F.concat(venue, F.lit("::"), wide)).otherwise(wide))


def form_key(title: Column) -> Column:
    """Lower-cased parts in order of the alphabet, noise kept: titles that differ only in order, case and separator."""
    parts = F.transform(cut(F.coalesce(title, F.lit("")), SEPARATOR), lambda p: F.lower(squeeze(p)))
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), "\x00")


def raw_parts(title: Column) -> Column:
    return F.filter(F.transform(cut(F.coalesce(title, F.lit("")), RAW_SEPARATOR), strip), lambda p: p != "")


def last_part(title: Column) -> Column:
    """Last part of a title, lower-cased."""
    return F.lower(strip(F.element_at(cut(title, SEPARATOR), -1)))


def normal_part(text: Column) -> Column:
    """A part as it counts in keys, noise dropped wherever it stands."""
    out = F.regexp_replace(without_noise_ends(text), END_WORD, " ")
    return normal_title(F.regexp_replace(out, END_AGE, " "))


def without_noise_ends(title: Column) -> Column:
    """``without_noise``, and noise at the end of the whole title too."""
    out = F.regexp_replace(F.coalesce(title, F.lit("")), AMPERSAND, " en ")
    for pattern in (BRACKETS, SLASH_AGE, f"{S}\\d+{S}*\\+{S}*$", THE_MUSICAL, f"(?i)[\\s–-]+(?:reprise|try-?out){S}*$"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def whole_words_in(text: Column, words: Column) -> Column:
    """Does ``text`` hold ``words`` as whole words (normal forms)?  False without words."""
    t, w = normal_title(F.coalesce(text, F.lit(""))), normal_title(F.coalesce(words, F.lit("")))
    return (w != "") & F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))


def display_title(title: Column, maker: Column) -> Column:
    """Title, and the maker behind a dash unless the title names them."""
    t, m = F.coalesce(title, F.lit("")), strip(F.coalesce(maker, F.lit("")))
    return F.when((m == "") | whole_words_in(t, m), t).otherwise(F.concat(t, F.lit(" – "), m))


def one_dash(title: Column) -> Column:
    return F.regexp_replace(title, f"{S}+[-|]{S}+", " – ")


def label_parts(title: Column) -> Column:
    """Struct of tekst, the title without labels like "(try-out)", and labels, the distinct ones in lower case; the title as it was if nothing is left."""
    none = F.array().cast("array<string>")

    def bare_of(once: Column) -> Column:
        bare = strip(F.regexp_replace(F.regexp_replace(once, LABEL_PART, ""), f"{S}{{2,}}", " "))
        found = F.concat(F.regexp_extract_all(title, F.lit(LABEL_BRACKETS), F.lit(1)), F.regexp_extract_all(once, F.lit(LABEL_PART), F.lit(1)))
        return F.struct(bare.alias("bare"), F.array_distinct(F.transform(found, F.lower)).alias("labels"))

    made = let(F.regexp_replace(title, LABEL_BRACKETS, ""), bare_of)
    return let(made, lambda x: F.struct(F.when(x["bare"] != "", x["bare"]).otherwise(title).alias("tekst"), F.when(x["bare"] != "", x["labels"]).otherwise(none).alias("labels")))


def labels_from_title(title: Column) -> tuple[Column, Column]:
    """The fields of ``label_parts``."""
    x = label_parts(title)
    return x["tekst"], x["labels"]


def sales_status(part: Column) -> Column:
    def of(clean: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, status in reversed(SALES_STATUS):
            out = F.when(clean.rlike(f"(?i){pattern}"), status).otherwise(out)
        return out

    return let(strip(F.regexp_replace(part, "[.!…]+$", "")), of)


def status_parts(title: Column) -> Column:
    """Struct of tekst and status: a sales status as last part, first part or in brackets at the end is taken off the title."""
    t = F.coalesce(title, F.lit(""))
    bracket = f"^(.*\\S){S}*\\(([^()]+)\\)$"

    def told(parts: Column) -> Column:
        several = F.size(parts) >= 2
        known = F.struct(sales_status(F.regexp_extract(t, bracket, 2)).alias("inner"), F.when(several, sales_status(F.element_at(parts, -1))).alias("last"), F.when(several, sales_status(F.element_at(parts, 1))).alias("first"))
        return let(
            known,
            lambda k: F.struct(
                F.when(k["inner"].isNotNull(), strip(F.regexp_extract(t, bracket, 1)))
                .when(k["last"].isNotNull(), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " – "))
                .when(k["first"].isNotNull(), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " – "))
                .otherwise(t)
                .alias("tekst"),
                F.coalesce(k["inner"], k["last"], k["first"]).alias("status"),
            ),
        )

    return let(cut(t, f"{S}+[-–|]{S}+"), told)


def status_from_title(title: Column) -> tuple[Column, Column]:
    """The fields of ``status_parts``."""
    x = status_parts(title)
    return x["tekst"], x["status"]


def without_status_word(title: Column) -> Column:
    pattern = f"(?i)(?:{S}+[-–|]{S}+{STATUS_WORD}(?={S}+[-–|]{S}+|$)|^{STATUS_WORD}{S}+[-–|]{S}+|{S}*\\({STATUS_WORD}\\))"
    bare = strip(F.regexp_replace(title, pattern, ""))
    return F.when(bare != "", bare).otherwise(title)


def series_from_title(title: Column, prefixes: list[str]) -> tuple[Column, Column]:
    """(title, series): the first of ``prefixes`` that stands before a colon, with something after it, is taken off."""
    t = F.coalesce(title, F.lit(""))
    text, series = t, F.lit(None).cast("string")
    for prefix in reversed(prefixes):
        pattern = f"(?i)^{S}*(\\Q{prefix}\\E){S}*:{S}*([^\\s].*)$"
        fits = t.rlike(pattern)
        text = F.when(fits, strip(F.regexp_extract(t, pattern, 2))).otherwise(text)
        series = F.when(fits, F.regexp_extract(t, pattern, 1)).otherwise(series)
    return text, series


def capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "\\P{Lu}", ""))


def maker_key(maker: Column) -> Column:
    return normal_title(F.regexp_replace(F.coalesce(maker, F.lit("")), AMPERSAND, " en "))


#: Between maker and company: a slash with two characters on either side.
CORE_SEPARATOR = f"(?<=\\S\\S){S}*/{S}*(?=\\S\\S)"
# Words that mark a company or producer, and texts that are never a maker.
COMPANY = f"(?i)theat|produc|gezelschap|company|compagn|kompagn|toneel|dans|huis{WORD_END}|stichting|collect|ensemble|orkest|orchestr|opera|ballet|studio|festival"
NEVER_MAKER = (
    "(?i)^(content warning|⚠)",
    "(?i)^met[\\s:]",
    "^\\(?\\s*\\d{1,2}(?:[,.]\\d)?\\s*\\+\\s*\\)?$",
    "(?i)^\\(?\\s*\\d{1,2}(?:[,.]\\d)?\\s*(?:tot|t/m|-|–)\\s*\\d{1,2}(?:[,.]\\d)?(?:\\s*jaar)?\\s*\\)?$",
    "(?i)^vanaf \\d{1,2} jaar$",
    "(?i)^\\(?\\s*(?:reprise|try[- ]?out|premi[eè]re|grand finale|live in (?:het )?theater)\\s*\\)?$",
    "(?i)^\\d+\\s+(?:jaar|jarig)(?:\\s|$)",
    "(?i)^(?:in concert|(?:theater)?concert|(?:theater)?tour|live)$",
)
COMPANY_WORDS = "ensemble|trio|kwartet|quartet|kwintet|quintet|band|orkest|orchestra|koor|choir|collectief|company|compagnie|opera|theater|producties|gezelschap|toneelgroep"
COMPANY_NAMES = "Ensemble|Trio|Kwartet|Quartet|Kwintet|Quintet|Band|Orkest|Orchestra|Koor|Choir|Collectief|Company|Compagnie|Opera|Theater|Producties|Gezelschap|Toneelgroep|Chœur|Choeur"
NAME_WORDS = ("van", "de", "der", "den", "het", "ten", "ter", "te", "du", "la", "le", "da", "di", "von", "el", "en", "y", "dos", "das", "do", "e", "des", "del", "of", "and", "the", "und", "met", "o.l.v.", "i.s.m.", "feat.", "ft.", "x", "vs", "vs.", "by", "door", "with", "plus", "zu", "al", "bin", "ibn", "'t", "’t")


def maker_core(maker: Column) -> Column:
    return strip(F.element_at(cut(F.coalesce(maker, F.lit("")), CORE_SEPARATOR), 1))


def like_company(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(COMPANY)


def never_maker(text: Column) -> Column:
    def of(t: Column) -> Column:
        out = F.lit(False)
        for pattern in NEVER_MAKER:
            out = out | t.rlike(pattern)
        return (t != "") & out

    return let(strip(F.coalesce(text, F.lit(""))), of)


def slogan_kind(text: Column) -> Column:
    """officieel, musical, cast, uitroep, zin, or null for what may be a maker's name."""
    t = strip(F.coalesce(text, F.lit("")))
    return let(F.struct(t.alias("t"), squeeze(F.regexp_replace(t, "\\([^)]*\\)", " ")).alias("outside")), lambda x: _slogan(x["t"], x["outside"]))


def _slogan(t: Column, outside: Column) -> Column:
    company_name = outside.rlike(f"{WORD_START}(?:{COMPANY_NAMES}){WORD_END}")
    commas = F.split(outside, ",", -1)
    companies = F.filter(commas, lambda d: d.rlike(f"(?i){WORD_START}(?:{COMPANY_WORDS}){WORD_END}") | strip(d).rlike("^[A-Z]{3,}$"))
    words = F.split(outside, " ", -1)
    small = F.filter(words, lambda w: w.rlike("^\\p{Ll}") & ~F.lower(w).isin(*NAME_WORDS))
    return (
        F.when(t == "", None)
        .when(t.rlike(f"(?i){WORD_START}offici[eë]le{WORD_END}"), "officieel")
        .when(t.rlike("(?iu)\\p{L}-?musical(?!\\p{L})") | outside.rlike(f"(?i){WORD_START}musical{S}*!?$") | t.rlike(f"(?i)^(?:een|de|het){S}.*{WORD_START}musical{WORD_END}"), "musical")
        .when(t.rlike(f"(?i)(?:^|{S})e\\.{S}?a\\.?(?:{S}|$)") | t.rlike(f"{S}als{S}+\\p{{Lu}}"), "cast")
        .when(outside.contains("!") & (F.size(words) >= 2) & ~company_name, "uitroep")
        .when((F.size(commas) >= 3) & ~t.contains("/") & (F.size(companies) < 2), "cast")
        .when((F.size(words) >= 5) & (F.size(small) >= 3) & ~company_name, "zin")
    )


def error_line(error: Column, most: int = 200) -> Column:
    """First line of an error, cut to ``most`` characters."""
    line = F.element_at(F.split(F.coalesce(error, F.lit("")), "\n", -1), 1)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def redacted(text: Column, most: int = 300) -> Column:
    """E-mail addresses and phone numbers replaced, white space squeezed, cut to ``most`` characters."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)+", "[e-mail]")
    out = squeeze(F.regexp_replace(out, f"(?:\\+|{WORD_START}0)[0-9](?:[0-9-]|{S}){{7,}}[0-9]", "[telefoon]"))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("…"))).otherwise(out)


def escaped_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escaped_ics(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), (",", "\\,"), (";", "\\;"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
