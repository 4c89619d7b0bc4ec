"""Op 2, personal data (DataFrame functions only): format-preserving Feistel pseudonyms.

Found values are validated (check digit, ranges, calendar), then permuted under a key within the set of values of
their format: a card number becomes another valid card number, a date another date, each written like the
original.  Equal values get equal pseudonyms in all documents, however they are written, and different values
different ones.

=====  =====================================  ======================================================
kind   validated                              permuted
=====  =====================================  ======================================================
email  shape                                  letters and digits of the domain but its last label,
                                              and those of the name; letters without their case
ip     four numbers up to 255                 the 32 bits
card   13 to 19 digits, Luhn                  all but the check digit, which is set anew
phone  + and 8 to 15 digits, or (3) 3-4       all digits after the country code, which the digits tell
ssn    3-2-4 digits, no void group            the place among all valid numbers
date   calendar day, year 1800 to 2199        the day within these 400 years
=====  =====================================  ======================================================

Patterns take each text in time that grows with its length: what may be repeated without bound is never given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Where the session names the key, and the key of tests and checks, where it names none.
KEY_SETTING, TEST_KEY = "spark.marquee.pii.key", "corpus-key-1"
ROUNDS = 8
KINDS = ("email", "ip", "card", "phone", "ssn", "date")
_B, _E = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
PATTERNS = {
    # signs before a name are matched along, so that a run of characters of names is looked at once
    "email": "(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++){0,126}\\.[A-Za-z]{2,}+",
    "ip": "(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\\.[0-9])",
    "date": _B + "(?:(?:1[89]|2[01])[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\\1(?:1[89]|2[01])[0-9]{2})" + _E,
    "ssn": _B + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E + "(?!-[0-9])",
    "phone": "\\+[0-9]{1,3}[ .-]?\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\\([0-9]{3}\\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "card": "(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in ("email", "ip", "date", "ssn", "phone", "card")).replace("\\1", "[./]").replace("([./])", "[./]")
#: No text without one of these has a valid value.
HINT = "@[A-Za-z0-9-]|[0-9][0-9.() -]{5}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
_DAYS = 146097  # of 400 years
_FIRST = "1800-01-01"
#: Fixed: country codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "^[17]", "^(?:20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def keyed(parts: list[Column], key: str) -> Column:
    """A number below 2^52 that depends on the key and all parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("bigint")


def feistel(value: Column, left: Column, right: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1: each round adds to one half a number made from the other."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(F.call_function("div", value, right).alias("a"), F.pmod(value, right).alias("b")),
        lambda s, i: F.when(i % 2 == 0, F.struct(((s["a"] + keyed([tweak, i, s["b"]], key)) % left).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), ((s["b"] + keyed([tweak, i, s["a"]], key)) % right).alias("b"))
        ),
        lambda s: s["a"] * right + s["b"],
    )


def permute_digits(digits: Column, tweak: str, key: str) -> Column:
    """Another string of as many digits, 1 to 18."""
    n = F.length(digits)
    power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("bigint")
    half = F.floor(n / 2).cast("int")
    return F.lpad(feistel(digits.cast("bigint"), power(half), power(n - half), F.concat_ws("/", F.lit(tweak), n.cast("string")), key).cast("string"), n, "0")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled (and 9 taken off above 9), the last being plain."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _written(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced by ``digits``, all else left."""
    return F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))
        ),
        lambda s: s["out"],
    )


def kind_of(value: Column) -> Column:
    """The kind of a match of ANY that is valid, else null."""
    digits = _digits(value)
    full = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    ssn = full("ssn") & ~digits.rlike("^(?:000|666|9)") & ~digits.rlike("^[0-9]{3}00") & ~digits.rlike("0000$")
    return (
        F.when(full("email"), "email")
        .when(full("ip"), "ip")
        .when(full("date") & day_of(value).isNotNull(), "date")
        .when(ssn, "ssn")
        .when(value.rlike("^[0-9 -]+$") & F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0), "card")
        .when(full("phone") & F.length(digits).between(8, 15), "phone")
    )


def day_of(value: Column) -> Column:
    iso = F.when(value.rlike("^[0-9]{4}-"), value).otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    return F.try_to_date(iso, "yyyy-MM-dd")


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value of a kind, in the value's own writing."""
    digits = _digits(value)
    body = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key)
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    lead = F.when(value.startswith("+"), F.substr(digits, F.lit(1), F.when(digits.rlike(ONE_DIGIT), 1).when(digits.rlike(TWO_DIGITS), 2).otherwise(3))).otherwise("")
    phone = F.concat(lead, permute_digits(F.substr(digits, F.length(lead) + 1), "phone", key))
    octet = F.split(value, "\\.")
    number = F.aggregate(octet, F.lit(0).cast("bigint"), lambda a, o: a * 256 + o.cast("bigint"))
    half = F.lit(65536).cast("bigint")
    ip = feistel(number, half, half, F.lit("ip"), key)
    dotted = F.concat_ws(".", *[F.pmod(F.shiftright(ip, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    day = F.datediff(day_of(value), F.lit(_FIRST).cast("date")).cast("bigint")
    moved = F.date_add(F.lit(_FIRST).cast("date"), feistel(day, F.lit(189).cast("bigint"), F.lit(773).cast("bigint"), F.lit("date"), key).cast("int"))
    sign = F.substring(value, 3, 1)
    date = F.when(value.rlike("^[0-9]{4}-"), F.date_format(moved, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(moved, "dd"), sign, F.date_format(moved, "MM"), sign, F.date_format(moved, "yyyy")))
    return (
        F.when(kind == "email", permute_letters(value, key))
        .when(kind == "ip", dotted)
        .when(kind == "date", date)
        .when(kind == "card", _written(value, F.concat(body, check)))
        .when(kind == "phone", _written(value, phone))
        .when(kind == "ssn", _written(value, permute_ssn(digits, key)))
    )


def permute_ssn(digits: Column, key: str) -> Column:
    """Another valid number of nine digits: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    number = lambda start, n: F.substr(digits, F.lit(start), F.lit(n)).cast("bigint")
    area = number(1, 3)
    place = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + number(4, 2) - 1
    moved = feistel(place * 9999 + number(6, 4) - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"), F.lit("ssn"), key)
    left, serial = F.call_function("div", moved, F.lit(9999)), F.pmod(moved, F.lit(9999)) + 1
    area, group = F.call_function("div", left, F.lit(99)), F.pmod(left, F.lit(99)) + 1
    area = F.when(area >= 665, area + 2).otherwise(area + 1)
    return F.concat(*[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (group, 2), (serial, 4))])


#: Characters of a name or domain that are turned together; that of valid names.
LONGEST = 64
_LOW, _NUM = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def permute_letters(value: Column, key: str) -> Column:
    """Letters and digits of the name, and of the domain except its last label, shifted within their class.

    The domain is worked out by itself, so addresses of one domain share theirs; the name's shifts depend on it.  Case
    takes no part and is put back in the end.  Signs before the name stay, and don't count as part of it.  Two passes, forwards and backwards, each shift a character by a number
    made from the ones the pass has already written, so every character depends on the whole and the map can be undone
    with the key.  Names and domains of more than ``LONGEST`` characters are turned part by part, each with the part
    before it as written in the original.
    """
    low = F.lower(value)
    rest, end = F.substring_index(low, "@", -1), F.regexp_extract(low, "\\.[a-z]+$", 0)
    lead = F.regexp_extract(low, "^[._%+-]*", 0)
    parts = F.struct(
        lead.alias("lead"),
        F.substr(F.substring_index(low, "@", 1), F.length(lead) + 1).alias("name"),
        F.substr(rest, F.lit(1), F.length(rest) - F.length(end)).alias("domain"),
        end.alias("end"),
    )
    # what is used for every character is worked out once
    bound = lambda x, body: F.get(F.transform(F.array(x), body), 0)

    def one(text: Column, tweak: Column) -> Column:
        def turn(out: Column, c: Column) -> Column:
            k = keyed([tweak, out], key)
            shift = lambda letters: F.substr(F.lit(letters), F.pmod(F.call_function("instr", F.lit(letters), c) - 1 + k, F.lit(len(letters))).cast("int") + 1, F.lit(1))
            return F.concat(out, F.when(c.rlike("[a-z]"), shift(_LOW)).when(c.rlike("[0-9]"), shift(_NUM)).otherwise(c))

        return F.aggregate(F.split(text, ""), F.lit(""), turn)

    turned = lambda text, tweak: F.reverse(one(F.reverse(one(text, F.concat(F.lit("forth/"), tweak))), F.concat(F.lit("back/"), tweak)))

    def both(text: Column, tweak: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f".{{1,{LONGEST}}}"), F.lit(0))
        before = lambda of: F.slice(F.concat(F.array(F.lit("")), of), F.lit(1), F.size(of))
        long = bound(F.sha2(tweak, 256), lambda t: F.array_join(bound(pieces, lambda of: F.zip_with(of, before(of), lambda x, was: turned(x, F.concat_ws("/", t, was)))), ""))
        return F.when(F.length(text) <= LONGEST, turned(text, tweak)).otherwise(long)

    written = bound(parts, lambda p: F.concat(p["lead"], both(p["name"], F.concat(p["domain"], p["end"])), F.lit("@"), both(p["domain"], p["end"]), p["end"]))
    cased = F.zip_with(F.split(value, ""), F.split(written, ""), lambda v, w: F.when(v.rlike("[A-Z]"), F.upper(w)).otherwise(w))
    return F.array_join(cased, "")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind> (long) for each row of ``docs`` (doc_id, text; other columns are not read).

    A null text stays null, an empty one empty; both have no values.  Values that fail validation are left as they
    are.  Repeated rows and null doc_ids are handled like any other; an empty table gives no row.
    """
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    step = docs.select("doc_id", "text", found.alias("m"))
    # few texts have values: only these are cut up
    step = step.select("doc_id", "text", F.transform("m", lambda v: F.struct(v.alias("v"), kind_of(v).alias("k"))).alias("m"))
    named = F.transform("m", lambda x: F.when(x["k"].isNull(), x["v"]).otherwise(pseudonym(x["v"], x["k"], key)))
    between = F.split("text", ANY, -1)
    text = F.array_join(F.flatten(F.zip_with(between, named, lambda b, v: F.array(b, F.coalesce(v, F.lit(""))))), "")
    text = F.when(F.exists("m", lambda x: x["k"].isNotNull()), text).otherwise(F.col("text"))
    count = lambda k: F.size(F.filter("m", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return step.select("doc_id", text.alias("text"), *map(count, KINDS))


def session_key(spark: SparkSession) -> str:
    """The session's key.  Only a session on one machine (tests and checks) may name none, as TEST_KEY is known to all."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY_SETTING} must name a secret key")
        key = TEST_KEY
    return key


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), session_key(spark))
