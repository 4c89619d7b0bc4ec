import hashlib
import random
import re
import time
from datetime import date, timedelta

import pytest
from brute import luhn
from pyspark.sql import functions as F

from marquee.llm import pii

KEY = "test"


def card(seed, n=16):
    body = str(4 * 10 ** (n - 2) + seed * 7919)[: n - 1].ljust(n - 1, "1")
    return next(body + c for c in "0123456789" if luhn(body + c))


def one(documents, text):
    (r,) = pii.pseudonymised(documents([(1, text)]), KEY).collect()
    return r


def test_feistel_is_a_permutation(spark):
    for left, right in ((10, 10), (189, 773), (1, 10), (7, 100)):
        n = min(left * right, 3000)
        rows = spark.range(left * right).limit(n).select(pii.feistel(F.col("id"), F.lit(left).cast("bigint"), F.lit(right).cast("bigint"), F.lit("t"), KEY).alias("p")).collect()
        got = {r["p"] for r in rows}
        assert len(got) == n and min(got) >= 0 and max(got) < left * right


def test_digits_keep_their_number(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = [r["p"] for r in rows.select(pii.permute_digits(F.col("d"), "x", KEY).alias("p")).collect()]
    assert len(set(out)) == 1000 and all(re.fullmatch("[0-9]{3}", x) for x in out)


def test_values_keep_their_format(documents):
    number = card(3)
    text = f"mail Ann.Lee99@mail.example.com or 10.0.255.7, card {number[:4]}-{number[4:8]}-{number[8:12]}-{number[12:]}, call +31 6 1234 5678 or (555) 123-4567, ssn 123-45-6789, born 1985-02-28 or 31/12/1999."
    r = one(documents, text)
    shape = lambda s: re.sub("[0-9]+", lambda m: "9" * len(m[0]), s)
    out = r["text"]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["n_ssn"], r["n_date"]) == (1, 1, 1, 2, 1, 2)
    for value in ("Ann.Lee99", "10.0.255.7", number[4:8], "1234 5678", "123-4567", "123-45-6789", "1985-02-28", "31/12/1999"):
        assert value not in out
    cards = re.findall("[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}", out)
    assert len(cards) == 1 and luhn(cards[0].replace("-", ""))
    assert re.search(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}[0-9]{2}@[a-z]{4}\.[a-z]{7}\.com", out)
    ip = re.search(r"or ([0-9.]+), card", out)[1]
    assert all(0 <= int(x) <= 255 for x in ip.split("."))
    iso = re.search(r"born ([0-9-]+)", out)[1]
    assert date(1800, 1, 1) <= date.fromisoformat(iso) < date(2200, 1, 1)
    assert "+31 " in out and shape(out[out.index("ssn") : out.index(", born")]) == "ssn 999-99-9999"


def test_invalid_values_stay(documents):
    number = card(5)
    bad = number[:-1] + str((int(number[-1]) + 1) % 10)
    text = f"card {bad} date 2023-02-30 ip 300.1.1.1 version 1.2.3 ssn 000-12-3456 and 666-12-3456, pi 3.14159"
    r = one(documents, text)
    assert r["text"] == text
    assert sum(r[f"n_{k}"] for k in pii.KINDS) == 0


def test_equal_values_are_linked_and_others_differ(documents):
    start = date(1990, 1, 1)
    values = [card(i) for i in range(60)] + [(start + timedelta(days=i)).isoformat() for i in range(60)] + [f"user{i}@example.com" for i in range(60)]
    rows = [(i, f"it says {v} here") for i, v in enumerate(values)] + [(1000 + i, f"again {v}, and {v}") for i, v in enumerate(values)]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymised(documents(rows), KEY).collect()}
    named = {}
    for i, v in enumerate(values):
        p = out[i].removeprefix("it says ").removesuffix(" here")
        assert out[1000 + i] == f"again {p}, and {p}"
        named[v] = p
    assert len(set(named.values())) == len(values)
    assert sum(v == p for v, p in named.items()) <= 1


def test_keys_differ(documents):
    rows = [(1, "id 123-45-6789")]
    a, b = (pii.pseudonymised(documents(rows), key).first()["text"] for key in ("k1", "k2"))
    assert a != b


def test_odd_rows(documents, odd_rows):
    found = pii.pseudonymised(documents(odd_rows), KEY).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in found))) == sorted(map(repr, odd_rows))
    assert pii.pseudonymised(documents([]), KEY).collect() == []


def test_values_next_to_each_other(documents):
    number = card(8)
    for text in (f"+1 (826) 555-4081 190.137.223.204 {number}", f"{number} {card(9)} +1 (826) 555-4081", "a@b.com c@d.org 10.1.2.3 2001-01-01"):
        r = one(documents, text)
        assert all(a != b for a, b in zip(text.split(), r["text"].split()) if a != "+1"), r["text"]
        assert len(r["text"]) >= len(text) - 9 and len(r["text"].split()) == len(text.split())


#: Each format of each kind.
FORMATS = {
    "email": ("ann@mail.example.com", "a@b.co", "x.y-z+1@-odd.example.org"),
    "ip": ("10.0.255.7", "1.2.3.4"),
    "card": (card(3), card(4, 13), "-".join(re.findall("....", card(6))), " ".join(re.findall("....", card(7)))),
    "phone": ("+1 (826) 555-4081", "+31 6 1234 5678", "+31612345678", "+44 (20) 7946 0958", "(555) 123-4567", "(555)123-4567", "555-123-4567", "555.123.4567"),
    "ssn": ("123-45-6789",),
    "date": ("1985-03-14", "14/03/1985", "14.03.1985"),
}


def test_each_format_alone_in_a_text(documents):
    values = [(k, v) for k, of in FORMATS.items() for v in of]
    # next to words, as the whole text, and among the other values of its document
    rows = [(3 * i + j, text.format(v)) for i, (_, v) in enumerate(values) for j, text in enumerate(("born on {} in Leiden", "{}", "{} with ann@mail.example.net"))]
    out = {r["doc_id"]: r for r in pii.pseudonymised(documents(rows), KEY).collect()}
    for i, (kind, v) in enumerate(values):
        near, alone, among = (out[3 * i + j] for j in range(3))
        assert [alone[f"n_{k}"] for k in pii.KINDS] == [near[f"n_{k}"] for k in pii.KINDS] == [int(k == kind) for k in pii.KINDS], v
        assert alone["text"] != v and near["text"] == f"born on {alone['text']} in Leiden"
        assert among["text"].startswith(alone["text"] + " with ")


def keyed(*parts):
    return int(hashlib.sha256("|".join([KEY, *map(str, parts)]).encode()).hexdigest()[:13], 16)


def feistel(value, left, right, tweak):
    a, b = divmod(value, right)
    for i in range(8):
        if i % 2 == 0:
            a = (a + keyed(tweak, i, b)) % left
        else:
            b = (b + keyed(tweak, i, a)) % right
    return a * right + b


def permuted(digits, tweak):
    n = len(digits)
    return str(feistel(int(digits), 10 ** (n // 2), 10 ** (n - n // 2), f"{tweak}/{n}")).zfill(n)


def letters(text, tweak):
    for direction in ("forth/", "back/"):
        out = ""
        for c in text:
            of = "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else "0123456789" if c.isdigit() else ""
            out += of[(of.index(c) + keyed(direction + tweak, out)) % len(of)] if of else c
        text = out[::-1]
    return text


def written(shape, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in shape)


def brute_value(v):
    """(kind, pseudonym) of a match, (None, match) if it is not valid: worked out from the description alone."""
    d = re.sub("[^0-9]", "", v)
    full = {k: re.fullmatch(p, v) for k, p in pii.PATTERNS.items()}
    if full["email"]:
        name, rest = v.lower().split("@")
        domain, end = rest.rsplit(".", 1)
        lead = name[: len(name) - len(name.lstrip("._%+-"))]  # signs before the name are no part of it
        new = lead + letters(name[len(lead) :], rest) + "@" + letters(domain, "." + end) + "." + end
        return "email", "".join(w.upper() if c.isupper() else w for c, w in zip(v, new))
    if full["ip"]:
        x = 0
        for o in v.split("."):
            x = x * 256 + int(o)
        x = feistel(x, 65536, 65536, "ip")
        return "ip", ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))
    if full["date"]:
        y, m, day = (v[:4], v[5:7], v[8:]) if v[4] == "-" else (v[6:], v[3:5], v[:2])
        try:
            k = (date(int(y), int(m), int(day)) - date(1800, 1, 1)).days
        except ValueError:
            pass
        else:
            new = date(1800, 1, 1) + timedelta(days=feistel(k, 189, 773, "date"))
            return "date", new.isoformat() if v[4] == "-" else v[2].join((f"{new.day:02}", f"{new.month:02}", str(new.year)))
    if full["ssn"] and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000":
        areas = [a for a in range(1, 900) if a != 666]
        x = feistel((areas.index(int(d[:3])) * 99 + int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898 * 99, 9999, "ssn")
        x, serial = divmod(x, 9999)
        return "ssn", written(v, f"{areas[x // 99]:03}{x % 99 + 1:02}{serial + 1:04}")
    if re.fullmatch("[0-9 -]+", v) and 13 <= len(d) <= 19 and luhn(d):
        body = permuted(d[:-1], "card")
        return "card", written(v, next(body + c for c in "0123456789" if luhn(body + c)))
    if full["phone"] and 8 <= len(d) <= 15:
        two = {"20", "27", *map(str, (*range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98))}
        n = 0 if v[0] != "+" else 1 if d[0] in "17" else 2 if d[:2] in two else 3
        return "phone", written(v, d[:n] + permuted(d[n:], "phone"))
    return None, v


def brute(text):
    kinds = []

    def turn(m):
        kind, new = brute_value(m[0])
        kinds.append(kind)
        return new

    return re.sub(pii.ANY, turn, text or "") if text else text, kinds


def test_brute_force(documents):
    """Random texts made of values, valid or not, near each other and among words, and the table's own texts."""
    rnd = random.Random(7)
    digits = lambda n: "".join(rnd.choices("0123456789", k=n))
    make = [
        lambda: f"{rnd.choice(['Ann', 'bob.x', 'A-b_9', 'ÉÉ'])}{digits(rnd.randint(0, 2))}@{rnd.choice(['Example.com', 'mail.example.co.uk', 'x-1.org', 'bad', 'a.b.c1'])}",
        lambda: ".".join(str(rnd.randint(0, 300)) for _ in range(4)),
        lambda: card(rnd.randint(1, 99), rnd.choice((13, 15, 16, 19))),
        lambda: "-".join(re.findall("....", card(rnd.randint(1, 99)))),
        lambda: digits(16),
        lambda: f"+{digits(rnd.randint(1, 3))} {digits(3)} {digits(4)}",
        lambda: f"+{rnd.choice(['1', '31', '353', '7', '44'])}{digits(9)}",
        lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"{rnd.randint(1790, 2210)}-{rnd.randint(1, 13):02}-{rnd.randint(1, 31):02}",
        lambda: f"{rnd.randint(1, 31):02}/{rnd.randint(1, 13):02}/{rnd.randint(1790, 2210)}",
        lambda: rnd.choice(["word", "x", "1", "...", "\n", "@", "+", "naïve", "😀", "1234567890" * 3, "a" * 40, "000-12-3456", "666-12-3456"]),
    ]
    rows = [(i, "".join(rnd.choice(make)() + rnd.choice(["", " ", ", ", ". ", "/", "-"]) for _ in range(rnd.randint(1, 12)))) for i in range(600)]
    found = {r["doc_id"]: r for r in pii.pseudonymised(documents(rows), KEY).collect()}
    seen = set()
    for i, text in rows:
        new, kinds = brute(text)
        assert found[i]["text"] == new, text
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS], text
        seen.update(kinds)
    assert seen == {*pii.KINDS, None}


def test_documents(spark):
    from tests.conftest import SMALL

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        found = pii.op2_pii_pseudonyms(spark, SMALL).collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert len(found) == len(texts)
    for r in found:
        new, kinds = brute(texts[r["doc_id"]])
        assert (r["text"], sum(r[f"n_{k}"] for k in pii.KINDS)) == (new, len([k for k in kinds if k]))


def test_writing_does_not_matter(documents):
    """A value's pseudonym is the same digits (or letters) in every writing, and again a valid value of its kind."""
    same = [("+1 555 123 4567", "+15551234567", "+1 (555) 123-4567"), ("+31 6 1234 5678", "+31612345678"), ("Bob.Lee@Example.com", "bob.lee@example.com", "BOB.LEE@EXAMPLE.com"), ("4000-0000-0000-0002", "4000 0000 0000 0002", "4000000000000002")]
    for values in same:
        out = [one(documents, v)["text"] for v in values]
        assert len({re.sub("[^a-z0-9]", "", x.lower()) for x in out}) == 1 and out[0].lower() != values[0].lower()
    a, b = one(documents, "ann@mail.example.com bob@mail.example.com")["text"].split()
    assert a.split("@")[1] == b.split("@")[1] != "mail.example.com"
    rows = [(i, f"{1 + i % 898 + (i % 898 >= 665):03}-{1 + i % 99:02}-{1 + i * 7 % 9999:04}") for i in range(3000)]
    first = pii.pseudonymised(documents(rows), KEY)
    again = pii.pseudonymised(first.select("doc_id", "text"), KEY).collect()
    assert all(r["n_ssn"] == 1 for r in again) and len({r["text"] for r in again}) == len({t for _, t in rows})


def test_long_texts_take_linear_time(documents):
    """Runs that start every pattern and end none of them, a megabyte each, and very many values in one text."""
    n = 1_000_000
    texts = ["a" * n + " +1 555 123 4567", "a." * (n // 2) + " 123-45-6789", "a@" * (n // 2) + " 10.1.2.3", "x@" + "b." * (n // 2) + "1", "1 " * (n // 2), "1.2." * (n // 4), "+1-" * (n // 3), "a" * 200_000 + "@b.com", "ann@example.com " * 20_000 + " ".join(f"{100 + i % 500}-45-{1000 + i % 9000}" for i in range(20_000))]
    docs = documents(list(enumerate(texts)))
    began = time.perf_counter()
    found = {r["doc_id"]: r for r in pii.pseudonymised(docs, KEY).collect()}
    assert time.perf_counter() - began < 240
    assert (found[0]["n_phone"], found[1]["n_ssn"], found[2]["n_ip"]) == (1, 1, 1)
    assert (found[8]["n_email"], found[8]["n_ssn"]) == (20_000, 20_000)


def test_long_addresses(documents):
    """Names and domains of any length are replaced whole; signs before a name stay and don't change its pseudonym."""
    long = "a" * 60 + "." + "b" * 10 + "@x.org"
    values = [long, "q" * 65 + "@x.org", ("name" * 400 + "%") * 100 + "@" + "sub-" * 300 + "end.example.org", "ann.smith@x.org"]
    rows = [(i, f"mail {v} now") for i, v in enumerate(values)] + [(10, "...--ann.smith@x.org, +ann.smith@x.org"), (11, "_" * 500_000 + "@ " + "a." * 300_000)]
    found = {r["doc_id"]: r for r in pii.pseudonymised(documents(rows), KEY).collect()}
    seen = [found[i]["text"].removeprefix("mail ").removesuffix(" now") for i in range(len(values))]
    for v, s in zip(values, seen):
        assert len(v) == len(s) and s.endswith(".org") and [c.isalnum() for c in v] == [c.isalnum() for c in s]
        # no part of 20 characters with letters is left as it was
        assert not any(v[i : i + 20] == s[i : i + 20] for i in range(len(v) - 24))
    assert found[10]["text"] == f"...--{seen[3]}, +{seen[3]}" and found[10]["n_email"] == 2
    assert found[11]["text"] == rows[-1][1]


def test_key_of_a_session(spark):
    class Other:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "yarn"

    assert pii.session_key(spark) == pii.TEST_KEY
    with pytest.raises(ValueError):
        pii.session_key(Other)
