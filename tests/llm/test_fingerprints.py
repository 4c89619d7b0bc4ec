import hashlib
import random

import pytest
import xxhash
from brute import LOWER, shingles, words
from compare import connect, spark_rows, sql_rows

from marquee.llm import fingerprints
from marquee.llm.common import Scratch
from tests.conftest import MIDDLE, SMALL

BINS, BITS = fingerprints.BINS, fingerprints.BITS


def xx(*values):
    """Spark's xxhash64 of strings and longs (ints: four bytes)."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v
        h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def int4(v):
    return v.to_bytes(4, "little", signed=True)


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return ""
    if len(w) < 5:
        h = 0
        for x in w:
            h = xx(h, x)
        hashes = [h]
    else:
        hashes = [xx(*w[i : i + 5]) for i in range(len(w) - 4)]
    bins = [None] * BINS
    rest = (1 << 56) - 1
    for h in hashes:
        b, v = (h >> 56) + BINS // 2, h & rest
        bins[b] = v if bins[b] is None else min(bins[b], v)
    full = [j for j in range(BINS) if bins[j] is not None]
    dense = []
    for i in range(BINS):
        v = bins[i]
        for k in range(fingerprints.TRIES):
            if v is None:
                v = bins[xx(int4(i), int4(k)) % BINS]
        if v is None:
            v = bins[min(full, key=lambda j: xx(int4(i), int4(j), "order"))]
        dense.append(v)
    return "".join("0123456789abcdef"[v & 15] for v in dense)


def likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / BINS - 1 / 16) / (15 / 16))


def result(rows):
    """Rows of op13 over (doc_id, text), ids without repeats."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        t, after = texts[i], texts[(i + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = map(fingerprint, (t, edited, after))
        out.append((doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out, key=str)


def found(spark, docs):
    with Scratch(spark) as scratch:
        df = fingerprints.with_fingerprint(fingerprints.edits(docs, scratch), "edited", "e")
        df = df.selectExpr("*", "sha2(edited, 256) AS s").withColumn("x", fingerprints.likeness("fingerprint", "e")).withColumn("y", fingerprints.likeness("fingerprint", "next_fingerprint"))
        return sorted(((r["doc_id"], r["n_chars"], r["s"], r["fingerprint"], r["e"], round(r["x"], 9), round(r["y"], 9)) for r in df.collect()), key=str)


def test_against_brute_force(spark, documents):
    rnd = random.Random(3)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "Straße", "\U0001f600", "a b", "WORD"]
    rows = [(i * 7, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 4, 5, 6, 30, 300, 1500])))) for i in range(60)]
    rows += [(None, "null id, one two three four five six"), (-3, None), (-4, ""), (-5, " \t\n "), (-6, "x" * 1_000_000), (-7, "word " * 200_000)]
    assert found(spark, documents(rows)) == result(rows)


def test_equal_rows_and_ids(spark, documents):
    """Rows that share ids, equal rows among them: each has one successor, and all texts are used as often as they are there."""
    rows = [(5, "a b c d e f")] * 3 + [(5, "b c d e f g")] * 2 + [(None, None)] * 2 + [(1, "z" * 9)]
    got = found(spark, documents(rows))
    assert len(got) == len(rows)
    own = hashlib.sha256(b"a b c d e f"[:8] + b"a b").hexdigest()
    assert sum(r[2] == own for r in got) >= 2
    assert found(spark, documents(rows)) == got


@pytest.mark.parametrize("rows", [[], [(1, "one two three four five six")], [(1, None)]])
def test_small_tables(spark, documents, rows):
    assert found(spark, documents(rows)) == result(rows)


def test_estimates_are_unbiased(spark):
    """Pairs of sets of known similarity, sparse ones with most bins empty among them."""
    rnd = random.Random(8)
    rows = []
    for shared, own in ((0, 400), (100, 300), (200, 200), (300, 100), (20, 20), (400, 0), (5, 5)):
        for _ in range(60):
            a, b = ([f"{rnd.random()}" for _ in range(own)] for _ in "ab")
            # single words apart, so that shingles are whole blocks of five
            both = [f"{rnd.random()}" for _ in range(shared)]
            rows.append((shared, own, " ".join(both + a), " ".join(both + b)))
    df = spark.createDataFrame(rows, "shared int, own int, a string, b string").repartition(4)
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb").withColumn("x", fingerprints.likeness("fa", "fb"))
    errors = {}
    for r in df.collect():
        x, y = shingles(r["a"]), shingles(r["b"])
        errors.setdefault((r["shared"], r["own"]), []).append(r["x"] - len(x & y) / len(x | y))
    for (shared, own), e in errors.items():
        assert abs(sum(e) / len(e)) < (0.08 if shared + own < 50 else 0.03), (shared, own, sum(e) / len(e))


def test_query_on_the_smallest_table(spark):
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = sorted((tuple(r)[:5] + (round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fingerprints.op13_document_fingerprints(spark, SMALL).collect()), key=str)
    assert got == result(rows)


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_edits_against_sql(spark, folder):
    names, rows = spark_rows(fingerprints.fingerprint_edits(spark, folder))
    want_names, want = sql_rows(connect(folder), fingerprints.EDITS_SQL)
    assert names == want_names and rows == want
