import duckdb
from brute import base_counts

from marquee.llm import quality
from tests.conftest import SMALL

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(rows, found):
    assert len(rows) == len(found)
    want = sorted(((i, *base_counts(t)) for i, t in rows), key=str)
    assert want == sorted(((r["doc_id"], *(r[f] for f in FIELDS)) for r in found), key=str)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_odd_rows(documents, odd_rows):
    repeats = [(20, "a b c a b c a b"), (21, "x y\nx y\n\nx y\nz"), (22, "a a a a a"), (23, "#*$%&|<> 😀 é"), (24, "one two three one two three")]
    check(odd_rows + repeats, quality.quality(documents(odd_rows + repeats)).collect())


def test_empty_table(documents):
    assert quality.quality(documents([])).collect() == []


def test_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    check(rows, quality.op1_quality_rules(spark, SMALL).collect())


def test_estimation_finds_rules_accuracies():
    """Votes drawn from known rules: the posterior tells the two kinds apart, and rules' rates are found."""
    import random

    rnd = random.Random(5)
    counts, truth = {}, []
    for _ in range(20_000):
        good = rnd.random() < 0.8
        bad = 0.002 if good else 0.4
        vote = tuple(-1 if rnd.random() < bad else (1 if rnd.random() < (0.7 if good else 0.2) else 0) for _ in range(5))
        truth.append((good, vote))
        counts[vote] = counts.get(vote, 0) + 1
    share, chance, post = quality.fit(counts)
    assert abs(share - 0.8) < 0.05
    assert sum((post[v] >= 0.5) == g for g, v in truth) / len(truth) > 0.93
    assert all(abs(c[-1, -1] - 0.4) < 0.1 for c in chance)


def test_clean_texts_stay_and_junk_goes(documents):
    clean = [(i, " ".join(f"word{(i * 7 + j * 13) % 97} of line" for j in range(60))) for i in range(40)]
    junk = [(100 + i, "### $$$ *** " * 60 + " ".join(f"x{j}" for j in range(40))) for i in range(6)]
    kept = {r["doc_id"] for r in quality.quality(documents(clean + junk)).filter("kept").collect()}
    assert kept == {i for i, _ in clean}


def test_base_columns_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found, want = quality.quality_base_counts(spark, SMALL), con.sql(quality.BASE_SQL)
    assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_posterior_agrees_with_labels(spark):
    """Labels that the method never sees: good texts have a high posterior, bad ones a low one."""
    from tests.conftest import MIDDLE

    found = quality.op1_quality_rules(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").select("quality", "posterior", "kept").collect()
    good, bad = ([r for r in found if r["quality"] == q] for q in (1, 0))
    assert len(good) > 100 and len(bad) > 20
    assert sum(r["posterior"] >= 0.5 for r in good) >= 0.97 * len(good) and sum(r["kept"] for r in good) >= 0.9 * len(good)
    assert sum(r["posterior"] >= 0.5 for r in bad) <= 0.05 * len(bad)
