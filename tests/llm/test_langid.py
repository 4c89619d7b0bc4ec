import random
import time
from math import exp, log

import duckdb
import pytest

from marquee.llm import langid
from tests.conftest import MIDDLE, SMALL

ROWS = "id bigint, text string, declared string, host string"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{SMALL}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL"))


def levels(host):
    x = host.split(".")
    return ".".join(x[-2:]), x[-1]


def brute(rows, names, logs, html=False):
    """[(lang, probability)] of rows, from the description: all evidence added up as logarithms, in plain Python."""
    n, scores = len(names), []
    for _, text, *_ in rows:
        text = langid.plain_text(text or "") if html else text or ""
        total = [0.0] * n
        if text.strip():
            low = (text if len(text) >= 3 else text).lower()
            low = low if len(low) >= 3 else "   "[len(low) - 3 :] if not low else low + " " * (3 - len(low))
            for k in range(len(low) - 2):
                (b,) = langid.gram_buckets(low[k : k + 3])
                total = [t + langid.DAMP * float(logs[j, b]) for j, t in enumerate(total)]
        scores.append(total)
    first = [max(range(n), key=lambda j: (s[j], -j)) if max(s) > min(s) else None for s in scores]
    count = lambda fit: [sum(f == j and fit(r) for f, r in zip(first, rows)) for j in range(n)]
    whole = count(lambda r: True)
    share = [(x + 1) / (sum(whole) + n) for x in whole]
    smooth = lambda c, prior: [(x + 10 * p) / (sum(c) + 10) for x, p in zip(c, prior)]
    out = []
    for (_, _, declared, host), score in zip(rows, scores):
        host = host or ""
        domain, suffix = levels(host)
        total = list(score)
        if declared is not None:
            seen = count(lambda r: r[2] == declared)
            total = [t + log((x + 1) / (w + 2)) for t, x, w in zip(total, seen, whole)]
        if host:
            seen = count(lambda r: levels(r[3] or "")[1] == suffix)
            total = [t + log((x + 1) / (w + 2)) for t, x, w in zip(total, seen, whole)]
        up = smooth(count(lambda r: levels(r[3] or "")[0] == domain), share)
        total = [t + log(p) for t, p in zip(total, smooth(count(lambda r: (r[3] or "") == host), up))]
        raised = [exp(t - max(total)) for t in total]
        best = max(range(n), key=lambda j: (raised[j], -j))
        out.append((names[best], raised[best] / sum(raised)))
    return out


def test_brute_force(spark, model):
    """Rows with all, some and none of the evidence, also conflicting; short texts so that no piece decides alone."""
    names, logs = model
    rnd = random.Random(4)
    texts = duckdb.sql(f"SELECT lang, text FROM '{SMALL}/documents.parquet' WHERE length(text) > 300 ORDER BY doc_id").fetchall()
    rows = []
    for i in range(120):
        lang, text = rnd.choice(texts)
        at, size = rnd.randrange(200), rnd.choice((0, 1, 2, 3, 8, 20, 60))
        rows.append((i, rnd.choice((text[at : at + size], None if size < 3 else text[at : at + size])), rnd.choice((lang, None, None, rnd.choice(names), "xx")), rnd.choice(("", None, f"{lang}.a.example", "b.a.example", f"www.{lang}.test", "c.org", "org"))))
    found = {r["id"]: (r["lang"], r["probability"]) for r in langid.identify(spark.createDataFrame(rows, ROWS), names, logs, False).collect()}
    for r, (lang, p) in zip(rows, brute(rows, names, logs)):
        assert found[r[0]][0] == lang and abs(found[r[0]][1] - p) < 1e-5, r


def test_pieces_keep_every_trigram(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 7)
    for n in range(0, 40):
        text = "".join(chr(97 + k % 26) for k in range(n))
        got = [p[k : k + 3] for p in langid.pieces(text) for k in range(len(p) - 2)]
        assert got == [text[k : k + 3] for k in range(n - 2)]


def test_markup_takes_linear_time():
    n = 300_000
    began = time.perf_counter()
    for part in ("<script", "<!--", "<", "<style>", "<!-- -", "</script", "&amp", "<script></script"):
        langid.plain_text(part * (n // len(part)))
    assert time.perf_counter() - began < 20
    # without its end a style is a tag like any other, and a comment without end is text
    assert langid.plain_text("a<SCRIPT x>b<p></Script>c<style>d<!-- e").split() == ["a", "c", "d<!--", "e"]
    assert langid.plain_text("x <scripty>y</scripty> 1 < 2").split() == ["x", "y", "1", "<", "2"]


def test_sample_is_bounded_and_whole(spark):
    rows = [(i, "l" + str(i % 2), "t" * 5000) for i in range(400)] + [(None, "l0", "x"), (7, None, "x")]
    got = langid.sample(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), 20).collect()
    assert len(got) == 40 and all(len(r["text"]) == 5000 for r in got)


def test_held_out_accuracy(spark, model):
    """Texts of the larger table, most of which the model has not seen."""
    names, logs = model
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").filter("length(text) > 100")
    rows = docs.selectExpr("doc_id AS id", "text", "cast(null AS string) AS declared", "'' AS host")
    found = {r["id"]: r["lang"] for r in langid.identify(rows, names, logs, False).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect() if r["lang"]}
    right = sum(found[i] == lang for i, lang in truth.items())
    assert right / len(truth) > 0.95


def test_other_evidence_decides_where_text_says_nothing(spark, model):
    names, logs = model
    text = {lang: next(t for n, t in duckdb.sql(f"SELECT lang, text FROM '{SMALL}/documents.parquet' WHERE length(text) > 500").fetchall() if n == lang) for lang in ("fr", "de")}
    rows = [(i, text["fr"], "fr", "a.x.example") for i in range(20)] + [(100 + i, text["de"], "de", "b.y.test") for i in range(20)]
    rows += [(200, "", "fr", "other.z.org"), (201, None, None, "a.x.example"), (202, " ", None, "new.y.test"), (203, None, "de", None)]
    found = {r["id"]: r["lang"] for r in langid.identify(spark.createDataFrame(rows, ROWS), names, logs, False).collect()}
    assert [found[i] for i in (200, 201, 202, 203)] == ["fr", "fr", "de", "de"]


def test_markup_is_not_text(spark):
    assert langid.plain_text("<p>a<script>b</script>&amp;c<!-- d --></p>").split() == ["a", "c"]
    rows = spark.createDataFrame([('<!DOCTYPE html><HTML class=x lang="fr-CA">',), ("<html>",), (None,), ("<html lang='de'><p lang='en'>",)], "html string")
    assert [r["d"] for r in rows.select(langid.declared_language(rows.html).alias("d")).collect()] == ["fr", None, None, "de"]


def test_odd_rows(spark, odd_rows, model):
    names, logs = model
    rows = spark.createDataFrame([(i, t, None, None) for i, t in odd_rows], ROWS).selectExpr("*", "1 AS score", "'q' AS suffix", "2 AS domain")
    found = langid.identify(rows, names, logs, False).collect()
    assert len(found) == len(odd_rows) and all(r["lang"] in names and 0 < r["probability"] <= 1 for r in found)
    assert langid.identify(spark.createDataFrame([], ROWS), names, logs, False).collect() == []


def test_query_covers_both_tables(spark):
    found = langid.op6_language_id(spark, SMALL).collect()
    n = {t: duckdb.sql(f"SELECT count(*) FROM '{SMALL}/{t}.parquet'").fetchall()[0][0] for t in ("documents", "pages")}
    assert sum(r["doc_id"] is not None for r in found) == n["documents"]
    assert sum(r["page_id"] is not None for r in found) == n["pages"]
