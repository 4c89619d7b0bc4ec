import hashlib
from collections import defaultdict
from math import floor, log

import pytest
from brute import words

from marquee.llm import mixing
from tests.conftest import SMALL


def weights(tokens, t):
    raw = {s: (n / max(tokens.values())) ** t for s, n in tokens.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def brute(rows, block=mixing.BLOCK, budget=None):
    """(doc_id, source, block, place, epoch) drawn of (doc_id, text, source)."""
    counted = [(i, s or "", max(1, len(words(t)))) for i, t, s in rows]
    tokens, n_rows = defaultdict(int), defaultdict(int)
    for _, s, n in counted:
        tokens[s] += n
        n_rows[s] += 1
    t = mixing.repeats_exponent(min(tokens.values()), max(tokens.values()), mixing.REPEATS) if len(tokens) > 1 else 1.0
    w = weights(tokens, t)
    total = max((n / w[s] for s, n in tokens.items()), default=0) if budget is None else budget
    blocks = defaultdict(list)
    for i, s, n in counted:
        h = hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}:{n}".encode()).hexdigest()
        blocks[s, int(h[:8], 16) % max(1, -(-n_rows[s] // block))].append((h, -1 if i is None else i, n))
    out = []
    for (s, b), docs in blocks.items():
        epochs = w[s] * total / tokens[s]
        whole, size, upto = floor(epochs + 1e-9), sum(n for *_, n in docs), 0
        for place, (h, i, n) in enumerate(sorted(docs), 1):
            upto += n
            rest = (epochs - whole) * size
            left, draw = rest - (upto - n), int(h[8:16], 16)
            for epoch in range(1, 1 + whole + (upto <= rest + 1e-6 or (left > 1e-6 and draw * n < left * 2**32))):
                out.append((i, s, n, b, place, epoch))
    return sorted(out)


def rows_of(n=300):
    sizes = {"web": n, "book": n // 6, "code": n // 20, None: 3}
    out, i = [], 0
    for s, k in sizes.items():
        for _ in range(k):
            out.append((i, "tok " * (1 + i % 40), s))
            i += 1
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS block", "'x' AS epochs", "2 AS n_tokens")


@pytest.mark.parametrize("block", [7, 1000])
def test_draws_equal_brute_force(spark, block):
    rows = rows_of()
    found = mixing.mix(table(spark, rows), block=block).collect()
    assert sorted((r["doc_id"], r["source"], r["n_tokens"], r["block"], r["place"], r["epoch"]) for r in found) == brute(rows, block)


def test_every_document_is_seen_and_small_sources_at_most_twice(spark):
    rows = rows_of()
    seen = defaultdict(int)
    for r in mixing.mix(table(spark, rows)).collect():
        seen[r["doc_id"]] += 1
    assert set(seen) == {i for i, *_ in rows} and max(seen.values()) == 2


def test_targets(spark):
    tokens = {"a": 1_000_000, "b": 50_000, "c": 700}
    sums = spark.createDataFrame([(s, float(n), 1) for s, n in tokens.items()], "source string, n double, rows bigint")
    of = lambda t: -sum(x * log(x) for x in weights(tokens, t).values())
    assert abs(of(mixing.entropy_exponent(sums, sum(tokens.values()), 0.9)) - 0.9) < 1e-6
    assert mixing.entropy_exponent(sums, sum(tokens.values()), 5.0) == 0.0 and mixing.entropy_exponent(sums, sum(tokens.values()), 0.0) == 1.0
    w = weights(tokens, mixing.repeats_exponent(700, 1_000_000, 4.0))
    rates = [w[s] / n for s, n in tokens.items()]
    assert abs(max(rates) / min(rates) - 4) < 1e-6
    assert mixing.repeats_exponent(700, 1_000_000, 1.0) == pytest.approx(1.0)


def test_entropy_is_realised(spark):
    """Drawn tokens of each source follow the weights whose entropy was asked for."""
    rows = rows_of(600)
    drawn = defaultdict(int)
    for r in mixing.mix(table(spark, rows), repeats=None, entropy=1.1).collect():
        drawn[r["source"]] += r["n_tokens"]
    w = [n / sum(drawn.values()) for n in drawn.values()]
    assert abs(-sum(x * log(x) for x in w) - 1.1) < 0.02


def test_weights_are_met_with_long_documents(spark):
    """A few documents hold nearly all tokens of a source: drawn and planned tokens agree over many keys."""
    rows = [(i, "tok " * (4000 if i % 40 == 0 else 3), "long") for i in range(120)] + [(1000 + i, "tok " * 500, "web") for i in range(120)]
    docs = table(spark, rows)
    total = defaultdict(int)
    for k in range(12):
        for r in mixing.mix(docs, block=10, seed=f"s{k}").collect():
            total[r["source"]] += r["n_tokens"]
    tokens = {"long": sum(4000 if i % 40 == 0 else 3 for i in range(120)), "web": 60_000}
    w = weights(tokens, mixing.repeats_exponent(min(tokens.values()), max(tokens.values()), 2.0))
    assert abs(total["long"] / total["web"] / (w["long"] / w["web"]) - 1) < 0.15


def test_carry_gives_each_drawn_row(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "c", "x"), (None, "d", None), (None, None, None)]
    docs = table(spark, rows)
    found = mixing.mix(docs, carry=True).select("row.*", "epoch")
    assert found.columns == [*docs.columns, "epoch"]
    assert sorted(map(str, found.filter("epoch = 1").select("doc_id", "text", "source").collect())) == sorted(map(str, docs.select("doc_id", "text", "source").collect()))


def test_budget_is_met(spark):
    rows = rows_of(600)
    drawn = mixing.mix(table(spark, rows), budget=4000).collect()
    assert abs(sum(r["n_tokens"] for r in drawn) - 4000) < 100


def test_odd_rows(spark, odd_rows):
    rows = [(i, t, ["x", None, ""][k % 3]) for k, (i, t) in enumerate(odd_rows)]
    found = mixing.mix(table(spark, rows)).collect()
    assert len({(r["doc_id"], r["place"], r["block"], r["source"]) for r in found}) == len(rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["source"], r["n_tokens"], r["block"], r["place"], r["epoch"]) for r in found) == brute(rows)
    assert mixing.mix(table(spark, [])).collect() == []


def test_documents_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = mixing.op3_source_mixing(spark, SMALL)
    want = con.sql(mixing.ORACLE_SQL)
    assert sorted(map(tuple, found.select(*want.columns).collect())) == sorted(want.fetchall())
