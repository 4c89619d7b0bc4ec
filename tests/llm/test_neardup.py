import random

import duckdb
import numpy as np
import pytest
from brute import near_duplicates

from marquee.llm import neardup
from tests.conftest import SMALL


def check(rows, found, percent=85):
    want = near_duplicates([r for r in rows if r[0] is not None], percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found if r["doc_id"] is not None)


def family(rnd, n, size, changes, first):
    """A text and near copies of it: each has some words of its own."""
    base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(changes):
            text[rnd.randrange(size)] = f"own{rnd.randrange(10**6)}"
        out.append((first + i, " ".join(text)))
    return out


def test_odd_rows(documents, odd_rows):
    found = neardup.near_duplicates(documents(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    unique = [r for r in odd_rows if r[0] not in (4, 7)]
    check(unique, [r for r in found if r["doc_id"] not in (4, 7)])
    assert {(r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] == 4} == {(1, 4)}
    assert {r["component_id"] for r in found if r["doc_id"] == 7} == {7}
    assert all(r["component_id"] is None and r["kept"] is None for r in found if r["doc_id"] is None)


def test_empty_table(documents):
    assert neardup.near_duplicates(documents([])).collect() == []


def test_short_texts(documents):
    rows = [(1, "a b c d"), (2, "A B  C\nD"), (3, "a b c"), (4, "a b c d e"), (5, "a b c d e"), (6, "E a b c d")]
    check(rows, neardup.near_duplicates(documents(rows)).collect())


@pytest.mark.parametrize("percent", [80, 85])
def test_families_around_the_threshold(documents, percent):
    rnd = random.Random(3)
    rows, first = [], 0
    for changes in range(0, 9):
        for size in (60, 300):
            rows += family(rnd, 6, size, changes * (1 if size == 60 else 3), first)
            first += 10
    check(rows, neardup.near_duplicates(documents(rows), percent=percent).collect(), percent)


def test_chain(documents):
    """Each text is near the next only: one component, by the smallest id."""
    rows, base = [], [f"w{i}" for i in range(100)]
    for k in range(30):
        rows.append((1000 - k, " ".join(base)))
        base = base[3:] + [f"n{k}_{i}" for i in range(3)]
    found = neardup.near_duplicates(documents(rows)).collect()
    check(rows, found)
    assert len({r["component_id"] for r in found}) == 1


def test_crowded_band_in_blocks(documents, monkeypatch):
    """Members of one band value that a pivot does not link are compared block by block."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rnd = random.Random(8)
    rows = family(rnd, 60, 200, 9, 0) + family(rnd, 40, 120, 3, 100)
    check(rows, neardup.near_duplicates(documents(rows)).collect())


def test_stop_counts_are_bounds():
    stops = neardup.stop_counts(0.85, 1e-6)
    assert stops[-1][0] == neardup.ROWS * neardup.BANDS
    assert all(m <= 0.85 * n for n, m in stops) and stops[-1][1] > 0.6 * stops[-1][0]


def test_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    check(rows, neardup.op7_near_duplicates(spark, SMALL).collect())


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_pairs_at_the_threshold_share_a_band(percent):
    """20,000 pairs of sets of just that similarity: with 44 bands some pairs of 80 % share none."""
    bands = neardup.bands_for(percent / 100)
    assert (1 - (percent / 100) ** neardup.ROWS) ** bands <= neardup.MISS
    rnd = np.random.default_rng(5)
    missed, both, own = 0, percent, (100 - percent) // 2
    for _ in range(20):
        common, mine = rnd.integers(0, 1 << 64, (1000, both), np.uint64), rnd.integers(0, 1 << 64, (2, 1000, own), np.uint64)
        keys = [neardup.band_keys(neardup.signatures(np.hstack([common, x]).ravel(), np.arange(1001) * (both + own), bands)) for x in mine]
        missed += int((~(keys[0] == keys[1]).any(1)).sum())
    # odd percentages leave a set of 99 values in all, so a little above the threshold
    assert missed == 0
