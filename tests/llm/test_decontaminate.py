import random

import duckdb
from brute import LOWER, words

from marquee.llm import decontaminate as D
from tests.conftest import SMALL


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "'x' AS hash", "1 AS place")


def exact_overlap(text, item, least=12):
    """Longest run of equal words of a text and an item, by words in lower case."""
    a, b = words((text or "").translate(LOWER)), words((item or "").translate(LOWER))
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def prose(rnd, n):
    return [f"{rnd.choice('bcdfgm')}{rnd.choice('aeiou')}{rnd.randrange(400)}" for _ in range(n)]


def test_planted_passages(documents, spark):
    rnd = random.Random(2)
    items = [(i, " ".join(prose(rnd, 40))) for i in range(20)] + [(50, "a short item of six words"), (51, "too short here"), (52, ""), (53, None)]
    rows, leaked = [], set()
    for k in range(200):
        text = prose(rnd, 300)
        if k % 4 == 0:  # whole items, every so many words substituted
            item = items[k % 20][1].split()
            every = (0, 9, 6)[k // 4 % 3]
            for j in range(every, len(item), every) if every else ():
                item[j] = f"other{j}"
            text[100:100] = item
            leaked.add(k)
        elif k % 4 == 1:  # a part of an item
            text[50:50] = items[k % 20][1].split()[5:25]
            leaked.add(k)
        elif k == 2:
            text[7:7] = "A SHORT Item of six words".split()
            leaked.add(k)
        rows.append((k, " ".join(text)))
    found = {r["doc_id"]: r for r in D.contaminated(documents(rows), items_of(spark, items)).collect()}
    assert {i for i, r in found.items() if not r["kept"]} == leaked
    assert all(k % 20 in found[k]["item_ids"] for k in leaked if k != 2) and found[2]["item_ids"] == [50]


def test_positions(documents, spark):
    rnd = random.Random(4)
    item = prose(rnd, 30)
    text = prose(rnd, 2000)
    text[1500:1500] = item
    (r,) = D.overlaps(documents([(1, " ".join(text))]), items_of(spark, [(7, " ".join(item))])).collect()
    assert (r["doc_id"], r["item_id"], r["start"], r["end"], r["equal"]) == (1, 7, 1500, 1530, 30)


def brute(rows, items, shortest=5):
    """{row number: {item_id: equal}}: every place at which some mask of an item fits is laid out word by word, all in plain Python."""
    tokens = lambda t: words((t or "").translate(LOWER))
    out = {}
    for n, (_, text) in enumerate(rows):
        w = tokens(text)
        for item_id, item in items:
            v, best = tokens(item), 0
            masks = D.MASKS + (("1" * 8,) if len(v) == 9 else ()) if len(v) >= 9 else ("1" * len(v),) * (len(v) >= shortest)
            shifts = set()
            for mask in masks:
                kept = [i for i, c in enumerate(mask) if c == "1"]
                seen = {}
                for j in range(len(v) - len(mask) + 1):
                    seen.setdefault(tuple(v[j + i] for i in kept), []).append(j)
                for k in range(len(w) - len(mask) + 1):
                    shifts.update(k - j for j in seen.get(tuple(w[k + i] for i in kept), ()))
            for d in shifts:
                same = [w[k] == v[k - d] for k in range(max(0, d), min(len(w), d + len(v)))]
                sums = [0]
                for x in same:
                    sums.append(sums[-1] + x)
                best = max([best, *(sums[b] - sums[a] for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 10 * (sums[b] - sums[a]) >= 7 * (b - a))])
            least = len(v) if len(v) < 9 else min(12, -(-7 * len(v) // 10))
            if v and best >= least and len(v) >= shortest:
                out.setdefault(n, {})[item_id] = best
    return out


def test_brute_force(documents, spark):
    """Copies with substitutions, insertions, repeats and cuts, chance hits, items of all lengths, rows that share or lack an id."""
    rnd = random.Random(12)
    few = [f"w{i}" for i in range(60)]  # few words, so that seeds hit by chance
    items = [(i, " ".join(rnd.choices(few, k=n))) for i, n in enumerate([3, 5, 6, 8, 9, 9, 10, 12, 15, 20, 30, 45, 60])]
    items += [(90, " ".join(few[k % 4] for k in range(20))), (91, None), (92, "")]
    rows = []
    for k in range(150):
        text = rnd.choices(few, k=rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            item = (items[rnd.randrange(14)][1] or "").split()
            for j in range(len(item)):
                if rnd.random() < rnd.choice((0, 0.1, 0.25)):
                    item[j] = rnd.choice(few)
            if rnd.random() < 0.3:
                item.insert(rnd.randrange(len(item)), "more")
            at = rnd.randint(0, len(text))
            text[at:at] = item[rnd.randint(0, 3) :]
        rows.append((rnd.choice((k, k, 5, None)), " ".join(text).replace("w1 ", "W1\t")))
    rows += [(500, " ".join(few[k % 4] for k in range(300))), (501, None), (502, "")]
    want = brute(rows, items)
    found = D.overlaps(documents(rows), items_of(spark, items))
    got = {(r["doc_id"], r["row"], r["item_id"], r["equal"]) for r in found.collect()}
    keys = spark.createDataFrame(rows, "doc_id bigint, text string").select(D.row_key()).collect()
    assert got == {(rows[n][0], keys[n][0], i, equal) for n, of in want.items() for i, equal in of.items()} and len(got) > 50


def test_long_overlap_is_whole(documents, spark):
    """An item of 3,000 words with a gap of 200 substituted ones counts as one overlap; shorter items on request."""
    rnd = random.Random(3)
    item = prose(rnd, 3000)
    text = [*prose(rnd, 40), *item[:1500], *(f"other{j}" for j in range(200)), *item[1700:], *prose(rnd, 40)]
    (r,) = D.contaminated(documents([(1, " ".join(text))]), items_of(spark, [(7, " ".join(item))])).collect()
    assert (r["item_ids"], r["n_equal"]) == ([7], 2800)
    found = lambda n: [r["kept"] for r in D.contaminated(documents([(1, "one two three")]), items_of(spark, [(7, "two three")]), shortest=n).collect()]
    assert found(5) == [True] and found(2) == [False]


def test_odd_rows(documents, odd_rows, spark):
    items = items_of(spark, [(1, "one two three four five six"), (2, "b c d e f g"), (None, None), (3, "")])
    found = D.contaminated(documents(odd_rows), items).collect()
    assert len(found) == len(odd_rows)
    # each row is judged by its own text, whether it shares an id or has none
    assert sorted((r["doc_id"] or 0, r["item_ids"]) for r in found if not r["kept"]) == [(0, [1]), (7, [2]), (7, [2])]
    assert D.contaminated(documents([]), items).collect() == []
    assert all(r["kept"] for r in D.contaminated(documents(odd_rows), items_of(spark, [])).collect())


def test_documents(spark):
    """Exact runs of 13 words or more are all found, and texts without any run of four words stay."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' WHERE length(text) < 6000").fetchall()
    items = duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()
    kept = {r["doc_id"]: r["kept"] for r in D.op8_decontamination(spark, SMALL).collect()}
    grams = {tuple(w[i : i + 4]) for (t,) in items for w in [words((t or "").translate(LOWER))] for i in range(len(w) - 3)}
    for i, text in docs:
        w = words((text or "").translate(LOWER))
        if not any(tuple(w[k : k + 4]) in grams for k in range(len(w) - 3)):
            assert kept[i], i
        elif max(exact_overlap(text, t) for (t,) in items) >= 13:
            assert not kept[i], i


def test_more_copied_text_never_makes_a_document_clean(documents, spark):
    """Dense parts on both sides of a gap count alone, whatever the gap."""
    rnd = random.Random(6)
    sides = [(15, 15, gap) for gap in range(0, 30)] + [(20, 21, 19), (12, 40, 30), (40, 12, 25)]
    items, rows = [], []
    for k, (a, b, gap) in enumerate(sides):
        item = prose(rnd, a + gap + b)
        items.append((k, " ".join(item)))
        rows.append((k, " ".join([*prose(rnd, 100), *item[:a], *(f"other{j}" for j in range(gap)), *item[a + gap :], *prose(rnd, 100)])))
    found = {r["doc_id"]: r for r in D.contaminated(documents(rows), items_of(spark, items)).collect()}
    assert {i: r["item_ids"] for i, r in found.items()} == {i: [i] for i, _ in rows}
    assert all(found[k]["n_equal"] >= max(a, b) for k, (a, b, _) in enumerate(sides))


def test_short_items_with_any_one_substitution(documents, spark):
    rnd = random.Random(8)
    items, rows, few = [], [], []
    for n in range(9, 18):
        item = prose(rnd, n)
        items.append((n, " ".join(item)))
        for j in range(n):
            rows.append((100 * n + j, " ".join([*prose(rnd, 50), *item[:j], "other", *item[j + 1 :], *prose(rnd, 50)])))
        # under the share: the item's middle alone
        few.append((100 * n + 99, " ".join([*prose(rnd, 50), *item[1 : min(12, -(-7 * n // 10))], *prose(rnd, 50)])))
    found = {r["doc_id"]: r["item_ids"] for r in D.contaminated(documents(rows + few), items_of(spark, items)).collect()}
    assert found == {i: [i // 100] for i, _ in rows} | {i: [] for i, _ in few}


def test_longest_overlap():
    import numpy as np

    for seed in range(300):
        rnd = np.random.default_rng(seed)
        same = rnd.random(rnd.integers(1, 40)) < (0.6 if seed % 2 else 0.75)
        start, end, equal = D.longest_overlap(same)
        n = len(same)
        best = max(int(same[a:b].sum()) for a in range(n + 1) for b in range(a, n + 1) if 10 * same[a:b].sum() >= 7 * (b - a))
        assert equal == best == same[start:end].sum() and 10 * equal >= 7 * (end - start)
        assert not equal or (same[start] and same[end - 1])
