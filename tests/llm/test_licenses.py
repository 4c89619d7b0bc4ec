import random
from math import exp

from marquee.llm import licenses
from tests.conftest import SMALL


def others(n=300):
    rnd = random.Random(6)
    vocabulary = "the of and market river under version public work free house city charge light permitted source long day rights people".split() + [f"noun{i}" for i in range(200)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 40))) for _ in range(n)]


MODEL = None


def model():
    global MODEL
    MODEL = MODEL or licenses.train([licenses.grams(licenses._words(x)) for x in others()])
    return MODEL


def brute(text, model):
    """(families, paragraphs, unknown) of a text: every paragraph is scored, in plain Python."""
    weight, bias, temperature, _ = model
    families, n, unknown = set(), 0, 0
    for line in (text or "").split("\n"):
        w = licenses._words(line)
        scores = [b + sum(weight[g][c] for g in licenses.grams(w) if g in weight) for c, b in enumerate(bias)]
        raised = [exp((x - max(scores)) / temperature) for x in scores]
        k = max(range(len(bias)), key=lambda c: (raised[c], -c))
        if k == 0:
            continue
        p, family, own = raised[k] / sum(raised), licenses.FAMILIES[k - 1], set(w)
        like = max(len(own & set(t)) / min(len(own), len(set(t))) for t in map(licenses._words, licenses.TEMPLATES[family])) if own else 0
        if p >= licenses.SURE or like >= licenses.LIKE:
            n += 1
            if p >= licenses.SURE and like >= licenses.LIKE and len(own) >= 3:
                families.add(family)
            else:
                unknown += 1
    return sorted(families), n, unknown


def same(found, rows, model):
    for r in found:
        assert (r["families"], r["n_paragraphs"], r["n_unknown"]) == brute(dict(rows)[r["doc_id"]], model), dict(rows)[r["doc_id"]]


def test_brute_force(documents):
    """Paragraphs of licence words in any mixture: also those that never reach the model must come out as it says."""
    rnd = random.Random(17)
    known = [w for w in {w for g in licenses.KNOWN for w in g.split()}]
    texts = [t for of in (*licenses.TEMPLATES.values(), *licenses.HELD.values(), licenses.ORDINARY) for t in of]
    rows = []
    for i in range(300):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            w = licenses._words(rnd.choice(texts)) if rnd.random() < 0.6 else rnd.choices(known, k=rnd.randint(1, 25))
            lines.append(" ".join(x if rnd.random() < 0.85 else rnd.choice(known + ["zebra"]) for x in w).title())
        rows.append((i, "\n".join(lines)))
    same(licenses.scan(documents(rows), model()).collect(), rows, model())


def test_table_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    fitted = licenses.train(licenses.sample_paragraphs(docs))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    same(licenses.scan(docs, fitted).collect(), rows, fitted)
    stated = {"MIT License": "mit", "Apache License": "apache", "GNU General": "gpl", "CC BY-NC": "cc-by-nc", "rights reserved": "proprietary"}
    for r in licenses.scan(docs, fitted).collect():
        text = dict(rows)[r["doc_id"]] or ""
        assert r["families"] == sorted(f for x, f in stated.items() if x in text)


def test_words_that_do_not_tell_never_make_a_family():
    """The bound behind the filter: the strongest paragraphs made of other words alone stay in class none."""
    weight, bias, _, telling = model()
    assert 1 <= len(telling) <= 1 + licenses.MORE_SETS
    for words in telling:
        rest = {w for g in weight for w in g.split()} - set(words)
        assert rest and words
        for c in range(1, len(bias)):
            most = sum(max(0.0, v[c] - v[0]) for g, v in weight.items() if rest.issuperset(g.split()))
            assert most < bias[0] - bias[c]


def test_statements_in_other_words(documents):
    """Held-out wording is recognised or left open, and ordinary sentences are no licence."""
    rows = [(i, t) for i, (k, t) in enumerate((k, t) for k, of in licenses.HELD.items() for t in of)]
    kinds = [k for k, of in licenses.HELD.items() for _ in of]
    found = {r["doc_id"]: r["families"] for r in licenses.scan(documents(rows), model()).collect()}
    stated = [i for i, k in enumerate(kinds) if k != licenses.NONE]
    assert not any(found[i] for i, k in enumerate(kinds) if k == licenses.NONE)
    assert sum(found[i] == [kinds[i]] for i in stated) >= 0.6 * len(stated) and sum(bool(set(found[i]) - {kinds[i]}) for i in stated) <= 1


def test_wrapped_licence_text(documents):
    """A licence text in lines of ten words is found whole."""
    w = " ".join(licenses.TEMPLATES["mit"][3:]).split()
    rows = [(1, "\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10)))]
    (r,) = licenses.scan(documents(rows), model()).collect()
    assert "mit" in r["families"] and r["n_paragraphs"] - r["n_unknown"] >= 6


def test_statements_and_prose(documents):
    rows = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0 (the License).\nMore text of a day in the city."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Released under the MIT License.\n\nLicensed under CC BY-NC 4.0."),
        (4, "Copyright 2021 Acme. All rights reserved."),
        (5, "\n".join(others(50))),
        (6, "The people of the city have a permit to work; rights of the river are long."),
        (7, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ]
    found = {r["doc_id"]: r for r in licenses.scan(documents(rows), model()).collect()}
    want = {1: ["apache"], 2: ["gpl"], 3: ["cc-by-nc", "mit"], 4: ["proprietary"], 5: [], 6: [], 7: ["bsd"]}
    assert {i: r["families"] for i, r in found.items()} == want


def test_held_out_variants(documents):
    """Templates with single words dropped or with words around them, which training has not seen."""
    rnd = random.Random(12)
    rows, want = [], {}
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            w = text.split()
            for _ in range(4):
                cut = rnd.randrange(len(w))
                variant = ["notice:"] + [x for j, x in enumerate(w) if j != cut or len(w) < 5]
                want[len(rows)] = family
                rows.append((len(rows), " ".join(variant).title()))
    found = licenses.scan(documents(rows), model()).collect()
    right = sum(r["families"] == [want[r["doc_id"]]] for r in found)
    wrong = sum(bool(set(r["families"]) - {want[r["doc_id"]]}) for r in found)
    assert right >= 0.85 * len(rows) and wrong <= 0.05 * len(rows)


def test_unknown_class(documents):
    """What speaks of licences but is like no template gets no family."""
    rows = [(1, "the permission of a license may be granted by the house under a public charge of this software for people")]
    (r,) = licenses.scan(documents(rows), model()).collect()
    assert r["families"] == []


def test_odd_rows(documents, odd_rows):
    found = licenses.scan(documents(odd_rows), model()).collect()
    assert len(found) == len(odd_rows) and all(r["families"] == [] and r["n_paragraphs"] == 0 for r in found)
    assert licenses.scan(documents([]), model()).collect() == []
    assert licenses.scan(documents([])).collect() == []
    twice = [(1, "Released under the MIT license")] * 2 + [(None, "Released under the MIT license")]
    assert [r["families"] for r in licenses.scan(documents(twice), model()).collect()] == [["mit"]] * 3
