"""Op 10, licence scan (DataFrame functions on all data): trained paragraph classifier with template comparison.

Paragraphs (lines with a word) are classified into licence families, or none, by multinomial logistic regression over
word unigrams and bigrams.  The model is trained on the templates below, whole, in pieces as long as a wrapped line and
with words left out; on ordinary sentences that use words of licences; and on paragraphs of a bounded sample of
documents, chosen by a hash alone.  Those are unlabelled, so a second fit leaves out the ones that the first takes for
a licence.  A temperature is fitted on statements worded otherwise than any template, so that probabilities are
calibrated; below SURE a paragraph is 'unknown'.  A prediction counts only if the paragraph also shares enough of its
words with a template of that family.

Most paragraphs are never scored: the weights give sets of words from which alone, however many of them and in whatever
order, no family is lifted above none.  A paragraph is scored only if it has a telling word, one outside, for each set.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, sampled, table

#: Fixed wording: how licence texts and notices state each family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed.",
        "Released under the BSD license",
        "Licensed under the 3-clause BSD license",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "Creative Commons Attribution-ShareAlike License",
        "You must give appropriate credit, provide a link to the license, and indicate if changes were made.",
        "You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform, and build upon the material for any purpose, even commercially.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC-SA 4.0",
        "NonCommercial: you may not use the material for commercial purposes.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU Lesser General Public License version 2.1",
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License version 2.0",
    ),
    "proprietary": (
        "All rights reserved",
        "Copyright, all rights reserved",
        "All rights reserved. No part of this publication may be reproduced without permission",
        "No part of this publication may be stored in a retrieval system or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Confidential and proprietary, do not distribute",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
FAMILIES = tuple(TEMPLATES)
NONE = "none"
#: Ordinary sentences with words of licences: class none.
ORDINARY = (
    "You need a license to drive a car in this country", "Admission is free of charge for children under five", "The general public is invited to the meeting", "Version 2.0 of the application was released in May",
    "Permission to build was granted by the city", "The software is used by many people", "The rights of workers are protected by law", "A copy of the report is available at the office",
    "Copyright law protects the authors of a work", "The terms of the contract were agreed in writing", "The code is compiled to binary form", "The conditions were difficult and the notice came late",
    "She has the right to appeal without restriction", "The foundation published the program of the festival", "No warranty was given with the machine", "The document was signed by the following persons",
    "He studied at MIT and works as a contributor to a newspaper", "The material may be used for many purposes", "The house is reserved for guests", "This list of names is public", "The license of the house was lost in a fire",
    "Free software was the subject of the talk", "A link to the source is at the end of the page", "In any event the work is done", "The source of the river lies in the mountains",
)
#: Statements and sentences in other words, from which nothing is trained but the temperature.
HELD = {
    "apache": ("This project is available under version 2.0 of the Apache License", "Distributed under the Apache License 2.0, see the file LICENSE", "The library is Apache License 2.0 licensed"),
    "bsd": ("This package is distributed under the terms of the BSD license", "Available under a BSD license with three clauses", "BSD licensed: source and binary forms may be redistributed under the conditions below"),
    "cc-by": ("Text is available under the Creative Commons Attribution 4.0 licence", "Photographs are published under CC BY 4.0", "Creative Commons Attribution 4.0 applies to all pages"),
    "cc-by-nc": ("Shared under Creative Commons Attribution NonCommercial 4.0", "Lessons are CC BY-NC 4.0", "Available under a CC BY-NC-SA licence"),
    "gpl": ("This package may be redistributed under the terms of the GNU General Public License", "Covered by the GNU General Public License version 2", "Free software under the GNU GPL: see the GNU General Public License"),
    "mit": ("This project is licensed under the terms of the MIT license", "Distributed under the MIT License, see the file LICENSE", "Open source under the MIT license"),
    "mpl": ("The files are covered by the Mozilla Public License 2.0", "Available under the terms of the Mozilla Public License"),
    "proprietary": ("Copyright 2019 Example Corporation. All rights are reserved.", "All rights reserved by the publisher", "Confidential: copying is strictly prohibited"),
    NONE: ("The city council granted a fishing license to the club", "He obtained a copy of the film free of charge", "Version 3 of the program will be published next year", "The author gave up all his rights to the work", "Use of the hall is subject to conditions", "The public library is free", "She was given permission to copy the letters", "Their source was a file in the archive", "The material of the coat is reserved for winter", "This notice was distributed to the general public"),
}
SAMPLE_DOCUMENTS, SAMPLE_PARAGRAPHS = 60, 600
SURE, LIKE = 0.6, 0.6
STEPS, RATE, DECAY = 250, 0.5, 3e-4
#: Words of a piece of a template, about a line.
LINE = 12
#: What separates words here: all but letters, digits and the full stop of a number.
SPLIT = "[^a-z0-9.]+|\\.(?![0-9])|(?<![0-9])\\."


def _words(paragraph: str) -> list[str]:
    return [w for w in re.split(SPLIT, paragraph.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


def grams(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def _variants(text: str) -> list[list[str]]:
    """A template's words whole, in pieces of LINE words, and with each run of a fifth of them left out."""
    w = _words(text)
    cut = max(1, len(w) // 5)
    out = [w, w, w] + [w[i : i + LINE] for i in range(0, len(w) - 5, LINE // 2) if len(w) > LINE]
    return out + [w[:i] + w[i + cut :] for i in range(0, len(w), cut) if len(w) - cut >= 4]


def _training() -> list[tuple[int, list[str]]]:
    rows = [(k, v) for k, family in enumerate(FAMILIES, 1) for text in TEMPLATES[family] for v in _variants(text)]
    return rows + [(0, _words(x)) for x in ORDINARY for _ in range(4)]


#: N-grams that the model can have a weight for.
KNOWN = sorted({g for _, w in _training() for g in grams(w)})

#: Common words that do not fit into the first set and get one of their own.
MORE_SETS = 6

#: Weights of each n-gram by class, bias of each class, temperature, telling words for each set.
Model = tuple[dict[str, list[float]], list[float], float, list[list[str]]]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a multinomial logistic regression with an absolute penalty, by gradient descent with a step for each weight."""
    size = len(FAMILIES) + 1
    # equal rows are one row that counts as often
    both, n = np.unique(np.hstack([x, y[:, None]]).astype(np.float32), axis=0, return_counts=True)
    x, share = np.ascontiguousarray(both[:, :-1]), (n / n.sum()).astype(np.float32)[:, None]
    truth = np.eye(size, dtype=np.float32)[both[:, -1].astype(int)]
    w, b = np.zeros((x.shape[1], size), np.float32), np.zeros(size, np.float32)
    speed = np.full_like(w, 1e-8)
    for _ in range(STEPS):
        d = (_softmax(x @ w + b) - truth) * share
        step = x.T @ d
        speed += step * step
        w -= RATE * 0.1 * step / np.sqrt(speed)
        # sparse: weights that say little become 0
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * 0.1 * DECAY / np.sqrt(speed), 0)
        b -= RATE * d.sum(0)
    return w.astype(float), b.astype(float)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(rows: list[list[str]]) -> np.ndarray:
    place = {g: i for i, g in enumerate(KNOWN)}
    x = np.zeros((len(rows), len(KNOWN)))
    for i, r in enumerate(rows):
        x[i, [place[g] for g in r if g in place]] = 1
    return x


def train(others: list[list[str]]) -> Model:
    """The model; class 0 is NONE.  ``others`` are the n-grams, KNOWN ones at least, of unlabelled paragraphs."""
    rows = [(k, grams(w)) for k, w in _training()]
    x, y = _matrix([g for _, g in rows] + others), np.array([k for k, _ in rows] + [0] * len(others))
    w, b = _fit(x, y)
    # unlabelled paragraphs that the first fit takes for a licence are left out of the second
    keep = (np.arange(len(y)) < len(rows)) | (_softmax(x @ w + b)[:, 0] >= 0.5)
    w, b = _fit(x[keep], y[keep])
    names = (NONE, *FAMILIES)
    held = [(names.index(k), t) for k, texts in HELD.items() for t in texts]
    scores, truth = _matrix([grams(_words(t)) for _, t in held]) @ w + b, [k for k, _ in held]
    loss = lambda t: -np.log(np.maximum(1e-12, _softmax(scores / t)[np.arange(len(truth)), truth])).sum()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    seen = x[np.arange(len(y)) >= len(rows)].sum(0)
    return {g: v.tolist() for g, v in zip(KNOWN, w)}, b.tolist(), temperature, telling(w, b, seen)


def telling(w: np.ndarray, b: np.ndarray, seen: np.ndarray) -> list[list[str]]:
    """For each of some sets, all words of KNOWN outside it; from the words of a set alone no paragraph can get a family above none.

    A set takes in words as long as all n-grams made of its words, those that speak for a family counted in full, stay
    below what separates the family's bias from that of none: first those that are most common (``seen``, by n-gram) for
    what they add.  The most common words that are left out of the first set begin a set each.
    """
    gain = np.maximum(0.0, w[:, 1:] - w[:, :1])
    room = b[0] - b[1:]
    of: dict[str, list[int]] = {}
    for i, g in enumerate(KNOWN):
        for x in set(g.split(" ")):
            of.setdefault(x, []).append(i)
    how_often = {g: seen[i] for i, g in enumerate(KNOWN) if " " not in g}
    words = {i: set(KNOWN[i].split(" ")) for x in of for i in of[x]}

    def outside(first: str | None) -> list[str]:
        common, left, total = set(), set(of), np.zeros(len(room))
        while left:
            adds = {x: sum((gain[i] for i in of[x] if common.issuperset(words[i] - {x})), np.zeros(len(room))) for x in left}
            fit = [x for x in left if (total + adds[x] < room - 1e-6).all()]
            if not fit:
                break
            x = first if first in fit else max(fit, key=lambda x: ((how_often.get(x, 0) + 0.01) / (adds[x].max() + 0.01), x))
            total, first = total + adds[x], None
            common.add(x)
            left.remove(x)
        return sorted(set(of) - common)

    sets = [outside(None)]
    often = sorted((x for x in sets[0] if how_often.get(x, 0) > 0), key=lambda x: (-how_often[x], x))
    return sets + [outside(x) for x in often[:MORE_SETS]]


def sample_paragraphs(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, most: int = SAMPLE_PARAGRAPHS) -> list[list[str]]:
    """The KNOWN n-grams of up to ``most`` paragraphs, those of least hash, of up to ``documents`` whole documents."""
    lines = sampled(docs, documents).select(F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    some = lines.withColumn("o", F.xxhash64("line")).orderBy("o", "line").limit(most)
    known = F.array_intersect(_column_grams(_column_words(F.col("line"))), F.split(F.lit("|".join(KNOWN)), "\\|"))
    return [r["known"] for r in some.select(known.alias("known")).collect()]


def _column_grams(w: Column) -> Column:
    two = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, two))


def _column_words(paragraph: Column) -> Column:
    return F.filter(F.split(lower_ascii(paragraph), SPLIT), lambda w: w != "")


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row, paragraph (number from 0), family and probability of each paragraph that looks like a licence.

    ``docs`` are doc_id, row (a number; rows that share one are taken once) and text.  family is one of FAMILIES, or 'unknown' where some family
    is likelier than none but not by enough, or no template of it is like the paragraph.
    """
    weight, bias, temperature, telling = model
    size = len(bias)

    def told(w: Column) -> Column:
        """A paragraph without a telling word of some set stays in class none, and so does a text of such paragraphs."""
        out = F.lit(True)
        for words in telling:
            out = out & F.arrays_overlap(w, F.array(*map(F.lit, words)))
        return out

    text = F.coalesce("text", F.lit(""))
    hinted = docs.select("doc_id", "row", text.alias("text"), _column_words(text).alias("w")).filter(told(F.col("w"))).drop("w")
    lines = hinted.dropDuplicates(["row"]).select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    worded = lines.select("doc_id", "row", "paragraph", _column_words(F.col("line")).alias("w")).filter(told(F.col("w")))
    known = docs.sparkSession.createDataFrame([(g, w) for g, w in weight.items()], "gram string, weight array<double>")
    grams_ = worded.select("row", "paragraph", F.explode(_column_grams(F.col("w"))).alias("gram"))
    # one row a paragraph and n-gram that the model knows; their sums are taken before the shuffle
    scores = grams_.join(known, "gram").groupBy("row", "paragraph").agg(*[F.sum(F.get("weight", F.lit(c))).alias(f"s{c}") for c in range(size)])
    score = F.array(*[(F.col(f"s{c}") + bias[c]) / temperature for c in range(size)])
    raised = F.transform(score, lambda x: F.exp(x - F.array_max(score)))
    found = scores.withColumn("p", F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y)))
    found = found.select("row", "paragraph", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("k"), F.array_max("p").alias("probability")).filter("k > 0")
    # is it like a template of that family?
    texts = F.create_map(*[x for k, family in enumerate(FAMILIES, 1) for x in (F.lit(k), F.array(*[F.array(*map(F.lit, sorted(set(_words(t))))) for t in TEMPLATES[family]]))])
    joined = found.join(worded, ["row", "paragraph"]).withColumn("w", F.array_distinct("w"))
    # share of the smaller of both sets that the other has
    like = lambda t: F.size(F.array_intersect("w", t)) / F.least(F.size("w"), F.size(t))
    joined = joined.withColumn("like", F.array_max(F.transform(F.element_at(texts, F.col("k")), like)))
    sure = (F.col("probability") >= SURE) & (F.col("like") >= LIKE) & (F.size("w") >= 3)
    family = F.when(sure, F.get(F.array(*map(F.lit, FAMILIES)), F.col("k") - 1)).otherwise("unknown")
    return joined.filter((F.col("probability") >= SURE) | (F.col("like") >= LIKE)).select("doc_id", "row", "paragraph", family.alias("family"), "probability")


def scan(docs: DataFrame, model=None) -> DataFrame:
    """doc_id, families (sorted, without unknown ones), n_paragraphs (all that look like licences) and n_unknown, for each row of ``docs``.

    ``docs`` are doc_id and text; other columns are not read.  Null, empty and blank texts have none.  Repeated rows
    and null doc_ids are scanned each; an empty table gives no row.
    """
    model = model or train(sample_paragraphs(docs))
    # rows of equal id and text have equal results: they share a key and are classified once
    numbered = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = classify(numbered, model)
    sums = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(F.col("family") != "unknown", F.col("family")))).alias("families"),
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.count_if(F.col("family") == "unknown").alias("n_unknown"),
    )
    out = numbered.select("doc_id", "row").join(sums, "row", "left")
    return out.select("doc_id", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
