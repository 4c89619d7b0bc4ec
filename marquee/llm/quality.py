"""Op 1, quality rules as weak supervision (DataFrame functions only).

Rules look at counts of a text and vote good, bad, or abstain.  How often each rule is right, and how common good
texts are, is estimated without labels, by expectation-maximisation over the table of vote patterns, of which there
are at most 3 ** rules however many documents there are.  Every pattern then has a posterior probability of being
good, which a small table carries back to the documents.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table, whole_row

SYMBOLS = "[#*$%&|<>]"
RULES = ("length", "word_length", "symbols", "lines", "repetition", "capitals", "shouting", "variety")
ROUNDS = 200
FALSE_ALARM, SEEN = 0.003, (0.1, 0.6)


def base_counts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and counts of each row's text; all 0 for null, empty and blank texts.  With ``carry``, row is the whole row of ``docs``."""
    spaces = f"[{SPACE}]+"
    text = F.coalesce("text", F.lit(""))
    row = [whole_row(docs).alias("row")] if carry else []
    also = ["row"] if carry else []
    step = docs.select("doc_id", text.alias("text"), F.split(text, spaces).alias("w"), F.split(text, "\n").alias("l"), *row)
    # split leaves an empty first (last) word where the text starts (ends) with white space
    step = step.select("doc_id", "text", *also, F.filter("w", lambda x: x != "").alias("w"), F.filter("l", lambda x: x.rlike(f"[^{SPACE}]")).alias("l"))
    step = step.select(
        "doc_id",
        *also,
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "\\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        (F.length("text") - F.length(F.replace("text", F.lit("!")))).cast("long").alias("n_shouts"),
        F.size(F.array_distinct("w")).cast("long").alias("n_different"),
    )
    three = F.when(
        F.col("n_words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
    )
    step = step.select(*[c for c in step.columns if c != "w"], three.alias("h"))
    # only texts in which some window occurs again are sorted
    ranked = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.select(*[c for c in step.columns if c != "h"], ranked.alias("r"))
    same = lambda i, j: F.get("r", i)["h"] == F.get("r", j)["h"]
    again = F.filter(F.sequence(F.lit(0), F.size("r") - 1), lambda i: (F.coalesce(same(i, i - 1), F.lit(False))) | (F.coalesce(same(i, i + 1), F.lit(False))))
    at = F.when(F.col("r").isNotNull(), F.array_sort(F.transform(again, lambda i: F.get("r", i)["i"])))
    step = step.select(*[c for c in step.columns if c != "r"], at.alias("at"))
    # each start adds the words up to the next one, three at most
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return step.select(*[c for c in step.columns if c != "at"], F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote on a row of ``base_counts``: 1 good, -1 bad, 0 abstains."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    vote = lambda bad, good=F.lit(False): F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": vote(F.col("n_words") < 5, F.col("n_words") >= 60),
        "word_length": vote((F.col("word_chars") > 12 * n) | (F.col("word_chars") < 2.5 * n), F.col("word_chars").between(3.5 * n, 9 * n)),
        "symbols": vote(F.col("n_symbols") > 0.3 * n),
        "lines": vote(F.col("n_dup_lines") > 0.3 * lines),
        "repetition": vote(F.col("n_repeat_words") > 0.5 * n),
        "capitals": vote(F.col("n_capitals") > 0.3 * F.col("word_chars")),
        "shouting": vote(F.col("n_shouts") > 0.3 * n),
        "variety": vote(F.col("n_different") < 0.15 * n),
    }


def fit(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[dict], dict[tuple[int, ...], float]]:
    """(share of good, vote probabilities of each rule, posterior of each pattern) from the counts of vote patterns.

    For each rule and each kind of text the chances of its three votes are estimated, abstention being one of them.
    The first guess takes a text as good unless some rule votes bad.  Two bounds, which are what is known of the rules
    beforehand, keep the kinds apart where bad texts come in several sorts, each known to one rule: a rule votes bad on
    at most FALSE_ALARM of good texts, and on SEEN[0] to SEEN[1] of bad ones.  Within them everything is estimated.
    (Without them a rule that finds a sort of its own is taken for one that is wrong on good texts.)
    """
    if not patterns:
        return 0.5, [], {}
    m, total = len(next(iter(patterns))), sum(patterns.values())
    post = {p: 0.1 if min(p) < 0 else 0.9 for p in patterns}
    was = None
    for _ in range(rounds):
        good = min(0.99, max(0.01, sum(post[p] * n for p, n in patterns.items()) / total))
        chance = []
        for j in range(m):
            of = {}
            for y in (1, -1):
                n = {v: 0.5 for v in (-1, 0, 1)}
                for p, k in patterns.items():
                    n[p[j]] += k * (post[p] if y > 0 else 1 - post[p])
                bad = n[-1] / sum(n.values())
                bad = min(FALSE_ALARM, bad) if y > 0 else min(SEEN[1], max(SEEN[0], bad))
                of[y, -1] = bad
                for v in (0, 1):
                    of[y, v] = (1 - bad) * n[v] / (n[0] + n[1])
            chance.append(of)
        for p in patterns:
            odds = log(good / (1 - good)) + sum(log(of[1, v] / of[-1, v]) for v, of in zip(p, chance))
            post[p] = 1 / (1 + exp(-max(-500, min(500, odds))))
        now = [x for of in chance for x in of.values()]
        if was and max(abs(x - y) for x, y in zip(was, now)) < 1e-9:
            break
        was = now
    return good, chance, post


def quality(docs: DataFrame, threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """doc_id, counts, votes, base_failed, posterior and kept for each row of ``docs`` (doc_id, text); with ``carry`` also row, the whole row.

    Null, empty and blank texts have no words and so fail the base rules.  Repeated rows and null doc_ids are
    judged like any other; other columns are not read.  An empty table gives no row.
    """
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.save(base_counts(docs if carry else docs.select("doc_id", "text"), carry), "counts", keep=True)
    vote = votes()
    voted = counts.select("*", F.array(*[vote[r].cast("int") for r in RULES]).alias("votes"))
    seen = voted.groupBy("votes").count().collect()  # 3 ** len(RULES) rows at most
    _, _, post = fit({tuple(r["votes"]): r["count"] for r in seen})
    spark = docs.sparkSession
    table_of = spark.createDataFrame([(list(p), x) for p, x in post.items()], "votes array<int>, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.join(F.broadcast(table_of), "votes", "left").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts behind the base rules and the votes, without the method."""
    return base_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words
FROM w LEFT JOIN covered USING (r)
"""
