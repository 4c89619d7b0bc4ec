"""Op 3, mixing sources to target weights.

Temperature mixing: a source's weight is its share of all tokens to the power t, made to sum to 1.  t is bisected so
that the weights meet a target: an entropy, or a limit on how often the most repeated source may be seen when the
largest source is seen once.  The weights are then realised within a token budget: each source is cut into blocks of
about BLOCK documents by a hash, and each block's documents, in keyed order, are taken over and over until the block's
part of the budget is used up; the document that the end of it falls into is taken with the chance that the budget left
is of its length, so weights are met on average however long documents are.  No sort or running sum ever spans more than
a block, so a source with a third of all rows is as many tasks as its size asks for.

A budget of None is the least one in which every document is seen at least once.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, Scratch, table, whole_row

BLOCK = 1000
REPEATS = 2.0
STEPS = 60
#: Exponents looked at in one pass over the sources, and passes, for an entropy.
GRID, PASSES = 32, 6
SEED = "mix-1"


def repeats_exponent(least: float, most: float, repeats: float) -> float:
    """The least t in 0..1 with which a source of ``least`` tokens is seen at most ``repeats`` times as often as one of ``most``."""
    lo, hi = 0.0, 1.0
    if (most / least) ** (1 - lo) <= repeats:
        return lo
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (most / least) ** (1 - mid) > repeats else (lo, mid)
    return hi


def entropy_exponent(sums: DataFrame, total: float, entropy: float) -> float:
    """The t in 0..1 whose weights have the entropy (nats); a target out of reach gives the nearer end.

    Entropy falls as t grows.  Each pass cuts the interval into GRID + 1 parts by sums over the sources, so that no list
    of sources is brought to the driver.
    """
    lo, hi = 0.0, 1.0
    share = F.col("n") / F.lit(total)
    for k in range(PASSES):
        step = (hi - lo) / (GRID + 1)
        at = [lo + step * i for i in range(0 if k == 0 else 1, GRID + (2 if k == 0 else 1))]
        row = sums.agg(*[x for i, t in enumerate(at) for x in (F.sum(F.pow(share, F.lit(t))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(t)) * F.log(share) * t).alias(f"e{i}"))]).first()
        of = [float(log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"]) for i in range(len(at))]
        above = [t for t, h in zip(at, of) if h > entropy]
        if k == 0 and not above:
            return 0.0
        if k == 0 and len(above) == len(at):
            return 1.0
        lo, hi = max([lo, *above]), min([hi, *(t for t, h in zip(at, of) if h <= entropy)])
    return hi


def token_count(text: Column) -> Column:
    """Words of a text; a text without words (or null) counts as one token, so that it has a place in the mix."""
    return F.greatest(F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")), F.lit(1)).cast("bigint")


def plan(sums: DataFrame, budget: int | None, repeats: float | None, entropy: float | None, block: int) -> DataFrame:
    """source, epochs (how often its documents are drawn on average) and blocks, from source, n (tokens, above 0) and rows."""
    seen = sums.agg(F.count(F.lit(1)).alias("sources"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total")).first()
    total = float(seen["total"] or 1)
    if seen["sources"] < 2:
        t = 1.0
    elif entropy is not None:
        t = entropy_exponent(sums, total, entropy)
    else:
        t = repeats_exponent(seen["least"], seen["most"], repeats)
    # a source is seen in proportion to its tokens to the power t - 1; without a budget the largest, seen least, is seen once
    rate = F.pow(F.col("n") / F.lit(float(seen["most"] or 1)), F.lit(t - 1))
    if budget is not None:
        rate = rate * budget / F.lit(sums.agg(F.sum(F.col("n") * rate).alias("x")).first()["x"])
    return sums.select("source", rate.alias("epochs"), F.greatest(F.ceil(F.col("rows") / block), F.lit(1)).cast("int").alias("blocks"))


def mix(docs: DataFrame, budget: int | None = None, repeats: float | None = REPEATS, entropy: float | None = None, block: int = BLOCK, seed: str = SEED, carry: bool = False) -> DataFrame:
    """doc_id, source, n_tokens, block, place and epoch of every document drawn: a row for each time it is drawn; with ``carry`` also row, the whole row of ``docs``.

    ``docs`` are doc_id, text and source; other columns are not read but for ``carry``.  A null source is the source ''.
    Null and blank texts count one token.  Rows that repeat a doc_id are drawn each; null doc_ids are drawn like any
    other.  An empty table gives no row.
    """
    counted = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("n_tokens"), *([whole_row(docs).alias("row")] if carry else []))
    with Scratch(docs.sparkSession) as scratch:
        if not carry:
            counted = scratch.save(counted, "counted", keep=True)
        sums = scratch.save(counted.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("n"), F.count(F.lit(1)).alias("rows")), "sums")
        # written, so that Spark knows its size: small plans are broadcast, others joined by source, where Spark splits hot ones
        planned = scratch.save(plan(sums, budget, repeats, entropy, block), "plan", keep=True)
    # the length is part of what is hashed, so that rows that share an id, or have none, spread over blocks too
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("n_tokens").cast("string")))
    number = lambda start: F.conv(F.substring("order", start, 8), 16, 10).cast("bigint")
    placed = counted.join(planned, "source").withColumn("order", hashed)
    placed = placed.withColumn("block", F.pmod(number(1), F.col("blocks")).cast("int"))
    by = W.partitionBy("source", "block")
    running = by.orderBy("order", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.select("*", F.row_number().over(by.orderBy("order", "doc_id", "n_tokens")).alias("place"), F.sum("n_tokens").over(running).alias("upto"), F.sum("n_tokens").over(by).alias("of_block"))
    # whole epochs, and one more for the documents that the rest of the block's budget reaches
    whole = F.floor(F.col("epochs") + 1e-9)
    rest = (F.col("epochs") - whole) * F.col("of_block")
    left = rest - (F.col("upto") - F.col("n_tokens"))
    crossing = (left > 1e-6) & (number(9) * F.col("n_tokens") < left * float(1 << 32))
    times = (whole + F.when((F.col("upto") <= rest + 1e-6) | crossing, 1).otherwise(0)).cast("int")
    drawn = summed.withColumn("times", times).filter("times > 0")
    return drawn.select("doc_id", "source", "n_tokens", "block", "place", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch"), *(["row"] if carry else []))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: With the default target the bisection ends where the ratio of the largest to the smallest source, to the power
#: 1 - t, is the limit on repeats; SQL has that exponent directly.
ORACLE_SQL = f"""
WITH counted AS (
  SELECT doc_id, coalesce(source, '') AS source,
         greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 1)::BIGINT AS n_tokens
  FROM documents),
sums AS (SELECT source, sum(n_tokens)::DOUBLE AS n, greatest(1, ceil(count(*) / {BLOCK}.0))::INT AS blocks FROM counted GROUP BY source),
power AS (SELECT CASE WHEN count(*) < 2 THEN 1.0 WHEN max(n) / min(n) <= {REPEATS} THEN 0.0
                 ELSE 1 - ln({REPEATS}) / ln(max(n) / min(n)) END AS t FROM sums),
plan AS (SELECT source, blocks, pow(n / (SELECT max(n) FROM sums), t - 1) AS epochs FROM sums, power),
placed AS (
  SELECT c.*, p.epochs, md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || n_tokens) AS h, p.blocks FROM counted c JOIN plan p USING (source)),
blocked AS (SELECT *, (('0x' || h[1:8])::BIGINT % blocks)::INT AS block FROM placed),
summed AS (
  SELECT *, row_number() OVER (PARTITION BY source, block ORDER BY h, doc_id, n_tokens)::INT AS place,
         sum(n_tokens) OVER (PARTITION BY source, block ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
         sum(n_tokens) OVER (PARTITION BY source, block)::BIGINT AS of_block
  FROM blocked)
SELECT doc_id, source, n_tokens, block, place,
       unnest(range(1, 1 + (floor(epochs + 1e-9) + CASE WHEN upto <= rest + 1e-6 THEN 1 WHEN rest - (upto - n_tokens) > 1e-6
         AND ('0x' || h[9:16])::BIGINT * n_tokens < (rest - (upto - n_tokens)) * 4294967296.0 THEN 1 ELSE 0 END)::INT))::INT AS epoch
FROM (SELECT *, (epochs - floor(epochs + 1e-9)) * of_block AS rest FROM summed)
"""
