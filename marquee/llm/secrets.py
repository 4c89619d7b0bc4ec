"""Op 9, secret scan (DataFrame functions only): fixed patterns, and character Markov models for what they miss.

Two first-order Markov chains over characters, one of random strings and one of ordinary identifiers, are counted
from labelled samples.  A run of token characters is a secret when the log-likelihood ratio of the chains exceeds
a threshold, which is set where held-out ordinary strings exceed it as rarely as asked for.  Spans are in code points,
end exclusive.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled, table, words

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are taken whole, so the least length in the pattern drops the same ones as a look at the matches.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "model")
#: Characters of a candidate of the model, and the least length of one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
#: The share of held-out ordinary strings that may exceed the threshold, and the least threshold.
FALSE_ALARMS, THRESHOLD = 0.001, 12.0
#: Documents whose words are ordinary samples, and random strings of each kind.
SAMPLE_DOCUMENTS, RANDOM_STRINGS = 300, 4096
_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Matches of a text whose places are worked out together.
CHUNK = 256


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """``n`` pseudo-random strings each of base64, hexadecimal and capitals with digits: token, label 1."""
    ids = spark.range(n).select(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512).alias("h"))
    base64 = F.regexp_replace(F.base64(F.unhex("h")), "[\\r\\n]", "")
    capitals = F.regexp_replace(F.upper(base64), "[^A-Z0-9]", "")
    return ids.select(F.explode(F.array(F.substring(base64, 1, 40), F.substring("h", 1, 40), F.substring(capitals, 1, 40))).alias("token")).withColumn("label", F.lit(1))


def ordinary_strings(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Words, and identifiers made of them, of ``documents`` whole documents: token, label 0."""
    found = sampled(docs, documents).select(F.filter(words(F.col("text")), lambda w: w.rlike("^[A-Za-z]{3,}$")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.concat_ws("_", F.get("w", i - 1), F.get("w", i)))
    camel = F.transform("w", lambda w: F.concat(w, F.initcap(w), F.lit("Handler")))
    return found.filter(F.size("w") > 0).select(F.explode(F.concat("w", pairs, camel)).alias("token")).withColumn("label", F.lit(0))


def calibrated(samples: DataFrame) -> tuple[list[float], float]:
    """(weights, threshold): half of the samples, by a hash, trains; of the other half the ordinary strings that are long enough to be candidates set the threshold."""
    half = F.pmod(F.xxhash64("token"), F.lit(2)) == 0
    weights = train(samples.filter(half))
    held = samples.filter(~half & (F.col("label") == 0) & F.col("token").rlike(f"^{CANDIDATE}$"))
    least = held.agg(F.percentile_approx(log_ratio(F.col("token"), weights), 1 - FALSE_ALARMS, 10_000).alias("x")).first()["x"]
    return weights, max(THRESHOLD, least or 0.0)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each step (previous, next character), by row; ``samples`` are token, label (1 random).

    One row for each label and pair of characters comes to the driver, (len(ALPHABET) + 1) ** 2 * 2 at most.
    Characters outside ALPHABET and the start of a token are character 0.  Null tokens are left out.
    """
    steps = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.struct(_place(F.substr(F.col("token"), i - 1, F.when(i > 1, 1).otherwise(0))).alias("a"), _place(F.substr(F.col("token"), i, F.lit(1))).alias("b")))
    seen = samples.filter(F.length("token") > 0).select("label", F.explode(steps).alias("s")).groupBy("label", "s.a", "s.b").count().collect()
    size = len(ALPHABET) + 1
    count = {(r["label"], r["a"], r["b"]): r["count"] for r in seen}
    total: dict[tuple[int, int], int] = {}
    for (label, a, _), n in count.items():
        total[label, a] = total.get((label, a), 0) + n
    chance = lambda y, a, b: log((count.get((y, a, b), 0) + 0.5) / (total.get((y, a), 0) + 0.5 * size))
    return [round(chance(1, a, b) - chance(0, a, b), 4) for a in range(size) for b in range(size)]


def _place(c: Column) -> Column:
    """1-based place of a character in ALPHABET, 0 for others and for none."""
    return F.when(c == "", 0).otherwise(F.call_function("instr", F.lit(ALPHABET), c))


def _constant(values: list[float]) -> Column:
    """An array that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<double>")


def log_ratio(token: Column, weights: list[float]) -> Column:
    size = len(ALPHABET) + 1
    table_ = _constant(weights)
    end = F.aggregate(
        F.split(token, ""),
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("was")),
        lambda a, c: F.struct((a["sum"] + F.get(table_, a["was"] * size + _place(c))).alias("sum"), _place(c).alias("was")),
        lambda a: a["sum"],
    )
    return end


def _with_spans(df: DataFrame, name: str, pattern: str, kind: int, keep) -> DataFrame:
    """``df`` with a column of the spans of the matches in text for which keep(match, group 2 or None) holds, leftmost first.

    What is used in a lambda is a column of its own, and used twice, so that it isn't worked out again for each
    element: the time taken grows with the matches.
    """
    text, sizes, sums = F.col("text"), f"_{name}_sizes", f"_{name}_sums"
    match, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == 0 else 0))
    rows = F.arrays_zip(match.alias("m"), F.slice(between, F.lit(1), F.size(match)).alias("b"), inner.alias("g"))
    size = F.transform(rows, lambda r: F.struct((F.length(r["b"]) + F.length(r["m"])).alias("step"), F.length(r["m"]).alias("n"), keep(r["m"], r["g"]).alias("keep")))
    df = df.withColumn(sizes, F.when(text.rlike(pattern), size))
    # where each match begins: a running sum over matches, in chunks so that no array grows one by one
    chunk = lambda i: F.slice(sizes, i * CHUNK + 1, F.lit(CHUNK))
    chunks = F.sequence(F.lit(0), F.ceil(F.size(sizes) / CHUNK).cast("int") - 1)
    df = df.withColumn(sums, F.when(F.size(sizes) > 0, F.transform(chunks, lambda i: F.aggregate(chunk(i), F.lit(0), lambda a, r: a + r["step"]))))
    spans = F.flatten(F.transform(sums, lambda _, i: _chunk_spans(chunk(i), F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0), lambda a, x: a + x), kind)))
    return df.withColumn(name, F.when(F.col(sums).isNull(), F.array().cast(_SPAN)).otherwise(spans)).drop(sizes, sums)


def _chunk_spans(rows: Column, first: Column, kind: int) -> Column:
    """Spans of one chunk of matches {step, n, keep} that begins at the place ``first`` of the text."""
    return F.aggregate(
        rows,
        F.struct(first.alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda a, r: F.struct(
            (a["at"] + r["step"]).alias("at"),
            F.when(r["keep"], F.concat(a["out"], F.array(F.struct((a["at"] + r["step"] - r["n"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + r["step"]).alias("end"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and base: sorted spans of the fixed patterns, {start, kind (place in KINDS), end}."""
    step = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    step = _with_spans(step, "assign", ASSIGN, 0, lambda m, g: F.length(g) >= 12)
    step = _with_spans(step, "access", ACCESS, 1, lambda m, g: F.lit(True))
    step = _with_spans(step, "hex", HEX, 2, lambda m, g: F.lit(True))
    return step.select("doc_id", "text", F.sort_array(F.concat("assign", "access", "hex")).alias("base"))


def _apart(spans: str, base: str) -> Column:
    """Those of ``spans`` that overlap none of ``base``; both are sorted.  A chunk of spans meets the base spans between its ends only."""
    bound = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    within = lambda part: F.filter(base, lambda b: (b["start"] < F.element_at(part, -1)["end"]) & (F.element_at(part, 1)["start"] < b["end"]))
    alone = lambda part, near: F.filter(part, lambda s: ~F.exists(near, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    chunks = F.sequence(F.lit(0), F.ceil(F.size(spans) / CHUNK).cast("int") - 1)
    return F.flatten(F.transform(chunks, lambda i: bound(F.slice(spans, i * CHUNK + 1, F.lit(CHUNK)), lambda part: bound(within(part), lambda near: alone(part, near)))))


def find_secrets(docs: DataFrame, weights: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text, base and added: sorted spans {start, kind (place in KINDS), end} of each row of ``docs`` (doc_id, text).

    Null and empty texts have no span; repeated rows and null doc_ids are scanned like any other; other columns are
    not read; an empty table gives no row.  Added spans never overlap base ones.
    """
    step = _with_spans(base_spans(docs), "maybe", CANDIDATE, 3, lambda m, g: log_ratio(m, weights) > threshold)
    added = F.when((F.size("base") == 0) | (F.size("maybe") == 0), F.col("maybe")).otherwise(_apart("maybe", "base"))
    return step.select("doc_id", "text", "base", added.alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_columns(found: DataFrame) -> list[Column]:
    """doc_id, how many base spans of each kind there are, and a digest of them."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return [F.col("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256")]


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, *calibrated(random_strings(spark).unionByName(ordinary_strings(docs))))
    return found.select(*base_columns(found), joined(F.sort_array(F.concat("base", "added"))).alias("spans"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of the fixed patterns, without the method."""
    found = base_spans(table(spark, sf_dir, "documents"))
    return found.select(*base_columns(found))


def _sql_spans(kind: int, pattern: str, group: int, least: int) -> str:
    """A list of {s, k, e} of the matches of a pattern in t whose group has ``least`` characters."""
    pattern = pattern.replace("'", "''")
    m, between, inner = f"regexp_extract_all(t, '{pattern}')", f"regexp_split_to_array(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}', {group})"
    size = lambda of, end: f"coalesce(list_sum(list_transform({of}[1:{end}], lambda y: length(y))), 0)::BIGINT"
    return f"""list_transform(list_filter(range(1, len({m}) + 1), lambda i: length({inner}[i]) >= {least}),
      lambda i: {{'s': {size(between, "i")} + {size(m, "i - 1")}, 'k': {kind}, 'e': {size(between, "i")} + {size(m, "i")}}})"""


BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {_sql_spans(0, ASSIGN, 2, 12)} AS a, {_sql_spans(1, ACCESS, 0, 18)} AS b, {_sql_spans(2, HEX, 0, 16)} AS c FROM d)
SELECT doc_id, len(a)::BIGINT AS n_assign, len(b)::BIGINT AS n_access, len(c)::BIGINT AS n_hex,
  sha256(array_to_string(list_transform(list_sort(list_concat(a, list_concat(b, c))), lambda x: ['assign', 'access', 'hex'][x.k + 1] || ':' || x.s || ':' || x.e), ',')) AS base_sha256
FROM f
"""
