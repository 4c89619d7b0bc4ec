"""Op 6, language identification by Bayesian evidence fusion.

Independent pieces of evidence are added up as log odds over the known languages:

* the text: a naive Bayes model of character trigrams, trained on a bounded sample of labelled documents,
* the declared language of the markup (the lang attribute of its html element),
* the address suffix, the last label of the host,
* the host: how often each language occurs on it, smoothed towards its registered domain and that towards all,
  from the languages that the text alone gives, by grouped aggregation.

How far declarations and suffixes are to be trusted is counted, too: both are tables of P(evidence | language) from
the same first pass, with add-one smoothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .urls import levels, url_parts

#: Documents of each language that the text model is trained on, with their whole texts.
SAMPLE = 150
#: Code points of a text that are looked up at a time.
PIECE = 100_000
BUCKETS = 1 << 15
#: Weight of one piece of text evidence: neighbouring trigrams tell much the same.
DAMP = 0.3
_ENTITY = re.compile(r"&[a-zA-Z#0-9]{1,8};")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_text(html: str) -> str:
    """Text without comments, scripts, styles, tags and entities, each of which leaves a space.

    One pass: a closing mark that is missing once is not looked for again; a tag without end is text.
    """
    low, out, at, missing = html.translate(_LOWER), [], 0, set()
    while (i := low.find("<", at)) >= 0:
        closer = "-->" if low.startswith("<!--", i) else next((f"</{t}>" for t in ("script", "style") if low.startswith(t, i + 1) and not low[i + 1 + len(t) : i + 2 + len(t)].isalnum()), ">")
        end = -1
        for mark in dict.fromkeys((closer, ">")):
            if end < 0 and mark not in missing:
                end = low.find(mark, i + 1)
                if end < 0:
                    missing.add(mark)
                else:
                    end += len(mark)
        if end < 0:
            break
        out.append(html[at:i])
        at = end
    out.append(html[at:])
    return _ENTITY.sub(" ", " ".join(out))


def gram_buckets(text: str) -> np.ndarray:
    """Bucket of each trigram of code points of the lower-cased text."""
    x = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(x) < 3:
        x = np.concatenate([x, np.full(3 - len(x), 32, np.uint64)])
    h = (x[:-2] * np.uint64(1000003) + x[1:-1]) * np.uint64(1000003) + x[2:]
    h = (h ^ (h >> np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for piece in pieces(text or ""):
                n = np.bincount(gram_buckets(piece), minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])


def pieces(text: str) -> list[str]:
    """A long text in pieces that share two code points, so that no trigram is lost or counted twice."""
    return [text[k : k + PIECE + 2] for k in range(0, max(1, len(text) - 2), PIECE)]


def train(samples: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each bucket by language) from lang and text.

    The driver gets one row a language and bucket.
    """
    seen = samples.select("lang", "text").mapInArrow(_counted, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(seen["lang"]))
    counts = np.full((max(1, len(names)), BUCKETS), 0.05)
    counts[[names.index(x) for x in seen["lang"]], seen["bucket"].to_numpy(int)] += seen["n"].to_numpy(float)
    logs = np.log(counts / counts.sum(1, keepdims=True))
    # only differences between languages matter
    return names or ["und"], (logs - logs.mean(0)).astype(np.float32)


def sample(docs: DataFrame, each: int = SAMPLE) -> DataFrame:
    """lang and text of up to ``each`` labelled documents of each language, those of least hash; rows that repeat an id are all taken."""
    from pyspark.sql import Window as W

    order = F.xxhash64("doc_id")
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", order.alias("o"))
    # a share of the hash space that holds enough of each language is looked at, before anything is sorted
    share = ids.groupBy("lang").agg(F.least(F.lit(1.0), 4.0 * each / F.count(F.lit(1))).alias("share"))
    some = ids.join(F.broadcast(share), "lang").filter(F.pmod("o", F.lit(1 << 20)) <= F.col("share") * (1 << 20))
    best = some.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("o", "doc_id"))).filter(F.col("n") <= each)
    return docs.join(F.broadcast(best.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi").select("lang", "text")


def _scored(names: list[str], logs: np.ndarray, html: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.ascontiguousarray(logs.T)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py() or ""
                text = plain_text(text) if html else text
                total = np.zeros(len(names))
                for piece in pieces(text):
                    total += table_[gram_buckets(piece)].sum(0)
                out.append(total * DAMP if text.strip() else np.zeros(len(names)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("declared"), batch.column("host"), pa.array(out, pa.list_(pa.float64()))], names=["id", "declared", "host", "score"])

    return score


def _softmax(scores):
    top = F.array_max(scores)
    raw = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raw, lambda r: r / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))


def _place(p):
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def identify(rows: DataFrame, names: list[str], logs: np.ndarray, html: bool) -> DataFrame:
    """id, lang and probability for each row of ``rows``: id, text, declared (language, may be null), host (may be '').

    Null, empty and blank texts say nothing: declaration, suffix and host decide, and where these are missing too
    the most common language.  On a tie the first language by name wins.  Repeated rows and null ids are judged
    each; an empty table gives no row.
    """
    n = len(names)
    with Scratch(rows.sparkSession) as scratch:
        kept = rows.select("id", "text", "declared", F.coalesce("host", F.lit("")).alias("host"))
        scored = scratch.save(kept.mapInArrow(_scored(names, logs, html), "id bigint, declared string, host string, score array<double>"), "scored", keep=True)
        place = {k: c for k, c in levels(F.col("host")).items()}
        first = scored.select("declared", "host", place["domain"].alias("domain"), place["suffix"].alias("suffix"), _place(F.col("score")).alias("k"), (F.array_max("score") - F.array_min("score") > 0).alias("told"))
        told = [F.count_if(F.col("told") & (F.col("k") == k)).alias(f"n{k}") for k in range(n)]
        by = scratch.save(first.groupBy("declared", "host", "domain", "suffix").agg(*told), "by", keep=True)
    sums = lambda *keys: by.groupBy(*keys).agg(F.array(*[F.sum(f"n{k}").cast("double") for k in range(n)]).alias("n"))
    whole = sums().first()["n"] or [0.0] * n
    share = [(x or 0.0) + 1 for x in whole]
    share = F.array(*[F.lit(x / sum(share)) for x in share])
    # P(evidence | language): how often text of the language comes with the declaration, or the suffix
    likely = lambda name: sums(name).select(name, F.transform("n", lambda x, i: F.log((x + 1) / (F.get(F.array(*[F.lit((w or 0.0) + 2) for w in whole]), i)))).alias(f"{name}_log"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    smooth = lambda counts, prior, weight: F.transform(F.arrays_zip(counts.alias("c"), prior.alias("p")), lambda z: (z["c"] + weight * z["p"]) / (total(counts) + weight))
    domains = sums("domain").select("domain", smooth(F.col("n"), share, 10.0).alias("up"))
    hosts = sums("host").withColumn("domain", levels(F.col("host"))["domain"]).join(domains, "domain").select("host", smooth(F.col("n"), F.col("up"), 10.0).alias("prior"))
    all_ = scored.withColumn("suffix", levels(F.col("host"))["suffix"])
    all_ = all_.join(hosts, "host", "left").join(likely("declared"), "declared", "left").join(likely("suffix"), "suffix", "left")
    zero = F.array(*[F.lit(0.0)] * n)
    # where nothing is declared, or there is no host, the piece says nothing
    declared, suffix = F.when(F.col("declared").isNotNull(), F.col("declared_log")), F.when(F.col("host") != "", F.col("suffix_log"))
    parts = F.arrays_zip(F.col("score").alias("s"), F.coalesce(declared, zero).alias("d"), F.coalesce(suffix, zero).alias("a"), F.coalesce("prior", share).alias("p"))
    fused = all_.select("id", _softmax(F.transform(parts, lambda z: z["s"] + z["d"] + z["a"] + F.log(z["p"]))).alias("p"))
    known = F.array(*map(F.lit, names))
    return fused.select("id", F.get(known, _place(F.col("p"))).alias("lang"), F.array_max("p").alias("probability"))


def declared_language(html):
    """Language of the html element's lang attribute, without its region; null if there is none."""
    found = F.lower(F.regexp_extract(html, "(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all their evidence, and documents, whose source stands in for the host and which declare nothing."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    names, logs = train(sample(docs))
    host, _ = url_parts(F.col("url"))
    shown = identify(pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), declared_language(F.col("html")).alias("declared"), host.alias("host")), names, logs, True)
    texts = identify(docs.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host")), names, logs, False)
    none = F.lit(None).cast("bigint")
    pages_out = shown.select(none.alias("doc_id"), F.col("id").alias("page_id"), "lang", "probability")
    return texts.select(F.col("id").alias("doc_id"), none.alias("page_id"), "lang", "probability").unionByName(pages_out)
