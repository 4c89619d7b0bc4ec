"""Op 13, fingerprints of documents by one-permutation MinHash (DataFrame functions only).

Each five-word shingle is hashed once.  The hash's first bits name one of ``BINS`` bins, and each bin keeps its least
hash.  Bins that no shingle fell into are filled by optimal densification: an empty bin tries other bins, in a random
order of its own that is the same for every text, and takes the first one's value that is not empty.  Two texts then
agree in a bin with a chance of their Jaccard similarity.  Of each value only the ``BITS`` low-order bits are stored,
packed; bits agree by chance once in 2 ** BITS, which the estimate takes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, row_key, table, words
from .ordering import places

#: 256 bins of 4 bits: 16 words of 64 bits, a standard error of 0.033 at a likeness of 0.5.
BINS_BITS, BITS, SHINGLE = 8, 4, 5
BINS = 1 << BINS_BITS
#: Bins that an empty bin tries by name before all full bins are ranked for it.
TRIES = 8
_REST = (1 << (64 - BINS_BITS)) - 1


def _shingles(w: Column) -> Column:
    """Hash of each shingle of five words; fewer words are one shingle, none is no shingle."""
    short = F.array(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    full = F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(w) >= SHINGLE, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))


def _ranked(hashes: Column) -> Column:
    """The hashes in order, with a marker in each bin that comes after all of its hashes, so that every bin has a first one."""
    marks = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BINS_BITS).bitwiseOR(F.lit(_REST)))
    return F.sort_array(F.concat(hashes, marks))


def _least(ranked: Column) -> Column:
    """Each bin's least hash, without the bits that name the bin; null where the bin is empty."""
    bin_of = lambda h: F.shiftright(h, 64 - BINS_BITS)
    first = F.filter(ranked, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ranked, i - 1))))
    return F.transform(first, lambda h: F.when(h.bitwiseAND(F.lit(_REST)) != F.lit(_REST), h.bitwiseAND(F.lit(_REST))))


def _full(bins: Column) -> Column:
    """{j, v} of the bins that are not empty."""
    return F.filter(F.transform(bins, lambda v, j: F.struct(j.alias("j"), v.alias("v"))), lambda x: x["v"].isNotNull())


def _dense(bins: Column, full: Column) -> Column:
    """Bins with the empty ones filled; null where all are empty.

    An empty bin tries TRIES bins by name.  Where these are empty too, few bins are full, and it takes the one of
    them that comes first in its own order of all bins.
    """
    tried = lambda i, k: F.get(bins, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int"))
    first = lambda i: F.array_min(F.transform(full, lambda x: F.struct(F.xxhash64(i, x["j"], F.lit("order")).alias("rank"), x["v"].alias("v"))))["v"]
    # the look at the size also keeps the optimizer from working out ``full`` anew for each bin
    return F.when(F.size(full) > 0, F.transform(bins, lambda v, i: F.coalesce(v, *[tried(i, k) for k in range(TRIES)], first(i)))).otherwise(bins)


def _packed(dense: Column) -> Column:
    """BITS bits of each bin as hexadecimal digits, the first bin first; empty if there are no shingles."""
    digit = lambda v: F.substring(F.lit("0123456789abcdef"), v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(dense, digit), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of a text column: BINS hexadecimal digits, or empty for a text without words (or null).

    Each step is a column of its own, as what stands inside a lambda is worked out again for each element.
    """
    steps = {"w": lambda c: words(lower_ascii(F.col(text))), "h": lambda c: _shingles(c("w")), "r": lambda c: _ranked(c("h")), "b": lambda c: _least(c("r")), "f": lambda c: _full(c("b")), "d": lambda c: _dense(c("b"), c("f"))}
    of = lambda short: F.col(f"_{name}_{short}")
    for short, step in steps.items():
        df = df.withColumn(f"_{name}_{short}", step(of))
    return df.withColumn(name, _packed(of("d"))).drop(*[f"_{name}_{short}" for short in steps])


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity (0 to 1) of the texts of two fingerprints; 1 for two texts without words, 0 if one is."""
    # 16 digits at a time: what differs leaves a bit in its digit
    total = F.lit(0)
    for k in range(BINS // 16):
        word = lambda c: F.conv(F.substring(c, 16 * k + 1, 16), 16, -10).cast("long")  # noqa: E731, B023
        x = word(a).bitwiseXOR(word(b))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111)))
    chance = 1 / (1 << BITS)
    estimate = ((BINS - total) / BINS - chance) / (1 - chance)
    return F.when(F.col(a) == F.col(b), 1.0).when((F.col(a) == "") | (F.col(b) == ""), 0.0).otherwise(F.greatest(F.lit(0.0), estimate))


def keyed(docs: DataFrame) -> DataFrame:
    """key (one for equal rows of doc_id and text), doc_id, row (see ``row_key``) and text of each row.

    The key is a string, not a struct: structs read back differ in what may be null, and would be shuffled anew for each join.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), row_key().cast("string"))
    return docs.select(key.alias("key"), "doc_id", row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def _after(scratch: Scratch, own: DataFrame) -> DataFrame:
    """key and next: the key that follows by descending doc_id; after the last comes the first."""
    rows = own.select("key", "doc_id", "row", F.lit("").alias("all"))
    placed = scratch.save(places(scratch, rows, "all", [F.col("all").asc(), F.col("doc_id").desc_nulls_last(), F.col("row").desc()], "sorted"), "placed")
    return placed.select("key", "at").join(placed.select(F.pmod(F.col("at") - 1, F.col("n")).alias("at"), F.col("key").alias("next")), "at").select("key", "next")


def edits(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint and next_fingerprint of each row of ``docs`` (doc_id, text).

    edited is the text whose last third is replaced by the start of the next row's, by descending doc_id; after the
    last row comes the first.  Null texts are empty; an empty text has an empty fingerprint.  Rows that share an id are
    ordered by a hash, null ids come last, and of equal rows each but the last is followed by its like.  An empty table
    gives no row; other columns are not read.
    """
    rows = keyed(docs)
    prints = with_fingerprint(rows.withColumn("n_chars", F.length("text").cast("long")), "text", "fingerprint")
    own = scratch.save(prints.groupBy("key", "doc_id", "row").agg(F.count(F.lit(1)).alias("copies"), F.first("n_chars").alias("n_chars"), F.first("fingerprint").alias("fingerprint")), "own")
    after = scratch.save(_after(scratch, own), "after")
    third = F.expr("n_chars div 3").cast("int")
    # both joins with the texts read the same shuffle of them
    texts = rows.select("key", "text").withColumn("copy", F.row_number().over(W.partitionBy("key").orderBy("key"))).filter("copy = 1").drop("copy")
    asked = after.join(own.select("key", third.alias("take")), "key").select(F.col("next").alias("key"), F.col("key").alias("by"), "take")
    given = texts.join(asked, "key").join(own.select("key", F.col("fingerprint").alias("next_fingerprint")), "key")
    heads = given.select(F.col("by").alias("key"), F.left("text", "take").alias("head"), "next_fingerprint")
    found = texts.join(own.drop("row"), "key").join(heads, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    last = F.col("copy") == F.col("copies")
    head = F.when(last, F.col("head")).otherwise(F.left("text", third))
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - third), head)
    return found.select("doc_id", "n_chars", edited.alias("edited"), "fingerprint", F.when(last, F.col("next_fingerprint")).otherwise(F.col("fingerprint")).alias("next_fingerprint"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = with_fingerprint(edits(table(spark, sf_dir, "documents"), scratch), "edited", "edited_fingerprint")
        found = found.select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next")
        )
        return scratch.save(found, "fingerprints", keep=True)


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fingerprints are of: doc_id, n_chars and digest of the edited text."""
    with Scratch(spark) as scratch:
        found = edits(table(spark, sf_dir, "documents"), scratch)
        return scratch.save(found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256")), "edits", keep=True)


EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST))
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 3) || left(next, length(text) // 3)) AS edited_sha256 FROM n
"""
