"""Op 8, benchmark decontamination by spaced-seed hashing.

A mask reads some of the words in a window and ignores the others, so a passage is still found where words were
substituted at ignored places; several masks ignore different places.  The hashes of all windows of the test items
are joined with those of the documents.  What reaches the join is thinned out first by a filter made of the test
hashes.  Where hits are, the document is laid against the item word by word, and the longest stretch of which SHARE
of the words are equal must have LEAST equal words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, row_key, same_row, table
from .shingles import mix, word_hashes

MASKS = ("110110101", "111010011", "110011101", "101101011")
SPAN = 9
#: Words of the shortest items that are searched unless the caller says otherwise; a few words alone are no evidence.
SHORTEST = 5
LEAST, SHARE = 12, 0.7
#: Bits of the filter a test hash, and the most of all of them (as powers of 2); with more hashes it lets more through, to the same result.
BITS_EACH, LEAST_BITS, MOST_BITS = 1024, 20, 28
_M = np.uint64(0x9E3779B97F4A7C15)
_SEED = "item_id bigint, hash bigint, place int"
_ITEM = "item_id bigint, item binary"
_HITS = "text bigint, doc_id bigint, row bigint, words binary, hash array<bigint>, place array<int>"
_FOUND = "doc_id bigint, row bigint, item_id bigint, start bigint, end bigint, equal bigint"


def masks_of(n: int, shortest: int = SHORTEST) -> list[str]:
    """The masks for an item of n words; one shorter than a window is searched as a whole (exact).

    No mask ignores its own first or last word: in an item of one window, a substitution there leaves a window of one
    word less.
    """
    if n < SPAN:
        return ["1" * n] if n >= max(1, shortest) else []
    return [*MASKS, "1" * (SPAN - 1)] if n == SPAN else [*MASKS]


def needed(n: int) -> int:
    """How many words of an item of n words must be equal."""
    return n if n < SPAN else min(LEAST, math.ceil(SHARE * n))


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash under a mask of the window at each position of h; none where less than a window is left."""
    n = len(h) - len(mask) + 1
    acc = np.full(max(n, 0), hash_of(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            acc = acc * _M + h[i : i + len(acc)]
    return mix(acc)


def hash_of(mask: str) -> int:
    return int(mask, 2) * 2654435761 + len(mask)


def _item_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, bounds = word_hashes(batch.column("text").cast(pa.string()))
        items = [h[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("item_id").cast(pa.int64()), pa.array(items, pa.binary())], names=["item_id", "item"])


def _item_seeds(shortest: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column("item_id").to_pylist(), batch.column("item").to_pylist()):
                h = np.frombuffer(raw, "<u8")
                for mask in masks_of(len(h), shortest):
                    got = seeds(h, mask).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(got), pa.int64()), pa.array(got), pa.array(np.arange(len(got), dtype=np.int32))], names=["item_id", "hash", "place"])

    return make


def _hits(filter_bits: bytes, power: int, masks: list[str]):
    """Texts with windows that pass the filter: all words, and the hash and place of each such window."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bits = np.unpackbits(np.frombuffer(filter_bits, np.uint8), bitorder="little").view(bool)
        low, shift = np.uint64((1 << power) - 1), np.uint64(64 - power)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                h, bounds = word_hashes(part.column("text").cast(pa.string()))
                at, hashes = [], []
                for mask in masks:
                    got = seeds(h, mask)
                    hit = np.flatnonzero(bits[got & low])
                    hit = hit[bits[got[hit] >> shift]]
                    # windows that reach into the next text are none
                    hit = hit[hit + len(mask) <= bounds[np.searchsorted(bounds, hit, "right")]]
                    at.append(hit)
                    hashes.append(got[hit])
                at, hashes = np.concatenate(at), np.concatenate(hashes).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                ends = np.searchsorted(at, bounds)
                for i in np.flatnonzero(np.diff(ends)).tolist():
                    of, first = slice(ends[i], ends[i + 1]), int(bounds[i])
                    row = {"text": number, "doc_id": part.column("doc_id")[i].as_py(), "row": part.column("row")[i].as_py(), "words": h[first : bounds[i + 1]].astype("<u8").tobytes(), "hash": hashes[of].tolist(), "place": (at[of] - first).tolist()}
                    number += 1
                    yield pa.RecordBatch.from_pylist([row], schema=_ARROW_HITS)

    return find


_ARROW_HITS = pa.schema([("text", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("words", pa.binary()), ("hash", pa.list_(pa.int64())), ("place", pa.list_(pa.int32()))])


def longest_overlap(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal) of the stretch with most equal places among those that have SHARE of their places equal.

    Equal places at its ends; (0, 0, 0) where nothing is equal.
    """
    share = round(SHARE * 10)
    equal = np.concatenate([[0], np.cumsum(same)])
    sums = np.concatenate([[0], np.cumsum(np.where(same, 10 - share, -share))])
    # the first start from which the sum up to an end is not negative gives the most equal places
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    end = int(np.argmax(equal - equal[starts]))
    inside = np.flatnonzero(same[starts[end] : end]) + int(starts[end])
    return (int(inside[0]), int(inside[-1]) + 1, len(inside)) if len(inside) else (0, 0, 0)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            words, item = (np.frombuffer(batch.column(c)[r].as_py(), "<u8") for c in ("words", "item"))
            best = None
            for d in batch.column("shifts")[r].as_py():
                a, b = max(0, d), min(len(words), d + len(item))
                start, end, equal = longest_overlap(words[a:b] == item[a - d : b - d])
                if equal >= needed(len(item)) and (best is None or equal > best[2]):
                    best = (a + start, a + end, equal)
            if best:
                first = batch.column("first")[r].as_py()
                rows.append({"doc_id": batch.column("doc_id")[r].as_py(), "row": batch.column("row")[r].as_py(), "item_id": batch.column("item_id")[r].as_py(), "start": first + best[0], "end": first + best[1], "equal": best[2]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")]))


def filter_of(tested: DataFrame) -> tuple[bytes, int]:
    """(bits that the hashes of ``tested`` set, their number as a power of 2): each hash sets two, by its low and its high end.

    The bits are put together by Spark, 4096 bytes a row; the driver gets 2 ** MOST_BITS / 8 bytes at most.
    """
    n = tested.agg(F.approx_count_distinct("hash").alias("n")).first()["n"] * BITS_EACH
    power = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n)))))
    h = F.col("hash")
    place = tested.select(F.explode(F.array(h.bitwiseAND((1 << power) - 1), F.shiftrightunsigned(h, 64 - power))).alias("p")).select((F.col("p") + 1).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = bytearray((1 << power) // 8)
    for r in parts.toLocalIterator():
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["bits"]
    return bytes(bits), power


def overlaps(docs: DataFrame, items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, row, item_id, start, end (words of the document) and equal of the longest verified overlap of each row and item.

    ``docs`` are doc_id and text, ``items`` item_id and text; other columns are not read.  row is a hash of doc_id and
    text (``row_key``): rows that share or lack an id are judged each.  Null, empty and blank texts have no overlap.
    Items of fewer than ``shortest`` words are not searched for.  Empty tables give no row.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        laid = scratch.save(items.select("item_id", "text").mapInArrow(_item_parts, _ITEM), "items")
        tested = scratch.save(laid.mapInArrow(_item_seeds(shortest), _SEED), "seeds")
        lengths = [r["n"] for r in laid.select((F.length("item") / 8).cast("int").alias("n")).filter(F.col("n") <= SPAN).distinct().collect()]
        masks = sorted({*MASKS, *(m for n in lengths for m in masks_of(n, shortest))})
        texts = docs.select("doc_id", "text", row_key().alias("row"))
        held = scratch.save(texts.mapInArrow(_hits(*filter_of(tested), masks), _HITS), "hits")
        hits = held.select("text", F.explode(F.arrays_zip("hash", "place")).alias("h")).select("text", F.col("h.hash").alias("hash"), F.col("h.place").alias("at"))
        shifts = hits.join(tested, "hash").groupBy("text", "item_id").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
        wide = shifts.join(held.select("text", "doc_id", "row", "words"), "text").join(laid, "item_id")
        # of the words only those that the item can lie on
        first, end = F.greatest(F.array_min("shifts"), F.lit(0)), F.array_max("shifts") + (F.length("item") / 8).cast("int")
        words = F.substr("words", (first * 8 + 1).cast("int"), ((end - first) * 8).cast("int"))
        wide = wide.select("doc_id", "row", "item_id", first.cast("bigint").alias("first"), words.alias("words"), "item", F.transform("shifts", lambda d: d - first).alias("shifts"))
        return scratch.save(wide.mapInArrow(_verified, _FOUND), "overlaps", keep=True)


def contaminated(docs: DataFrame, items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, row, item_ids, n_equal (of the longest overlap) and kept for each row of ``docs``; see ``overlaps``."""
    found = overlaps(docs, items, shortest).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("equal").alias("n_equal"))
    out = docs.select("doc_id", row_key().alias("row")).alias("d").join(found.alias("f"), same_row("d", "f"), "left")
    return out.select("d.doc_id", "d.row", F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("n_equal", F.lit(0)).alias("n_equal"), F.col("n_equal").isNull().alias("kept"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")
