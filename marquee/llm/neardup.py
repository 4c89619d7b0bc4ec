"""Op 7, MinHash near-duplicates with sequential Bayesian verification.

1. Per document, in one pass: its set of distinct word shingles (as 64-bit hashes), the set's size and digest, and
   a MinHash signature of bands of ROWS values each, as many bands as the threshold asks for.
2. Documents with one digest have equal sets: they form a class, named by the digest.
3. Classes that share a band of the signature are candidates.  At first each is paired with one pivot of its band
   value only.  Where that leaves three or more that are not all linked, the members of the band value are laid out
   in blocks of bounded size and every two blocks are compared: pairs of classes are not rows there, what is linked
   already is skipped, and a pair is looked at in the first band that it shares.  Blocks are dealt out by TOGETHER
   times TOGETHER of them, not by the band, so a band value that very many share is many tasks.  A family of thousands
   of near copies costs a few rows a member, and no pair of a band value is left out.
4. A candidate pair is read off the two signatures batch by batch.  After each batch the posterior of its
   similarity (uniform prior, so Beta(1 + agreed, 1 + differing)) is compared with the threshold, and the pair
   is given up once the chance that it reaches it is below MISS.  Survivors are verified on their full sets.
5. Linked classes are joined to components by repeated minimum labels over links.

MISS also bounds banding: two sets at the threshold share no band with at most that chance (0.85: 44 bands, 0.8: 76).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, give_back, row_key, same_row, table
from .shingles import distinct_sorted, mix, windows, word_hashes

WORDS, ROWS, BATCH = 5, 8, 32
MISS = 1e-6
#: Members of a block, shingles of all of them, and blocks whose pairs are laid out in one place.
BLOCK, BLOCK_SHINGLES, TOGETHER = 128, 1 << 18, 16
_SKETCH = "doc_id bigint, row bigint, n_shingles bigint, digest bigint, bands array<bigint>"
_SET = "digest bigint, n_shingles bigint, signature binary, x binary"


def bands_for(threshold: float, miss: float = MISS) -> int:
    """The fewest bands that two sets at the threshold all miss with at most the chance ``miss``."""
    return ceil(log(miss) / log1p(-(threshold**ROWS))) if threshold < 1 else 1


#: Of op 7.
BANDS = bands_for(0.85)


@cache
def _multipliers(bands: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, ROWS * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(x: np.ndarray, bounds: np.ndarray, bands: int) -> np.ndarray:
    """MinHash values (documents, bands * ROWS), 32 bits each, of non-empty sets."""
    mult = _multipliers(bands)
    out = np.empty((len(bounds) - 1, len(mult)), np.uint32)
    step = 0
    while step < len(bounds) - 1:  # pieces that stay in the processor's cache
        stop = max(step + 1, int(np.searchsorted(bounds, bounds[step] + 30_000, "right")) - 1)
        part, at = x[bounds[step] : bounds[stop]], bounds[step:stop] - bounds[step]
        buf = np.empty_like(part)
        for k, m in enumerate(mult):
            np.multiply(part, m, out=buf)
            out[step:stop, k] = np.minimum.reduceat(buf, at) >> np.uint64(32)
        step = stop
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bands = sig.shape[1] // ROWS
    acc = np.zeros((len(sig), bands), np.uint64)
    # of the 16 bits that are kept of each value, so that kept signatures show which bands two sets share
    rows = sig.astype(np.uint16).reshape(len(sig), bands, ROWS).astype(np.uint64)
    for i in range(ROWS):
        acc = (acc ^ rows[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return acc + np.arange(bands, dtype=np.uint64)


def _sets(batch: pa.RecordBatch, step: int = 500) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for k in range(0, batch.num_rows, step):
        part = batch.slice(k, step)
        h, bounds = word_hashes(part.column("text").cast(pa.string()))
        yield part, *distinct_sorted(*windows(h, bounds, WORDS))


def _digests(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits of each set and its size, 0 for empty ones."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros(len(bounds) - 1, np.int64)
    if len(full):
        starts, mixed = bounds[:-1][full], x * np.uint64(0xD6E8FEB86659FD93)
        sums = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
        size = np.diff(bounds)[full].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        out[full] = mix(sums ^ (np.bitwise_xor.reduceat(x, starts) * np.uint64(0x9E3779B97F4A7C15)) ^ size).view(np.int64)
    return out


def _filled(full: np.ndarray, values: list, size: int) -> list:
    out = [None] * size
    for i, v in zip(full.tolist(), values):
        out[i] = v
    return out


def _sketch(bands: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x, bounds in _sets(batch):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                keys = band_keys(signatures(x, np.append(bounds[:-1][full], bounds[-1]), bands)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("row"), pa.array(n.astype(np.int64)), pa.array(_digests(x, bounds)), pa.array(_filled(full, list(keys), len(n)), pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n_shingles", "digest", "bands"],
                )

    return make


def _full_sets(bands: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x, bounds in _sets(batch):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                low = signatures(x, np.append(bounds[:-1][full], bounds[-1]), bands).astype(np.uint16)
                sets = [x[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digests(x, bounds)), pa.array(n.astype(np.int64)), pa.array(_filled(full, [v.tobytes() for v in low], len(n)), pa.binary()), pa.array(sets, pa.binary())],
                    names=["digest", "n_shingles", "signature", "x"],
                )

    return make


def sketches(docs: DataFrame, bands: int) -> DataFrame:
    return docs.select("doc_id", "text", row_key().alias("row")).mapInArrow(_sketch(bands), _SKETCH)


def stop_counts(threshold: float, miss: float, total: int | None = None, batch: int = BATCH) -> list[tuple[int, int]]:
    """For each number of values compared, the least number of equal ones with which a pair goes on.

    P(similarity >= threshold | agreed) = P(Binomial(n + 1, threshold) <= agreed), as the prior is uniform.
    """
    total = total or ROWS * bands_for(threshold, miss)
    found = []
    for n in [*range(batch, total, batch), total]:
        tail, least = 0.0, 0
        for m in range(n + 1):
            tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
            if tail >= miss:
                least = m
                break
        found.append((n, least))
    return found


def _sequential(stops: list[tuple[int, int]]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            alive, agreed, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in stops:
                agreed[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1)
                alive, done = alive[agreed[alive] >= least], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return keep


def _verify(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("xa", "xb"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return check


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): smallest node that can be reached over ``edges`` (a, b); only nodes with an edge are listed.

    Each round every label takes the smallest label around it, and then its label's label; the rounds grow with
    the logarithm of a component's diameter in the usual case, and the work of each with the number of links.
    """
    links = scratch.save(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-links")
    label = scratch.save(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    k = 0
    while True:
        near = links.join(label, links.b == label.node).groupBy("a").agg(F.min("label").alias("near"))
        low = label.join(near, label.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        jump = label.select(F.col("node").alias("at"), F.col("label").alias("to"))
        k += 1
        step = scratch.save(low.join(jump, low.low == jump["at"], "left").select("node", F.least("low", F.coalesce("to", "low")).alias("label"), (F.least("low", F.coalesce("to", "low")) != F.col("label")).alias("moved")), f"{name}-{k}")
        moved = step.filter("moved").limit(1).count()
        label = step.select("node", "label")
        scratch.drop(f"{name}-{k - 1}") if k > 1 else None
        if not moved:
            return label


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = MISS) -> DataFrame:
    """doc_id, row, n_shingles, component, component_id, kept for each row of ``docs`` (doc_id, text; other columns are not read).

    row is a hash of doc_id and text (``row_key``); component is the same number for all rows of a component, null for rows without words.
    Null, empty and blank texts have n_shingles 0 and are linked with nothing: component_id is their own doc_id.
    Texts below five words are one shingle.  component_id is the smallest doc_id of the component, null where all its
    rows lack one.  Rows that repeat a doc_id are judged each by their own text; rows without doc_id are linked like
    any other and have kept null.  An empty table gives no row.
    """
    spark = docs.sparkSession
    bands = bands_for(percent / 100, miss)
    with Scratch(spark) as scratch:
        sketch = scratch.save(sketches(docs, bands), "sketch")
        # a class of equal sets; one of its rows stands for all
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("of")
        classes = scratch.save(sketch.filter("n_shingles > 0").groupBy("digest").agg(least).select("digest", "of.doc_id", "of.row"), "classes")
        one = lambda df: df.alias("d").join(classes.alias("c"), (F.col("d.digest") == F.col("c.digest")) & same_row("d", "c"), "left_semi")
        # only band values of two or more classes matter: the smallest and the largest differ
        banded = one(sketch).select("digest", F.posexplode("bands").alias("number", "band"))
        shared = banded.groupBy("band").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo < hi").select("band")
        members = scratch.save(banded.join(shared, "band").distinct(), "members")
        wanted = classes.join(members.select("digest").distinct(), "digest", "left_semi").select("doc_id", "row")
        rows = docs.select("doc_id", "text", row_key().alias("row")).alias("d")
        texts = rows.join(wanted.alias("c"), same_row("d", "c"), "left_semi").select("text")
        signed = scratch.save(texts.mapInArrow(_full_sets(bands), _SET).dropDuplicates(["digest"]), "signed")
        label = _linked(scratch, members, signed, percent, miss)
        found = classes.select("digest", F.col("doc_id").alias("first"))
        if label is not None:
            found = found.join(label, found.digest == label.node, "left").select("digest", "first", F.coalesce("label", "digest").alias("component"))
            ids = found.groupBy("component").agg(F.min("first").alias("component_id"))
            found = found.join(ids, "component").select("digest", "component", "component_id")
        else:
            found = found.select("digest", F.col("digest").alias("component"), F.col("first").alias("component_id"))
        own = sketch.select("doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
        out = own.join(found, "digest", "left").select("doc_id", "row", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        return scratch.save(out.withColumn("kept", F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.col("component_id"))), "result", keep=True)


def _block_links(percent: int, stops: list[tuple[int, int]]):
    """Links between the members of two blocks of one band value, as few as join what is linked."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for r in range(batch.num_rows):
                same, number = batch.column("same")[r].as_py(), batch.column("number")[r].as_py()
                left = batch.column("left")[r].as_py()
                right = left if same else batch.column("right")[r].as_py()
                sig = [np.frombuffer(b"".join(m["signature"] for m in side), np.uint16).reshape(len(side), -1) for side in (left, right)]
                sets = [[np.frombuffer(m["x"], np.uint64) for m in side] for side in (left, right)]
                size = np.array([len(x) for x in sets[1]])
                up = {m["label"]: m["label"] for side in (left, right) for m in side}

                def root(x: int) -> int:
                    while up[x] != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                for i, m in enumerate(left):
                    n = len(sets[0][i])
                    others = np.arange(i + 1 if same else 0, len(right))
                    others = others[100 * np.minimum(n, size[others]) >= percent * np.maximum(n, size[others])]
                    equal = sig[1][others] == sig[0][i]
                    # a pair that shares an earlier band is looked at there
                    if len(others):
                        keep = equal.reshape(len(others), -1, ROWS).all(2).argmax(1) == number
                        others, agreed, done = others[keep], np.zeros(int(keep.sum()), np.int64), 0
                        equal = equal[keep]
                        for stop, least in stops:
                            agreed += equal[:, done:stop].sum(1)
                            keep = agreed >= least
                            others, equal, agreed, done = others[keep], equal[keep], agreed[keep], stop
                    for j in others.tolist():
                        p, q = root(m["label"]), root(right[j]["label"])
                        if p != q:
                            both = len(np.intersect1d(sets[0][i], sets[1][j], assume_unique=True))
                            if 100 * both >= percent * (n + len(sets[1][j]) - both):
                                up[max(p, q)] = min(p, q)
                                a.append(min(m["digest"], right[j]["digest"]))
                                b.append(max(m["digest"], right[j]["digest"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    return link


def _linked(scratch: Scratch, members: DataFrame, signed: DataFrame, percent: int, miss: float) -> DataFrame | None:
    """(node, label) of linked classes, None if no two share a band value."""
    stops = stop_counts(percent / 100, miss)
    # first every member against one pivot of its band value
    pivot = members.groupBy("band").agg(F.min_by("digest", F.struct(F.xxhash64("digest"), "digest")).alias("pivot"))
    pairs = scratch.save(members.join(pivot, "band").filter("digest <> pivot").select(F.least("digest", "pivot").alias("a"), F.greatest("digest", "pivot").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return None
    small = signed.select("digest", "signature", "n_shingles")
    sa, sb = (small.select(F.col("digest").alias(k), F.col("signature").alias(f"s{k}"), F.col("n_shingles").alias(f"n{k}")) for k in "ab")
    # sets of such different sizes can't be that similar
    sized = pairs.join(sa, "a").join(sb, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    alive = scratch.save(sized.select("a", "b", "sa", "sb").mapInArrow(_sequential(stops), "a bigint, b bigint"), "alive")
    xa, xb = (signed.select(F.col("digest").alias(k), F.col("x").alias(f"x{k}")) for k in "ab")
    star = scratch.save(alive.join(xa, "a").join(xb, "b").select("a", "b", "xa", "xb").mapInArrow(_verify(percent), "a bigint, b bigint"), "star")
    label = components(scratch, star, "first")
    # then the band values of three or more in which not all are linked yet, block by block
    now = scratch.save(members.join(label, members.digest == label.node, "left").select("band", "number", "digest", F.coalesce("label", "digest").alias("label")).join(signed.select("digest", "n_shingles"), "digest"), "now")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    open_ = now.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), blocks.alias("blocks")).filter("lo < hi and n > 2").select("band", "blocks")
    rest = now.join(open_, "band").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).join(signed.select("digest", "signature", "x"), "digest")
    held = scratch.save(rest.groupBy("band", "number", "block", "blocks").agg(F.collect_list(F.struct("digest", "label", "signature", "x")).alias("of")), "blocks")
    one = held.select("number", F.lit(True).alias("same"), F.col("of").alias("left"), F.lit(None).cast(held.schema["of"].dataType).alias("right"))
    # every two blocks meet under the groups that they are of; a block is sent once for each group of its band value
    many = held.filter("blocks > 1")
    groups = F.ceil(F.col("blocks") / TOGETHER).cast("int") - 1
    of = F.floor(F.col("block") / TOGETHER).cast("int")
    l = many.select("band", "number", F.col("block").alias("l"), F.col("of").alias("left"), of.alias("i"), F.explode(F.sequence(of, groups)).alias("j"))
    r = many.select("band", F.col("block").alias("r"), F.col("of").alias("right"), F.explode(F.sequence(F.lit(0), of)).alias("i"), of.alias("j"))
    two = l.join(r, ["band", "i", "j"]).filter("l < r").select("number", F.lit(False).alias("same"), "left", "right")
    more = scratch.save(one.union(two).mapInArrow(_block_links(percent, stops), "a bigint, b bigint"), "more")
    scratch.drop("blocks")
    return components(scratch, star.union(more), "second")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


#: Every pair that shares a shingle, and everything that can be reached over links.
ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 85 * (u.n + v.n - c)),
links AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS x, b AS y FROM links UNION SELECT reach.x, links.b FROM reach JOIN links ON links.a = reach.y),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, coalesce(least(doc_id, y), doc_id) AS component_id, coalesce(least(doc_id, y), doc_id) = doc_id AS kept FROM n LEFT JOIN low ON x = doc_id
"""
