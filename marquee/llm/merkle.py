"""Op 12, a Merkle manifest of documents: supersteps over RDDs, in the manner of Pregel.

Documents are leaves, in one tree for each language; runs of ``FAN`` consecutive nodes have one parent, and the trees'
roots are the leaves of one more tree.  Upward, children send their digests to their parents; a parent that has heard
from all its children hashes them and speaks in the next superstep, and a tree that has one node left falls silent.
Downward, parents send their children the run of digests that they come from, and what they have heard themselves,
so that in the end each group of sibling leaves holds its path to the root: what is needed to prove that a document,
as it is now, belongs to the manifest.

A vertex is keyed by tree and place, so no tree is gathered in one task however large its language is.  What each
superstep has found is written to the shared folder.  Digests are 32 bytes here and hexadecimal text where they are hashed.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii, table
from .conversations import CRC_TABLE, sql_crc32
from .ordering import places

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_RUNS = "tree string, at bigint, n bigint, run binary"
_TOPS = "tree string, level int, digest binary"


def leaf(**changed: Column) -> Column:
    """Digest of a document's fields, each as its length in UTF-8 bytes, a colon and its value, or - for null."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered() -> Column:
    """Leaf of a document with its text's A-Z lower-cased where 3 divides the crc32 of its decimal doc_id; null where it is not tampered with."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(text=lower_ascii(F.col("text"))))


def leaves(docs: DataFrame, told: Column | None = None) -> DataFrame:
    """doc_id, tree (of its lang), leaf and told (leaf of the document as it is said to be now; null: unchanged)."""
    tree = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))  # null before all, and apart from ""
    return docs.select("doc_id", tree.alias("tree"), F.unhex(leaf()).alias("leaf"), F.unhex(F.lit(None).cast("string") if told is None else told).alias("told"))


def _hash(run: bytes) -> bytes:
    return sha256(run.hex().encode()).digest()


def _complete(vertex: tuple) -> tuple:
    """A parent and what its children have said: (tree, at, nodes on its level, run of digests)."""
    (tree, at), said = vertex
    said = sorted(said)
    n = said[0][1]
    if [i for i, _, _ in said] != list(range(min(FAN, n - FAN * at))):
        raise ValueError(f"node {at} of tree {tree!r} has not heard from each of its children once")
    return tree, at, -(-n // FAN), b"".join(digest for _, _, digest in said)


def _grow(scratch: Scratch, nodes: RDD, most: int, parts: int, name: str) -> tuple[list[DataFrame], RDD]:
    """Supersteps upward over nodes (tree, at, n, digest): the runs of each level, and (tree, level, digest) of the trees' tops.

    ``most`` is the number of leaves of the largest tree.
    """
    spark, levels, tops, level = scratch.spark, [], [], 0
    while True:
        tops.append(nodes.filter(lambda x: x[2] == 1).map(lambda x, level=level: (x[0], level, x[3])))
        if most <= 1:
            return levels, spark.sparkContext.union(tops)
        messages = nodes.filter(lambda x: x[2] > 1).map(lambda x: ((x[0], x[1] // FAN), (x[1] % FAN, x[2], x[3])))
        runs = messages.groupByKey(parts).map(_complete)
        levels.append(scratch.save(spark.createDataFrame(runs, _RUNS, verifySchema=False), f"{name}-{level}"))
        nodes = levels[-1].rdd.map(lambda r: (r[0], r[1], r[2], _hash(bytes(r[3]))))
        most, level, parts = -(-most // FAN), level + 1, max(1, parts // FAN)


def _broadcast_down(levels: list[DataFrame], tops: RDD, parts: int) -> RDD:
    """Reverse supersteps from tops (tree, level, carried, path): ((tree, at of a lowest parent), (run of leaves, carried, path)).

    A path is, from the lowest level up, the place in the run, the run's length and the run, for each level.  A tree of
    one leaf has an empty run.
    """
    alone = lambda level: tops.filter(lambda x: x[1] == level).map(lambda x: ((x[0], 0), (x[2], x[3])))
    heard = alone(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        sent = levels[level].rdd.map(lambda r: ((r[0], r[1]), bytes(r[3]))).join(heard, max(1, parts // FAN**level))
        if level == 0:
            return sent.map(lambda x: (x[0], (x[1][0], *x[1][1]))).union(_single(alone(0)))
        heard = sent.flatMap(_to_children).union(alone(level))
    return _single(heard)


def _single(tops: RDD) -> RDD:
    """Trees of one leaf: what has reached it, and no run."""
    return tops.map(lambda x: (x[0], (b"", *x[1])))


def _to_children(vertex: tuple) -> Iterable[tuple]:
    (tree, at), (run, (carried, path)) = vertex
    n = len(run) // 32
    return [((tree, at * FAN + i), (carried, bytes((i, n)) + run + path)) for i in range(n)]


def steps(path: bytes) -> list[tuple[int, bytes]]:
    """(place, run) of each level of a path, upward."""
    out, at = [], 0
    while at < len(path):
        n = path[at + 1]
        out.append((path[at], path[at + 2 : at + 2 + 32 * n]))
        at += 2 + 32 * n
    return out


def folded(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf's digest leads to."""
    for i, run in path:
        digest = _hash(run[: 32 * i] + digest + run[32 * i + 32 :])
    return digest


def siblings(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(run[: 32 * i] + run[32 * i + 32 :] for i, run in path)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def manifest(documents: DataFrame, full: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``leaves``; with ``full``, proof too.

    proof is the siblings' digests (64 characters each), level by level to the root; folded_root comes from ``told``
    (else the leaf) and those siblings.  Any column may be null: leaves tell null from every value, null languages are
    a tree of their own, null ids come first.  Rows that share an id are leaves beside each other, ordered by digest;
    equal rows are as many leaves.  An empty table gives no row.
    """
    spark = documents.sparkSession
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof string" * full
    parts = _parts(spark)
    with Scratch(spark) as scratch:
        # digests first: they are all that is sorted
        held = scratch.save(documents, "leaves")
        placed = scratch.save(places(scratch, held, "tree", [F.col("tree").asc(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("told").asc_nulls_first()], "sorted"), "placed")
        most = placed.agg(F.max("n")).first()[0]
        if most is None:
            return spark.createDataFrame([], schema)
        levels, tops = _grow(scratch, placed.select("tree", "at", "n", "leaf").rdd.map(lambda r: (r[0], r[1], r[2], bytes(r[3]))), most, parts, "runs")
        tops = scratch.save(spark.createDataFrame(tops, _TOPS, verifySchema=False), "tops")
        crown = scratch.save(places(scratch, tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "level", "digest"), "tree", [F.col("tree").asc(), F.col("of").asc(), F.col("digest").asc(), F.col("level").asc()], "crown-sorted"), "crown")
        trees = crown.agg(F.max("n")).first()[0]
        small = min(parts, -(-trees // 4096))
        over, top = _grow(scratch, crown.select("tree", "at", "n", "digest").rdd.map(lambda r: (r[0], r[1], r[2], bytes(r[3]))), trees, small, "crown")
        (_, height, root) = top.first()
        above = _broadcast_down(over, spark.sparkContext.parallelize([("", height, b"", b"")], 1), small)
        subroots = crown.select("of", "at", "level", "digest").rdd.map(lambda r: (("", r[1] // FAN), (r[0], r[1] % FAN, r[2], bytes(r[3])))).join(above, small)

        def told_top(x: tuple) -> tuple:
            (tree, i, level, digest), (run, _, path) = x[1]
            return tree, level, digest, (bytes((i, len(run) // 32)) + run if run else b"") + path

        lowest = _broadcast_down(levels, subroots.map(told_top), parts)
        rows = placed.select("tree", "at", "doc_id", "leaf", "told").rdd.map(lambda r: ((r[0], r[1] // FAN), (r[1] % FAN, r[2], bytes(r[3]), None if r[4] is None else bytes(r[4]))))

        def proved(x: tuple) -> tuple:
            (i, doc_id, own, told), (run, subroot, path) = x[1]
            way = ([(i, run)] if run else []) + steps(path)
            others, end = siblings(way).hex(), folded(told or own, way)
            return (doc_id, own.hex(), subroot.hex(), root.hex(), sha256(others.encode()).hexdigest(), end.hex(), end == root) + (others,) * full

        found = spark.createDataFrame(rows.join(lowest, parts).map(proved), schema, verifySchema=False)
        return scratch.save(found, "manifest", keep=True)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(leaves(table(spark, sf_dir, "documents"), tampered()))


def _sql() -> str:
    """Levels unrolled, 6 below the subroots and 3 above: up to 8 ** 6 documents a language and 8 ** 3 languages."""
    value = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf_of = lambda text: f"sha256({' || '.join(value(x) for x in (*FIELDS[:-1], text))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        CRC_TABLE,
        f"""l AS (SELECT doc_id, lang, {leaf_of("text")} AS leaf, CASE WHEN {sql_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {leaf_of(lower)} END AS told FROM documents, crc)""",
        "n0 AS (SELECT coalesce('1' || lang, '0') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, told NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS digest, doc_id, leaf, told FROM l)",
        "f0 AS (SELECT doc_id, leaf, tree, pos AS id, tree AS now, pos, coalesce(told, leaf) AS cur, '' AS proof FROM n0)",
    ]
    up = lambda a, b: f"{b} AS (SELECT tree, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {a} GROUP BY tree, pos // 8, n)"
    across = lambda f, n, to: f"""{to} AS (SELECT f.doc_id, f.leaf, f.tree, id, now, f.pos // 8 AS pos,
  CASE WHEN s.n = 1 THEN cur ELSE sha256(string_agg(CASE WHEN s.pos = f.pos THEN cur ELSE s.digest END, '' ORDER BY s.pos)) END AS cur,
  proof || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos <> f.pos), '') AS proof
  FROM {f} f JOIN {n} s ON s.tree = f.now AND s.pos // 8 = f.pos // 8 GROUP BY f.doc_id, f.leaf, f.tree, id, now, f.pos, cur, proof, s.n)"""  # noqa: E731
    for k in range(6):
        parts += [up(f"n{k}", f"n{k + 1}"), across(f"f{k}", f"n{k}", f"f{k + 1}")]
    parts += [
        "c AS (SELECT tree AS of, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n6)",
        "n10 AS (SELECT '' AS tree, pos, count(*) OVER () AS n, subroot AS digest FROM c)",
        "f10 AS (SELECT doc_id, leaf, f.tree, id, '' AS now, c.pos, cur, proof FROM f6 f JOIN c ON c.of = f.tree)",
    ]
    for k in range(10, 13):
        parts += [up(f"n{k}", f"n{k + 1}"), across(f"f{k}", f"n{k}", f"f{k + 1}")]
    return f"""WITH RECURSIVE {', '.join(parts)}
SELECT doc_id, leaf, c.subroot, n13.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = n13.digest AS verified
FROM f13 JOIN c ON c.of = f13.tree, n13"""


ORACLE_SQL = _sql()
