import random
import zlib
from hashlib import sha256

import pytest
from compare import connect, spark_rows, sql_rows

from marquee.llm import merkle
from tests.conftest import MIDDLE, SMALL

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(digests):
    """The last digest and, for each of ``digests``, [(place, run)] up to it."""
    ways, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + 8] for i in range(0, len(digests), 8)]
        for way, i in zip(ways, range(len(at))):
            way.append((at[i] % 8, runs[at[i] // 8]))
            at[i] //= 8
        digests = [h(*run) for run in runs]
    return digests[0], ways


def manifest(rows):
    """Every row's (doc_id, leaf, subroot, root, proof, folded_root, verified)."""
    trees = {}
    for r in rows:
        told = r if r[0] is None or r[4] is None or zlib.crc32(str(r[0]).encode()) % 3 else (*r[:4], r[4].translate(UPPER))
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*map(field, r)), h(*map(field, told)), r[0]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        own = sorted(trees[name])
        built[name] = own, *climb([x[2] for x in own])
    root, tops = climb([built[name][1] for name in names])
    out = []
    for name, top in zip(names, tops):
        own, subroot, ways = built[name]
        for (_, _, leaf, cur, doc_id), way in zip(own, ways):
            others = []
            for i, run in way + top:
                others += run[:i] + run[i + 1 :]
                cur = h(*run[:i], cur, *run[i + 1 :])
            out.append((doc_id, leaf, subroot, root, "".join(others), cur, cur == root))
    return out


def found(spark, rows, full=True):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'x' AS tree", "1.5 AS at", "'y' AS leaf", "2 AS n", "'z' AS told", "3 AS place")
    return [(*r[:4], r["proof"], *r[5:7]) for r in merkle.manifest(merkle.leaves(docs, merkle.tampered()), full).collect()]


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 1], [64, 65, 2, 1, 513], [1] * 70 + [9]])
def test_trees_of_many_sizes(spark, sizes):
    rnd = random.Random(str(sizes))
    rows, ids = [], iter(rnd.sample(range(100_000), sum(sizes)))
    for k, n in enumerate(sizes):
        rows += [(next(ids), rnd.choice(["a", None, "é"]), None if k == 1 else f"l{k}", i, f"Text É {i}") for i in range(n)]
    key = lambda x: tuple(map(str, x))
    assert sorted(found(spark, rows), key=key) == sorted(manifest(rows), key=key)


def test_odd_rows(spark):
    """Nulls in every column, empty and blank languages, repeated rows and ids, and a very long text."""
    rows = [(None, None, None, None, None)] * 3 + [(1, "A", "", 0, ""), (1, "A", "", 0, ""), (1, "A", "", 1, "B"), (1, "A", "", 0, None), (2, "s", "0", 5, "X" * 2_000_000), (3, "-", " ", -1, "-"), (-5, "1:", "\U0001f600", 1, "Ab"), (9, "x", "￿", 1, "Ab")]
    key = lambda x: tuple(map(str, x))
    assert sorted(found(spark, rows), key=key) == sorted(manifest(rows), key=key)


def test_empty_table(spark):
    df = merkle.manifest(merkle.leaves(spark.createDataFrame([], SCHEMA)))
    assert df.collect() == [] and df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_any_change_is_seen(spark):
    """A changed field, and a lower-cased text that had capitals, lead to another root; nothing else does."""
    rows = [(i, "s", "en" if i % 3 else "de", i, f"Text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    told = merkle.leaf(n_chars=F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    assert {r["doc_id"] for r in merkle.manifest(merkle.leaves(docs, told)).collect() if not r["verified"]} == set(range(0, 100, 10))


def test_a_missing_child_is_an_error(spark):
    with pytest.raises(ValueError):
        merkle._complete((("1en", 0), [(0, 3, b"a" * 32), (2, 3, b"b" * 32)]))


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_against_sql(spark, folder):
    names, rows = spark_rows(merkle.op12_merkle_manifest(spark, folder))
    want_names, want = sql_rows(connect(folder), merkle.ORACLE_SQL)
    assert names == want_names and rows == want
