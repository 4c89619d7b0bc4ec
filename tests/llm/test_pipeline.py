import zlib
from collections import Counter

import numpy as np
from brute import near_duplicates
from tokenizers import Tokenizer

import corpus_pipeline
from marquee.llm import tokens
from tests.conftest import SMALL


def test_stages_follow_each_other(spark):
    """Each stage on what the one before kept, against plain versions where there are some, and the whole against run()."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SMALL)
        assert out.columns == columns, name
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [Counter(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]
    assert set(ids[1]) < set(ids[0]) and len(ids[1]) > 0.6 * len(ids[0])
    rows = [(r["doc_id"], r["text"]) for r in kept[1].collect()]
    assert set(ids[2]) == {i for i, (_, c) in near_duplicates(rows, 80).items() if i == c}
    assert set(ids[3]) <= set(ids[2]) and len(ids[3]) > 0.8 * len(ids[2])
    assert set(ids[4]) == set(ids[3]) and max(ids[4].values()) <= 2
    # the stored ids are those of every drawn text
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())

    def digest(text):
        found = [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END]
        return len(found), zlib.crc32(np.array(found, "<u4").tobytes())

    want = Counter((r["doc_id"], *digest(r["text"])) for r in kept[4].collect())
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def prose(k, n=80):
    rng = np.random.default_rng(k)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(n)) + "."


def test_rows_that_share_or_lack_an_id(spark):
    """Nothing is lost that a stage did not reject, and no row is multiplied."""
    texts = [prose(k) for k in range(8)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, component int, n int"
    of = lambda i, t, s="web": (i, t, "en", s, len(t or ""), "x", 7, 3)
    rows = [of(1, texts[0]), of(1, texts[0]), of(1, texts[1]), of(None, texts[2]), of(None, texts[3]), of(None, texts[3]), of(2, texts[4]), of(3, texts[4]), of(None, texts[4])]
    rows += [of(4, texts[5], None), of(5, None), of(5, ""), of(None, None), of(6, "short"), of(7, texts[6] + " " + "same line\n" * 300)]
    docs = spark.createDataFrame(rows, columns).repartition(4)
    (_, rules), (_, near), (_, clean), (_, mix), _ = corpus_pipeline.STAGES
    key = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    kept = rules(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = Counter((r[0], r[1]) for r in rows[:10])
    assert key(kept) == want
    # without the rules: equal rows and equal texts leave one row, of the smallest id; rows without words are in no group
    out = near(spark, docs, SMALL)
    assert out.columns == docs.columns
    one = Counter({(1, texts[0]): 1, (1, texts[1]): 1, (None, texts[2]): 1, (None, texts[3]): 1, (2, texts[4]): 1, (4, texts[5]): 1})
    rest = Counter((r[0], r[1]) for r in rows[10:])
    assert key(out) == one + rest
    assert key(clean(spark, docs, SMALL)) == Counter((r[0], r[1]) for r in rows)
    # one source is seen twice at most, the others' rows once each
    drawn = key(mix(spark, docs, SMALL))
    assert all(n <= drawn[k] <= 2 * n for k, n in Counter((r[0], r[1]) for r in rows).items()) and set(drawn) == {(r[0], r[1]) for r in rows}
    assert all(drawn[k] == n for k, n in Counter((r[0], r[1]) for r in rows if r[3] == "web").items())


def test_contaminated_rows_go_alone(spark):
    """Of rows that share an id, or lack one, only those with a benchmark passage go."""
    (item,) = spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("text IS NOT NULL").orderBy("item_id").select("text").head(1)
    rows = [(1, prose(1) + " " + item["text"], "en", "web", 9), (1, prose(2), "en", "web", 9), (None, prose(3) + " " + item["text"], "en", "web", 9), (None, prose(4), "en", "web", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.decontamination_stage(spark, docs, SMALL).collect()
    assert sorted(r["text"] for r in out) == sorted([rows[1][1], rows[3][1]])


def test_any_column_names(spark):
    """Names with dots, backquotes and spaces come through every stage that keeps rows."""
    rows = [(i, prose(i), "en", "web", 9, i, "x", 2.5) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` int, `c``d` string, `of row` double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns[5:] == ["a.b", "c`d", "of row"], name
    assert {tuple(r)[5:] for r in docs.collect()} == {r[5:] for r in rows}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == [], name


def test_stage_list():
    assert len(corpus_pipeline.STAGES) == 5
