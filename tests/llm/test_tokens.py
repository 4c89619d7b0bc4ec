import random
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marquee.llm import idcoder, tokens
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary_path())


def brute(rows, tokenizer):
    """doc_id, start, n_tokens, crc of rows in order."""
    out, at = [], 0
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


TEXTS = ["", None, " \n\t ", "Hello, World. 3.14,5 a.b,c ... ,. x.", "ÀÉÎ İstanbul ẞ straße ΣΑΣ ǅ ﬁ", "don't it's o'clock we'll", "😀🇳🇱 á ​ x y z", "1234567890 0x1F <|endoftext|> <|startoftext|>", "中文字符 かな 한국어 العربية", "a" * 5000, "...!!!???---___", "e.g. U.S.A., etc.,", "A\x00B\x1fC", "word. word, word . , wôrd. été,été."]


def test_ids_are_the_tokenizers(documents, tokenizer, spark):
    rows = list(enumerate(TEXTS))
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.stored_digest(documents(rows)).collect())
    assert found == brute(rows, tokenizer)


def unlike(texts, tokenizer):
    """Texts whose ids are not the tokenizer's."""
    ids, n = tokens.WordIds(tokens.vocabulary_path()).encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for t, a, b, w in zip(texts, ends - n, ends, want) if ids[a:b].tolist() != w.ids]


@pytest.mark.parametrize("category", "LMN")
def test_every_letter_mark_and_number(category, tokenizer):
    chars = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == category]
    assert unlike([f"a{c}.b{c},{c}. x{c}{c}.{c}'s" for c in chars], tokenizer) == []


PIECES = [*"abcXYZ  ..,,'\"<>||\n\t-:!?019éÉßİıΣ\u0301\u0307\u0338 \x1c\x85\u2003😀中한ᄀ가ﬁǅ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "'s", "'LL", "<|", "|>", "I've", "U.S.A."]


def test_mixed_up_texts(tokenizer):
    rng = random.Random(5)
    assert unlike(["".join(rng.choices(PIECES, k=rng.randint(0, 60))) for _ in range(5000)], tokenizer) == []


def test_long_run_and_upper_case_special(tokenizer):
    assert unlike(["<|ENDOFTEXT|>", "<|EndOfText|>.", "İ.", "İ,", "x" * 50_000 + ".", "ab." * 20_000, "<|endoftext|>" * 500], tokenizer) == []


def test_words_are_learned_without_their_signs():
    """A word is asked for once, whatever signs follow it."""
    words = tokens.WordIds(tokens.vocabulary_path())
    words.encode(pa.array(["anat*** anat!! anat%%% ANAT, anat@anat.", "élan### élan it's"]))
    assert sorted(words.known.to_pylist()) == sorted(["anat", "***", "!!", "%%%", ",", "@anat", ".", "élan", "###", "it's"])


def test_every_sign_behind_every_letter(tokenizer):
    letters = [c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº"]
    signs = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    assert unlike([f"{a}{s}{b}" for a in letters for s in signs for b in ("", "x", "'s", "\u0338 ", "|>", "é.B")], tokenizer) == []
    assert unlike([f"<| {a}{b} {b}{a}{b} {a}." for a in letters for b in letters], tokenizer) == []


def test_chunks_that_came_again_are_kept(tokenizer):
    words = tokens.WordIds(tokens.vocabulary_path(), most=4)
    steps = [
        ("one two three four five!", ["one", "two", "three", "four", "five", "!"]),
        ("two five six", ["two", "five", "six"]),  # none had come again
        ("five Seven eight", ["two", "five", "six", "seven", "eight"]),
        ("one five nine ten", ["five", "one", "nine", "ten"]),
    ]
    for text, known in steps:
        ids, n = words.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]
        assert words.known.to_pylist() == known


def test_small_pages_and_ids_back(documents, tokenizer, spark, tmp_path):
    rows = [(i * 3, "alpha beta gamma delta " * (i % 7) + f"Number{i}.") for i in range(200)]
    at = f"file://{tmp_path}/pages"
    tokens.write_tokens(documents(rows), at, page_ids=64)
    assert tokens.read_pages(spark, at).count() > 20
    found = {r["doc_id"]: (r["start"], r["ids"]) for r in tokens.read_tokens(spark, at).collect()}
    start = 0
    for i, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, tokens.END]
        assert found[i] == (start, ids)
        start += len(ids)


def test_odd_rows(documents, odd_rows, spark):
    found = tokens.stored_digest(documents(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    spans = sorted((r["start"], r["n_tokens"]) for r in found)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_empty_table(documents):
    assert tokens.stored_digest(documents([])).collect() == []


@pytest.mark.parametrize("kind", ["empty", "one", "same", "zipf", "all", "runs", "top"])
def test_coder_round_trip(kind):
    rng = np.random.default_rng(4)
    ids = {
        "empty": np.zeros(0, np.uint16),
        "one": np.array([65534], np.uint16),
        "same": np.full(10_001, 7, np.uint16),
        "zipf": (rng.zipf(1.2, 50_000) % 49_000).astype(np.uint16),
        "all": rng.permutation(65_535).astype(np.uint16),
        "runs": np.repeat(rng.integers(0, 300, 900), rng.integers(1, 90, 900)).astype(np.uint16),
        "top": rng.integers(65_000, 65_535, 4097).astype(np.uint16),
    }[kind]
    header, blocks = idcoder.encode_page(ids)
    assert len(blocks) == -(-len(ids) // idcoder.BLOCK)
    assert (idcoder.decode_blocks(header, blocks) == ids).all()
    if kind in ("same", "runs"):
        assert sum(map(len, blocks)) < len(ids) / 2


def test_fewer_bits_than_order_0():
    """Ids with repeated phrases take fewer bits than their frequencies alone would."""
    rng = np.random.default_rng(3)
    phrases = [rng.integers(0, 3000, 12) for _ in range(300)]
    ids = np.concatenate([phrases[k] for k in rng.integers(0, 40, 5000)]).astype(np.uint16)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    header, blocks = idcoder.encode_page(ids)
    assert 8 * sum(map(len, blocks)) / len(ids) < 0.8 * entropy
    assert (idcoder.decode_blocks(header, blocks) == ids).all()


def test_blocks_stand_alone_and_are_checked():
    rng = np.random.default_rng(9)
    ids = (rng.zipf(1.3, 9000) % 30_000).astype(np.uint16)
    header, blocks = idcoder.encode_page(ids)
    for i, b in enumerate(blocks):
        assert (idcoder.decode_blocks(header, [b]) == ids[i * idcoder.BLOCK : (i + 1) * idcoder.BLOCK]).all()
    broken = bytearray(blocks[2])
    broken[40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        idcoder.decode_blocks(header, [blocks[0], bytes(broken)])
    with pytest.raises(ValueError):
        idcoder.encode_page(np.array([65_535]))


def test_documents(spark, tokenizer):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.op4_token_ids(spark, SMALL).collect())
    assert found == brute(rows, tokenizer)
