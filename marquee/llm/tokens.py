"""Op 4, token-ID output: whole texts to ids in pages of independently coded blocks, and back.

Written files: a Parquet table, one row a page, ordered by page within a shard::

    shard, page      place of the page; shards follow each other in ascending document order
    doc_id, n_tokens arrays, one element a document of the page, in ascending order
    header           ids of the page by frequency (see idcoder)
    blocks           coded blocks, each with its length and checksum

A document lies in one page.  A page holds up to PAGE ids (or one longer document), so a task
works in memory that does not depend on the size of its partition.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, give_back, table
from .idcoder import decode_blocks, encode_page

if TYPE_CHECKING:
    from tokenizers import Tokenizer

PAGE = 1 << 22
END = 2
VOCABULARY, END_OF_WORD = "word_bpe_49k.json", "</w>"
#: Letters behind which a text may be cut before one of SIGNS (insides of character classes), and what special tokens begin with.
#: Signs are those of ASCII but the apostrophe, which begins endings, and those of special tokens' names.
LETTERS, SIGNS, SPECIAL = "A-Za-zÀ-ÖØ-öø-ÿ", r"!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~", "<|"
_PAGES = "shard int, page int, doc_id array<bigint>, n_tokens array<bigint>, header binary, blocks array<binary>"
_held: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def of_words(tokenizer: Tokenizer) -> Tokenizer:
    """A tokenizer of the same vocabulary for lower-case words of LETTERS, each followed by a space: one run of merges for all.

    The normalizer leaves such words as they are, and the pattern takes each whole, so both are left out.  Word ends of
    the vocabulary are written as the sign for a space: it is merged with the letter before it ahead of all else, as if it
    had always been one with it, and no merge goes on behind a word end.  So the ids are those of each word alone.
    """
    settings = json.loads(tokenizer.to_str())
    model, space = settings["model"], "Ġ"
    if model["end_of_word_suffix"] != END_OF_WORD or any(END_OF_WORD in a or space in a + b for a, b in model["merges"]):
        raise ValueError("not a vocabulary of words with ends")
    ends = [[t, space] for t in model["vocab"] if len(t) == 1]
    model["merges"] = ends + [[a, b.replace(END_OF_WORD, space)] for a, b in model["merges"]]
    model["vocab"] = {t.replace(END_OF_WORD, space): i for t, i in model["vocab"].items()}
    model["end_of_word_suffix"] = None
    byte_level = settings["pre_tokenizer"]["pretokenizers"][-1]
    return type(tokenizer).from_str(json.dumps(settings | {"normalizer": None, "pre_tokenizer": byte_level, "added_tokens": []}))


class WordIds:
    """Ids of white-space separated chunks; the tokenizer is asked once for each distinct chunk.

    White space never takes part in a token of this vocabulary, and neither does the border between a letter of
    ``LETTERS`` and a following sign of ``SIGNS``, so a text's ids are those of its chunks in order.  (Behind other
    letters that need not hold: the tokenizer's lower-casing makes a letter and a mark of some, and a mark goes with
    the sign.)  What the tokenizer was asked is kept for later batches; beyond ``most`` chunks those that did not come
    again are forgotten.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.of_words = of_words(self.tokenizer)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(END_OF_WORD)]] = True
        self.known, self.again = pa.array([], pa.string()), np.zeros(0, bool)
        self.ids, self.ends = np.zeros(0, np.uint16), np.zeros(1, np.int32)

    def _forget(self) -> None:
        """Keeps the chunks that came again, unless they are too many themselves."""
        keep = self.again if np.count_nonzero(self.again) <= self.most // 2 else np.zeros(len(self.again), bool)
        n = np.diff(self.ends)
        self.ids, self.ends = self.ids[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep], dtype=np.int32)]).astype(np.int32)
        self.known = self.known.filter(pa.array(keep))
        self.again = np.zeros(len(self.known), bool)

    def _learn(self, new: pa.Array) -> None:
        of_letters = pc.match_substring_regex(new, f"^[{LETTERS}]+$")
        words, other = (new.filter(x).to_numpy(zero_copy_only=False).tolist() for x in (of_letters, pc.invert(of_letters)))
        # many words make one text, whose ids are cut behind each word end
        runs = [" ".join([*words[k : k + 100], ""]).lower() for k in range(0, len(words), 100)]
        ids = [np.asarray(self.of_words.encode_batch_fast([run], add_special_tokens=False)[0].ids, np.uint16) for run in runs]
        counts = [np.diff(np.flatnonzero(self.last[np.concatenate(ids)]), prepend=-1)] if ids else []
        for k in range(0, len(other), 1000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(other[k : k + 1000], add_special_tokens=False)]
            ids.append(np.fromiter((i for g in got for i in g), np.uint16))
            counts.append(np.array([len(g) for g in got]))
        self.known = pa.concat_arrays([self.known, pa.array(words + other, pa.string())])
        self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        self.ids, self.ends = np.concatenate([self.ids, *ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))]).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        # the tokenizer lower-cases too, but for the names of special tokens; doing it for ASCII here makes fewer chunks
        lowered = pc.if_else(pc.match_substring(texts, SPECIAL), texts, pc.ascii_lower(texts))
        chunks = pc.ascii_split_whitespace(pc.replace_substring_regex(lowered, f"([{LETTERS}])([{SIGNS}])", r"\1 \2"))
        flat = chunks.flatten().dictionary_encode()
        names = flat.dictionary
        if len(self.known) > self.most:
            self._forget()
        place = pc.index_in(names, value_set=self.known)
        missing = place.null_count
        place = pc.fill_null(place, -1).to_numpy().copy()
        self.again[place[place >= 0]] = True
        if missing:
            new, first = names.filter(pa.array(place < 0)), len(self.known)
            self._learn(new)
            place[place < 0] = pc.index_in(new, value_set=self.known.slice(first)).to_numpy() + first
        which = place[flat.indices.to_numpy(zero_copy_only=False)]
        start = self.ends[which]
        n = self.ends[which + 1] - start
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int32)])
        take = np.arange(total[-1], dtype=np.int32)
        take += np.repeat(start - total[:-1], n.astype(np.intp))
        bounds = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        return self.ids[take], np.diff(total[bounds])


def tokenizer_from(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """This process's encoder for a vocabulary file."""
    if path not in _held:
        _held[path] = WordIds(path)
    return _held[path].encode


def _slices(batch: pa.RecordBatch, most: int = 3 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut where texts add up to ``most`` bytes (a longer text is a slice of its own)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _pages(path: str, end: int, page_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, page = TaskContext.get().partitionId(), 0
        docs, counts, ids, held = [], [], [], 0
        encode = tokenizer_from(path)

        def emit():
            nonlocal page, docs, counts, ids, held
            header, blocks = encode_page(np.concatenate(ids))
            row = {"shard": shard, "page": page, "doc_id": docs, "n_tokens": counts, "header": header, "blocks": blocks}
            page, docs, counts, ids, held = page + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow_pages())

        for batch in batches:
            for part in _slices(batch):
                got, n = encode(pc.fill_null(part.column("text"), "").cast(pa.string()))
                at = 0
                for doc, m in zip(part.column("doc_id").to_pylist(), n.tolist()):
                    if held and held + m + 1 > page_ids:
                        yield emit()
                    docs.append(doc)
                    counts.append(m + 1)
                    ids.append(np.append(got[at : at + m], np.uint16(end)))
                    at, held = at + m, held + m + 1
        if docs:
            yield emit()
        give_back()

    return write


def _arrow_pages() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("header", pa.binary()), ("blocks", pa.list_(pa.binary()))])


def write_tokens(docs: DataFrame, out: str, vocabulary: str | None = None, end: int = END, page_ids: int = PAGE) -> None:
    """Writes the ids of ``docs`` (doc_id, text; other columns are not read) to ``out``.

    Null text counts as empty: the document has its end id alone.  Documents go in ascending doc_id order, null
    ids first; rows with one id are all kept, ordered by a hash of their text.  An empty table writes no page.
    """
    path = vocabulary or vocabulary_path()
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ranged.select("doc_id", "text").mapInArrow(_pages(path, end, page_ids), _PAGES).write.mode("overwrite").parquet(out)


def read_pages(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(_PAGES).parquet(at)


def page_starts(pages: DataFrame) -> DataFrame:
    """(shard, page, base): ids of all pages before each; one row a shard is summed up in one place, pages within their shard."""
    sums = pages.select("shard", "page", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_base"))
    within = sums.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy("page")) - F.col("n"))
    return within.join(before, "shard").select("shard", "page", (F.col("base") + F.col("shard_base")).alias("base"))


def _read(digest: bool):
    import zlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("doc_id", "n_tokens", "header", "blocks", "base")}
                ids = decode_blocks(row["header"], row["blocks"])
                at = np.concatenate([[0], np.cumsum(row["n_tokens"])]).astype(np.int64)
                cols = [pa.array(row["doc_id"], pa.int64()), pa.array(at[:-1] + row["base"]), pa.array(row["n_tokens"], pa.int64())]
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cols.append(pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
        give_back()

    return read


def read_tokens(spark: SparkSession, at: str, digest: bool = False) -> DataFrame:
    """What ``write_tokens`` wrote: doc_id, start, n_tokens and ids (or with ``digest`` their CRC-32)."""
    pages = read_pages(spark, at)
    based = pages.join(page_starts(pages), ["shard", "page"]).select("doc_id", "n_tokens", "header", "blocks", "base")
    last = "ids_crc32 bigint" if digest else "ids array<int>"
    return based.mapInArrow(_read(digest), f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digest(table(spark, sf_dir, "documents"))


def stored_digest(docs: DataFrame) -> DataFrame:
    """Writes ids to a folder of the shared place and returns the digest columns read from its files."""
    at = Scratch(docs.sparkSession).path("token-pages", keep=True)
    write_tokens(docs, at)
    return read_tokens(docs.sparkSession, at, digest=True)
