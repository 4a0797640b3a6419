"""Operator 3: BPE through a table of distinct words.

Texts divide at white space, which no token of the tokenizer crosses. Each distinct word is encoded once and its ids are
joined back by position:

1. The most frequent words, at most HEAD, are encoded and broadcast. They have at most HEAD_CHARS characters, or LONG_CHARS
   where one word in COMMON is the same: 40 million characters at most.
2. Every other occurrence is a row (document, place among the document's rare words, word). These meet by word, so that each
   word is encoded once, and go on by document.
3. The documents go to that join as one variable-length code a word, 0 for the words of step 2, and are put together there.

Decoding looks pieces up by id in the id-to-piece table, which has the vocabulary's size: decode() is that join; digests()
looks up the ids of words before they go to the documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import common
from pagemill.llm.wordcache import load

HEAD, HEAD_CHARS, LONG_CHARS, COMMON = 3 << 17, 32, 2048, 10_000
TOKENIZER = "word_bpe_49k.json"

#: White space of the tokenizer's pattern; str.split() also divides at 0x1C to 0x1F.
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_HIGH = re.compile(r"[^\x00-˿]")


def words_of(text: str | None) -> list[str]:
    """The text's words, as keys of the table. Lower case where that can't change the ids: below U+0300 normalisation composes nothing, and no special token may be near."""
    if not text:
        return []
    if "<|" not in text and (text.isascii() or not _HIGH.search(text)):
        text = text.lower()
    return [w for w in _SPACE.split(text) if w] if _SEPARATORS.search(text) else text.split()


class Vocabulary:
    """The frequent words for the tasks, and their ids by code. Code 0 is for all other words. Arrow holds both; Python objects are made where a task needs them."""

    def __init__(self, words: list[str], ids: list[bytes]):
        self.words, self.packed = pa.array(words, pa.string()), pa.array([b"", *ids], pa.binary())

    @cached_property
    def codes(self) -> dict[str, int]:
        """Word to code; a Python worker keeps it as long as the broadcast."""
        return {w: i for i, w in enumerate(self.words.to_pylist(), 1)}

    @cached_property
    def ids(self) -> np.ndarray:
        """Ids by code, as objects."""
        return objects(self.packed.to_pylist())


def piece_table(tokenizer: str) -> np.ndarray:
    """Pieces by id, for tokenizers whose decoding puts a space between pieces."""
    tok = load(tokenizer)
    if json.loads(tok.to_str())["decoder"]:
        raise ValueError(f"{tokenizer} has a decoder of its own")
    return np.array([tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))], dtype=object)


def id_kind(tokenizer: str) -> type:
    return np.uint16 if load(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32


def encoder(tokenizer: str, kind: type) -> Callable[[list[str]], list[bytes]]:
    """Words to their ids as bytes; the tokenizer is loaded by the first call in each worker."""
    state: list = []

    def encode_words(words: list[str]) -> list[bytes]:
        tok = state[0] if state else (state.append(load(tokenizer)) or state[0])
        return [np.array(e.ids, kind).tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]

    return encode_words


def frequent_words(docs: DataFrame, tokenizer: str, most: int, kind: type) -> Vocabulary:
    """The head of the word table, of all texts of `docs` (text). A task reports words that are one in two million of its words, two at least; which words these are has no bearing on any result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                for text in b.column(0).slice(i, 500).to_pylist():
                    seen.update(words_of(text))
                if len(seen) > 250_000:
                    seen = Counter({w: n for w, n in seen.items() if n > 1})
        total = seen.total()
        few, many = max(2, total // 2_000_000), max(2, total // COMMON)
        kept = [(w, n) for w, n in seen.items() if n >= few and len(w) <= HEAD_CHARS or n >= many and len(w) <= LONG_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    counted = common.saved(docs.select("text").mapInArrow(common.frugal(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    top = counted.where((F.length("word") <= HEAD_CHARS) | (F.col("n") >= total / COMMON)).orderBy(F.desc("n"), "word").limit(most)
    of = encoder(tokenizer, kind)

    @F.pandas_udf("binary")
    def encode_words(words: pd.Series) -> pd.Series:
        return pd.Series(of(list(words)), dtype=object)

    rows = top.repartition(max(1, most // 16_384)).select("word", "n", encode_words("word").alias("ids")).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return Vocabulary(rows["word"].to_pylist(), rows["ids"].to_pylist())


def varints(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes below 2^21 in one to three bytes each, seven bits a byte, low first, the top bit set where more follow; and each one's length."""
    lens = 1 + (codes >= 1 << 7) + (codes >= 1 << 14)
    at = np.cumsum(lens) - lens
    out = np.empty(int(lens.sum()), np.uint8)
    for j in range(3):
        own = lens > j
        out[at[own] + j] = (codes[own] >> (7 * j) & 127) | np.where(lens[own] > j + 1, 128, 0)
    return out, lens


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes, and the place of the last byte of each."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    codes = data[starts].astype(np.int64) & 127
    for j in (1, 2):
        own = ends - starts >= j
        codes[own] |= (data[starts[own] + j].astype(np.int64) & 127) << (7 * j)
    return codes, ends


def encoded(docs: DataFrame, finish: Callable, schema: str, tokenizer: str = TOKENIZER, head_words: int = HEAD, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row of `docs` (doc_id, text; null: empty): doc_id and what `finish` makes of a few hundred documents, as columns of `schema`. It gets the head, the codes of
    all their words, where each document starts (and the last ends) in them, and where the rare words are with their ids.

    Rows that share doc_id and text are each encoded. A null doc_id stays null. The columns `carry` stay beside doc_id.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    # k and h tell documents apart; neither is null
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (F.struct(*carry) if carry else F.lit(0)).alias("carried"))
    carried = docs.schema["carried"].dataType.simpleString()
    docs = docs.withColumns({"k": F.coalesce("doc_id", F.lit(-1)), "h": F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")})
    if not docs.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").limit(1).count():
        docs = docs.withColumn("h", F.lit(0).cast("long"))  # k does alone, and shuffled rows are shorter
    kind = id_kind(tokenizer)
    head = spark.sparkContext.broadcast(frequent_words(docs, tokenizer, head_words, kind))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.codes
        for b in batches:
            for first in range(0, b.num_rows, 500):
                part, rows, at, words = b.slice(first, 500), [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    own = [w for w in words_of(text) if w not in known]
                    rows += repeat(i, len(own))
                    at += range(len(own))
                    words += own
                index = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("k").take(index), part.column("h").take(index), pa.array(at, pa.int32()), pa.array(words, pa.string())], names=["k", "h", "at", "word"])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.codes
        for b in batches:
            out = []
            for i in range(0, b.num_rows, 256):
                texts = [words_of(t) for t in b.column("text").slice(i, 256).to_pylist()]
                cuts = np.cumsum([0, *map(len, texts)])
                data, lens = varints(np.fromiter(map(known.get, chain.from_iterable(texts), repeat(0)), np.int64, cuts[-1]))
                data, cuts = data.tobytes(), np.concatenate(([0], np.cumsum(lens)))[cuts]
                out += [data[i:j] for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "carried", "k", "h")), pa.array(out, pa.binary())], names=["doc_id", "carried", "k", "h", "codes"])

    of = encoder(tokenizer, kind)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids for occurrences that are sorted by word: the ids of a word serve all of its rows."""
        last: tuple[str | None, bytes] = (None, b"")
        for b in batches:
            runs = pc.run_end_encode(b.column("word"))
            words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            ids = ([last[1]] if words[0] == last[0] else of(words[:1])) + of(words[1:]) if words else []
            last = (words[-1], ids[-1]) if words else last
            index = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), b.column("at"), pa.array(ids, pa.binary()).take(pa.array(index))], names=["k", "h", "at", "ids"])

    tail = docs.select("k", "h", "text").mapInArrow(common.frugal(rare), "k long, h long, at int, word string")
    salt = F.when(F.length("word") > LONG_CHARS, F.pmod(F.xxhash64("k", "h", "at"), F.lit(16))).otherwise(F.lit(0))  # longer words may be common and outside the head
    placed = tail.repartition("word", salt).sortWithinPartitions("word").mapInArrow(common.frugal(once), "k long, h long, at int, ids binary")
    # a set: rows that share doc_id and text bring the same places, which are kept once for all of them
    by_doc = placed.groupBy("k", "h").agg(F.collect_set(F.struct("at", "ids")).alias("rare"))
    joined = docs.mapInArrow(common.frugal(codes), f"doc_id long, carried {carried}, k long, h long, codes binary").join(by_doc.hint("merge"), ["k", "h"], "left").select("doc_id", "carried", "codes", F.col("rare.at").alias("at"), F.col("rare.ids").alias("ids"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                raw, rare_at, rare_ids = (b.column(c).to_pylist() for c in ("codes", "at", "ids"))
                codes, ends = from_varints(np.frombuffer(b"".join(raw), np.uint8))
                cuts = np.concatenate(([0], np.searchsorted(ends, np.cumsum([len(x) for x in raw]), side="left")))
                places = np.flatnonzero(codes == 0)
                first = np.searchsorted(places, cuts)
                own: list[bytes] = [b""] * len(places)
                for f, at, ids in zip(first, rare_at, rare_ids):
                    for k, x in zip(at or (), ids or ()):
                        own[f + k] = x
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("carried"), *finish(head.value, codes, cuts, places, own)], names=["doc_id", "carried", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    done = joined.mapInArrow(common.frugal(together), f"doc_id long, carried {carried}, {schema}")
    return done.select("doc_id", *(["carried.*"] if carry else []), *names)


def objects(items: list) -> np.ndarray:
    return np.array([*items, None], dtype=object)[:-1]


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and ids (array of int) of each row of `docs`."""
    kind = id_kind(tokenizer)

    def finish(head: Vocabulary, codes: np.ndarray, cuts: np.ndarray, places: np.ndarray, rare: list[bytes]) -> list[pa.Array]:
        words = head.ids[codes]
        words[places] = objects(rare)
        return [pa.array([np.frombuffer(b"".join(words[i:j]), kind).astype(np.int32) for i, j in zip(cuts, cuts[1:])], pa.list_(pa.int32()))]

    return encoded(docs, finish, "ids array<int>", tokenizer)


def pieces(spark: SparkSession, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, piece: the tokenizer's vocabulary."""
    return spark.createDataFrame([(i, p) for i, p in enumerate(piece_table(tokenizer).tolist())], "id int, piece string")


def decode(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and text of `rows` (doc_id, ids): the ids joined with their pieces and put together by position. Null ids, and an empty list, give an empty text; ids outside the vocabulary give nothing. Rows may repeat."""
    rows = common.saved(rows.select("doc_id", "ids"), "ids").withColumn("row", F.monotonically_increasing_id())  # numbered as they lie on disk
    placed = rows.select("row", F.posexplode("ids").alias("at", "id")).join(F.broadcast(pieces(rows.sparkSession, tokenizer)), "id")
    texts = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("found")).select("row", F.array_join("found.piece", " ").alias("text"))
    return rows.join(texts.hint("merge"), "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def joined_texts(table: pa.Array, index: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Entries of a table of texts, put together by spaces from each cut to the next."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), table.take(pa.array(index))), pa.scalar(" ", pa.large_string()))


def digests(docs: DataFrame, tokenizer: str = TOKENIZER, head_words: int = HEAD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns `carry`, n_tokens, ids_sha256 and decoded_sha256 for each row of `docs`: encode and decode without moving the ids again."""
    kind = id_kind(tokenizer)
    tables: list = []

    def counted(words: pa.Array) -> np.ndarray:
        """How many ids each word has."""
        return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize

    def joined(words: pa.Array, table: pa.Array) -> pa.Array:
        """For each word (its ids as bytes) the texts of its ids, with spaces between."""
        ends = np.concatenate(([0], np.cumsum(counted(words))))
        whole = b"".join(x for i in range(0, len(words), 10_000) for x in words.slice(i, 10_000).to_pylist())
        return joined_texts(table, np.frombuffer(whole, kind), ends)

    def finish(head: Vocabulary, codes: np.ndarray, cuts: np.ndarray, places: np.ndarray, rare: list[bytes]) -> list[pa.Array]:
        if not tables:
            by_id = piece_table(tokenizer)
            names = [pa.array(x, pa.large_string()) for x in ([str(i) for i in range(len(by_id))], by_id.tolist())]
            tables.extend([names, counted(head.packed), [joined(head.packed, x) for x in names]])
        names, counts, known = tables
        index = codes.copy()
        index[places] = len(counts) + np.arange(len(places))
        rare = pa.array(rare, pa.binary())
        n = np.concatenate((counts, counted(rare)))[index]
        sums = np.concatenate(([0], np.cumsum(n)))[cuts]
        if not n.all():  # words without ids leave no space either
            cuts, index = np.concatenate(([0], np.cumsum(n > 0)))[cuts], index[n > 0]
        sha = []
        for name, texts in zip(names, known):
            whole = joined_texts(pa.concat_arrays([texts, joined(rare, name)]), index, cuts)
            sha.append(pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in whole], pa.string()))
        return [pa.array(np.diff(sums), pa.int64()), *sha]

    return encoded(docs, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", tokenizer, head_words, carry)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLE_SQL: dict[str, str] = {}
