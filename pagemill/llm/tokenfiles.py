"""Operator 10: token ids in binary files, packed by Simple-8b.

A file holds one shard of documents in ascending doc_id order:

    magic "SIMPLE8B", then blocks, then tables, then the tables' place (unsigned 64-bit) and the magic again
    block: 64-bit words, each a 4-bit selector (top) and 60 bits of values, then the block's escaped values, 64 bits each
    tables: counts of blocks, documents and ids; per block its offset, words and escapes; per document its doc_id, whether
    the doc_id is null, and its number of ids

A block has BLOCK ids (the last one fewer), so any block unpacks alone. All numbers are little-endian.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import common
from pagemill.llm.wordcache import byte_bpe

#: Values in a word by selector, fixed by the code's design; selector 0: one escaped value.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([0] + [60 // n for n in COUNTS[1:]], dtype=np.int64)
BLOCK = 16_384
MAGIC = b"SIMPLE8B"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped values (both uint64) of at most BLOCK ids. Each word takes as many of the next ids as fit."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    padded = np.concatenate((ids, np.zeros(60, np.uint64)))  # beyond the block there are zeros
    selector = np.zeros(n, dtype=np.int64)
    largest, k = padded, 1  # of the k ids from each place on
    for s in range(14, 0, -1):  # from one value in a word to sixty: the last that fits stays
        more = int(COUNTS[s]) - k
        if more:
            largest, k = np.maximum(largest[: len(largest) - more], largest[more:]), k + more
        fits = largest[:n] < np.uint64(1 << int(BITS[s]))
        if k > 1 and not fits.any():
            break
        selector[fits] = s
    steps, starts, i = COUNTS[selector].tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    at = np.array(starts, dtype=np.int64)
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen[chosen > 0]):
        own = np.flatnonzero(chosen == s)
        for j in range(int(COUNTS[s])):
            words[own] |= padded[at[own] + j] << np.uint64(j * int(BITS[s]))
    return words, ids[at[chosen == 0]]


def unpack(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The n ids (uint64) that pack() got, selector by selector."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(words) else 0, dtype=np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == 0:
            out[at[own]] = escaped
            continue
        bits = int(BITS[s])
        mask = np.uint64((1 << bits) - 1)
        for j in range(int(COUNTS[s])):
            out[at[own] + j] = (words[own] >> np.uint64(j * bits)) & mask
    return out[:n]


class Writer:
    """Writes one file, block by block."""

    def __init__(self, uri: str):
        fs, path = common.filesystem(uri)
        self.out = fs.open_output_stream(path, compression=None)
        self.out.write(MAGIC)
        self.at, self.blocks, self.docs, self.pending, self.n = len(MAGIC), [], [], [], 0
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.pending.append(ids)
        self.waiting += len(ids)
        self.n += len(ids)
        if self.waiting >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            words, escaped = pack(ids[i : min(i + BLOCK, end)])
            self.out.write(words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes())
            self.blocks.append((self.at, len(words), len(escaped)))
            self.at += 8 * (len(words) + len(escaped))
        self.pending, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> int:
        self._flush(True)
        ids, null, counts = zip(*self.docs) if self.docs else ((), (), ())
        for x in (np.array([len(self.blocks), len(self.docs), self.n], "<u8"), np.array(self.blocks, "<u8").reshape(-1, 3), np.array(ids, "<i8"), np.array(null, "u1"), np.array(counts, "<u8")):
            self.out.write(x.tobytes())
        self.out.write(np.array([self.at], "<u8").tobytes() + MAGIC)
        self.out.close()
        return self.at


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's doc_id and ids (uint32), one block in memory at a time besides the document's own."""
    fs, path = common.filesystem(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if f.read_at(8, 0) != MAGIC or tail[8:] != MAGIC:
            raise ValueError(f"{uri} isn't a whole token file")
        start = int(np.frombuffer(tail, "<u8", 1)[0])
        tables = f.read_at(size - 16 - start, start)
        n_blocks, n_docs, total = (int(x) for x in np.frombuffer(tables, "<u8", 3))
        at = 24 + 24 * n_blocks
        blocks = np.frombuffer(tables, "<u8", 3 * n_blocks, 24).reshape(-1, 3).astype(np.int64)
        doc_ids = np.frombuffer(tables, "<i8", n_docs, at)
        null = np.frombuffer(tables, "u1", n_docs, at + 8 * n_docs)
        counts = np.frombuffer(tables, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        have, b = np.empty(0, np.uint32), 0
        for i in range(n_docs):
            parts, need = [have], int(counts[i]) - len(have)
            while need > 0:
                offset, w, e = (int(x) for x in blocks[b])
                raw = np.frombuffer(f.read_at(8 * (w + e), offset), "<u8")
                ids = unpack(raw[:w], raw[w:], min(BLOCK, total - b * BLOCK)).astype(np.uint32)
                parts.append(ids)
                need -= len(ids)
                b += 1
            whole = np.concatenate(parts) if len(parts) > 1 else have
            yield (None if null[i] else int(doc_ids[i])), whole[: counts[i]]
            have = whole[counts[i] :]


def write(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end_id: int | None = 0, shard_bytes: int = 24 << 20) -> None:
    """Encode the texts of `docs` (doc_id, text; null: empty), append `end_id` to each and write shard files to `folder`, a shared folder.

    Shards hold about `shard_bytes` of UTF-8 text and cover ascending ranges of doc_id; rows that share a doc_id stand by
    their texts, rows without one come last. The files are the same for the same rows.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = common.range_bounds(docs, "doc_id", F.octet_length("text") + 1, shard_bytes)
    rows = common.in_shards(docs, "doc_id", bounds, ["doc_id", "text"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, temp, found = None, None, "", []
        end = np.array([] if end_id is None else [end_id], np.uint32).tobytes()

        def close() -> None:
            size = out.close()
            found.append({"shard": shard, "seq": 0, "temp": temp, "name": f"tokens-{shard:06d}.s8b", "size": size, "n": out.n, "note": ""})

        for batch in batches:
            bpe = byte_bpe(tokenizer)
            for doc_id, text, s in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("shard").to_pylist()):
                if s != shard:
                    if out:
                        close()
                    shard, temp = s, common.temp_name(folder, f"tokens-{s:06d}.s8b")
                    out = Writer(temp)
                out.add(doc_id, np.frombuffer(bpe.ids(text) + end, np.uint32))
        if out:
            close()
        if found:
            yield pa.RecordBatch.from_pylist(found, pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("n", pa.int64()), ("note", pa.string())]))

    common.commit(rows.mapInArrow(common.frugal(put), common.WRITTEN), folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The files of `folder`, a task each: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    order = Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a file for each shard: 2 * MAX_SHARDS rows at most
    listed = common.manifest(spark, folder).select(F.concat(F.lit(f"{folder}/"), "name").alias("path"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["before"]):
                rows = []
                for doc_id, ids in read_file(path):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 50_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return listed.repartition(max(1, listed.count()), "path").mapInPandas(get, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_dir(spark, "tokens")
    write(common.table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)


QUERIES = {"op10_token_files": op10_token_files}
ORACLE_SQL: dict[str, str] = {}
