"""Operator 11: hard negatives by a two-dimensional block matrix product over shards of rows and chunks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import common

#: Least anchors and rows of a shard (a shard of large tables has eight times as many), and dimensions of a chunk. ANCHORS anchors are scored at a time.
ANCHORS, ROWS, DIMENSIONS = 128, 1024, 32
#: Bytes of a shard's vectors as longs, at most.
WIDEST = 4 << 20
#: Row groups of the shards' tables: a few shards each, so that they are read in parts.
GROUPS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4", "compression": "zstd"}
SHARD = "shard int, n int, ids binary, labels binary, width int, chunks array<binary>"
#: What is looked for: for the anchor at `place` of its shard, the first rows with a score of least to most. `of` is handed on.
WANTED = "array<struct<place:int,least:long,most:long,of:struct<anchor_id:long,positive_id:long,positive_score:long>>>"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether there is a vector without null or non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def quantized(rows: DataFrame, scale: int = 256, relabel: Column | None = None) -> DataFrame:
    """vec_id, label (long), vector (array of longs, floor(scale * x)) of the rows of `rows` (vec_id, embedding, label) that take part, one for each vec_id.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Of several rows with one
    vec_id the one with the least label, then the least vector, does. `relabel` replaces the label of rows that have one.
    """
    label = F.col("label").cast("long") if relabel is None else relabel.cast("long")
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(finite(F.col("embedding")))
    whole = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector")).alias("x"))
    return whole.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", "x.*")


def shards(rows: DataFrame, side: str, count: int, dimensions: int) -> DataFrame:
    """SHARD: the rows in `count` shards by a hash of vec_id, sorted by vec_id, each cut into chunks of DIMENSIONS, in the least width of whole numbers that has them. Missing dimensions are 0."""
    wide = -(-dimensions // DIMENSIONS) * DIMENSIONS

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        vectors = table["vector"].combine_chunks()
        whole = np.zeros((len(ids), wide), np.int64)
        whole[np.arange(wide)[None, :] < np.diff(vectors.offsets.to_numpy())[:, None]] = vectors.flatten().to_numpy()
        width = next(w for w in (2, 4, 8) if w == 8 or -(1 << 8 * w - 1) <= whole.min() and whole.max() < 1 << 8 * w - 1)
        chunks = [np.ascontiguousarray(whole[:, k : k + DIMENSIONS], f"i{width}").tobytes() for k in range(0, wide, DIMENSIONS)]
        out = {"shard": table["shard"][0].as_py(), "n": len(ids), "ids": ids.tobytes(), "labels": labels.tobytes(), "width": width, "chunks": chunks}
        return pa.Table.from_pylist([out], pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("chunks", pa.list_(pa.binary()))]))

    return rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(side)), F.lit(count)).cast("int")).groupBy("shard").applyInArrow(pack, SHARD)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact in 64 bits; OverflowError where a chunk's sums might reach 2^55, as 256 chunks could leave 64 bits then. Where all sums are whole numbers below 2^24 or 2^53, floats or doubles have them exactly, and faster."""
    largest = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    most = largest(a) * largest(b) * a.shape[1]
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    if most >= 1 << 55:
        raise OverflowError("inner products don't fit in 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def grid(rows: DataFrame, anchor: Column) -> tuple[DataFrame, DataFrame]:
    """SHARD: `anchor`s of `rows` (vec_id, label, vector; saved) and all `rows`, each as a saved table of shards, as many as the counts ask for.

    A shard of anchors and one of rows are a cell of the grid; their tile of scores is the sum of the products of their
    chunks (see found()). Tiles are made where they are searched and written nowhere, so what lies on disk grows with the
    rows, not with rows times anchors.
    """
    n, m, dimensions = rows.agg(F.count(F.lit(1)), F.count_if(anchor), F.max(F.size("vector"))).first()
    dimensions = max(1, dimensions or 0)
    bounded = lambda count, least, parts: max(1, -(-count // max(1, min(8 * least, max(least, count // parts), WIDEST // (8 * dimensions)))))
    spark = rows.sparkSession

    def side(some: DataFrame, tag: str, count: int) -> DataFrame:
        path = common.new_dir(spark, tag)
        shards(some, tag[0], count, dimensions).write.options(**GROUPS).parquet(path)
        return spark.read.schema(SHARD).parquet(path)

    return side(rows.where(anchor), "anchors", bounded(m, ANCHORS, 8)), side(rows, "rows", bounded(n, ROWS, 64))


def first_of(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Where the first `most` of each slot stand, by score, then by id; slots ascending."""
    order = np.lexsort((ids, -score, slot))
    at, own = np.arange(len(order)), slot[order]
    fresh = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    return order[at - np.maximum.accumulate(np.where(fresh, at, 0)) < most]


class Search:
    """The first `most` rows for each of the things wanted of a shard of anchors, among the shards of rows seen so far."""

    def __init__(self, shard: dict, same: bool, most: int):
        self.ids, self.labels = (np.frombuffer(shard[c], np.int64) for c in ("ids", "labels"))
        self.chunks, self.same, self.most = _chunks(shard), same, most
        wanted = sorted(shard["wanted"], key=lambda w: w["place"])
        place = np.array([w["place"] for w in wanted], np.int64)
        self.place, self.of = place, [w["of"] or {} for w in wanted]
        self.least, self.top = (np.array([w[c] for w in wanted], np.int64) for c in ("least", "most"))
        #: the wanted ones of each anchor, -1 where it has no more
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        self.slots = np.full((len(self.ids), int(rank.max(initial=-1)) + 1), -1)
        self.slots[place, rank] = np.arange(len(place))
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(3))  # slot, score, id
        #: score and id of the last one of each slot that has `most`: only what comes before it counts
        self.floor, self.floor_id = self.least.copy(), np.full(len(place), MOST)

    def see(self, shard: dict) -> None:
        ids, labels = (np.frombuffer(shard[c], np.int64) for c in ("ids", "labels"))
        chunks = _chunks(shard)
        for lo in range(0, len(self.ids), ANCHORS):
            part = slice(lo, lo + ANCHORS)
            asked = self.slots[part]
            there = asked >= 0
            if not there.any():
                continue
            tile = sum(product(a[part], b) for a, b in zip(self.chunks, chunks))
            bound = lambda v, none, f: f(np.where(there, v[asked], none), axis=1)[:, None]
            like = labels[None, :] == self.labels[part, None]
            x, y = np.nonzero((tile >= bound(self.floor, MOST, np.min)) & (tile <= bound(self.top, LEAST, np.max)) & (like if self.same else ~like))
            found = tile[x, y]
            apart = ids[y] != self.ids[part][x]
            x, y, found = x[apart], ids[y[apart]], found[apart]
            for slot in (asked[x, r] for r in range(asked.shape[1])):
                fits = (slot >= 0) & (found <= self.top[slot]) & ((found > self.floor[slot]) | (found == self.floor[slot]) & (y <= self.floor_id[slot]))
                self._keep(slot[fits], found[fits], y[fits])

    def _keep(self, *more: np.ndarray) -> None:
        if not len(more[0]):
            return
        slot, score, ids = (np.concatenate(x) for x in zip(self.kept, more))
        at = first_of(slot, score, ids, self.most)
        slot, score, ids = self.kept = slot[at], score[at], ids[at]
        last = np.flatnonzero(np.r_[slot[1:] != slot[:-1], True])
        full = last[np.diff(np.r_[-1, last]) == self.most]
        self.floor[slot[full]], self.floor_id[slot[full]] = score[full], ids[full]

    def result(self) -> pa.RecordBatch:
        slot, score, ids = self.kept
        of = lambda name: [self.of[s].get(name) for s in slot]
        columns = [self.ids[self.place[slot]], self.place[slot], of("positive_id"), of("positive_score"), ids, score]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=FOUND.replace(" long", "").split(", "))


FOUND = "anchor_id long, place long, positive_id long, positive_score long, vec_id long, score long"


def _chunks(shard: dict) -> list[np.ndarray]:
    return [np.frombuffer(c, f"i{shard['width']}").reshape(shard["n"], -1) for c in shard["chunks"]]


def found(anchors: DataFrame, rows: DataFrame, same: bool, most: int) -> DataFrame:
    """shard and FOUND: for each thing that `anchors` (SHARD and `wanted`, saved) want the first `most` other rows of the same label, or of other labels.

    Every shard of anchors meets every shard of `rows` (SHARD, saved) in a task that has a part of both tables. A task sends
    the best of its part only, at most `most` for each thing wanted.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> pa.RecordBatch:
            out = state.result()
            return pa.RecordBatch.from_arrays([pa.array([now] * out.num_rows, pa.int32()), *out.columns], names=["shard", *out.schema.names])

        for batch in batches:
            for i in range(batch.num_rows):
                own = lambda side, i=i, batch=batch: batch.column(side)[i].as_py()
                if batch.column("shard")[i].as_py() != now:
                    if state is not None:
                        yield done()
                    a = own("a")
                    now, state = a["shard"], Search(a, same, most)
                state.see(own("b"))
        if state is not None:
            yield done()

    common.small_batches(rows.sparkSession)
    a = anchors.select("shard", F.struct(*anchors.columns).alias("a"))
    cells = a.crossJoin(rows.select(F.struct(*rows.columns).alias("b")).hint("shuffle_replicate_nl"))
    return cells.mapInArrow(common.frugal(search), f"shard int, {FOUND}")


def positives(anchors: DataFrame, rows: DataFrame, most: int = 5) -> DataFrame:
    """shard, place, anchor_id, positive_id, positive_score: the first `most` other rows of each anchor's label, by score, then by vec_id."""
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("place"), F.lit(LEAST).alias("least"), F.lit(MOST).alias("most"), F.lit(None).alias("of")))
    best = found(anchors.withColumn("wanted", every.cast(WANTED)), rows, True, most)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("r", place).where(F.col("r") <= most).select("shard", F.col("place").cast("int").alias("place"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))


def negatives(anchors: DataFrame, rows: DataFrame, first: DataFrame, most: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of `first` (positives(), saved) the first `most` rows of other labels with low * positive_score <= 100 * score <= high * positive_score. A shard of anchors takes its positives along as one row."""
    exact = F.col("positive_score").cast("decimal(20,0)")
    held = lambda x: F.greatest(F.least(x, F.lit(MOST).cast("decimal(20,0)")), F.lit(LEAST).cast("decimal(20,0)")).cast("long")
    least, top = held(F.ceil(exact * low / 100)), held(F.floor(exact * high / 100))
    windows = first.withColumn("least", least).withColumn("most", top).where("least <= most")
    wanted = windows.groupBy("shard").agg(F.collect_list(F.struct("place", "least", "most", F.struct("anchor_id", "positive_id", "positive_score").alias("of"))).alias("wanted"))
    asking = common.saved(anchors.join(wanted.hint("merge"), "shard"), "asking")
    best = found(asking, rows, False, most).select("anchor_id", "positive_id", "positive_score", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(rows: DataFrame, anchor: Column, relabel: Column | None = None, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """Hard negatives of the rows of `rows` (vec_id, embedding, label, and others) for which `anchor` (of vec_id) holds; see quantized(), positives() and negatives().

    Scores are inner products of the quantized vectors, over the dimensions that both have. An anchor without other rows of
    its label, or a positive without rows in its window, has no rows in the result; so has an empty table. Products that
    might leave 64 bits are an error (see product()), as a sum of longs is. Ties go by vec_id.
    """
    anchors, every = grid(common.saved(quantized(rows, relabel=relabel), "quantized"), anchor)
    return negatives(anchors, every, common.saved(positives(anchors, every, n_positives), "positives"), n_negatives, low, high)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE_SQL = {"op11_hard_negatives": ORACLE}
