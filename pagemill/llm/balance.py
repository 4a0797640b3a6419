"""Operator 6: sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import common

def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, ascending by place (0 to 2^63 - 1). More shards leave these nodes where they are."""
    return sorted((int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:8], "big") >> 1, s) for s in range(shards) for v in range(nodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard: with slack, (1 + slack) times the mean; without, what makes counts differ by one at most."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def assign(counts: dict[int, int], nodes: list[tuple[int, int]], limits: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Rows (arc, first, last, shard, slot): which ranks (first to last, in the order of the ring) of each arc go to which shard, and the slot of the first.

    First every shard takes the rows of its own arcs, in the ring's order, as far as there is room. What is left of an arc
    continues clockwise, arc by arc around the ring, to the next node whose shard has room.
    """
    room, used, out, over = list(limits), [0] * len(limits), [], []

    def take(arc: int, first: int, n: int, shard: int) -> int:
        k = min(n, room[shard])
        if k:
            out.append((arc, first, first + k - 1, shard, used[shard]))
            room[shard] -= k
            used[shard] += k
        return k

    for arc in sorted(counts):
        if (k := take(arc, 0, counts[arc], nodes[arc][1])) < counts[arc]:
            over.append((arc, k, counts[arc] - k))
    nexts = list(range(1, len(nodes) + 1))  # clockwise over nodes, full ones skipped for good

    for arc, first, n in over:
        at = arc
        while n:
            seen = []
            while not room[nodes[at % len(nodes)][1]]:
                seen.append(at % len(nodes))
                at = nexts[at % len(nodes)]
            for x in seen:
                nexts[x] = at % len(nodes)
            k = take(arc, first, n, nodes[at % len(nodes)][1])
            first, n = first + k, n - k
    return out


def shard(rows: DataFrame, shards: int = 16, nodes: int = 64, slack: float = 0.0) -> DataFrame:
    """`rows` (doc_id, and other columns that tell rows with equal doc_id apart) with shard (int) and slot (long, gapless from 0 in each shard).

    A row's place on the ring is a hash of its doc_id, or of all its columns where that is null. The rows of an arc (between
    two virtual nodes) rank by place, then by their columns; an arc has a small share of the rows whatever the keys are.
    Only the counts of the shards * nodes arcs reach the driver, and as many ranges come back. Rows alike in every column
    are interchangeable. Columns of `rows` named shard or slot give way to the new ones; other names don't matter. Nulls
    are values like any other; an empty table stays empty.
    """
    spark = rows.sparkSession
    on_ring = ring(shards, nodes)
    places = [p for p, _ in on_ring]
    own_columns = [f"c{i}" for i in range(len(rows.columns))]
    spread = rows.toDF(*own_columns)
    doc_id = F.col(own_columns[rows.columns.index("doc_id")])
    own = F.when(doc_id.isNull(), F.xxhash64(*own_columns)).otherwise(F.xxhash64(doc_id))
    spread = spread.withColumn("_place", own.bitwiseAND(F.lit((1 << 63) - 1)))

    @F.pandas_udf("int")
    def arc_of(place):
        import numpy as np

        return type(place)((np.searchsorted(np.array(places, dtype=np.int64), place.to_numpy(), side="left") % len(places)).astype("int32"))

    spread = common.saved(spread.withColumn("_arc", arc_of("_place")), "ring")
    counts = {r["_arc"]: r["count"] for r in spread.groupBy("_arc").count().collect()}
    ranges = assign(counts, on_ring, capacities(sum(counts.values()), shards, slack))
    table = spark.createDataFrame([(a, f, (last, s, slot)) for a, f, last, s, slot in ranges], "_of long, _first long, _to struct<last:long,shard:int,slot:long>")
    ranked = spread.withColumn("_rank", F.row_number().over(Window.partitionBy("_arc").orderBy("_place", *own_columns)).cast("long") - 1)
    placed = ranked.join(F.broadcast(table), (F.col("_arc") == F.col("_of")) & F.col("_rank").between(F.col("_first"), F.col("_to.last")))
    shown = [F.col(new).alias(old) for new, old in zip(own_columns, rows.columns) if old not in ("shard", "slot")]
    return placed.select(*shown, F.col("_to.shard").alias("shard"), (F.col("_to.slot") + F.col("_rank") - F.col("_first")).alias("slot"))


def arc_of_place(places: list[int], place: int) -> int:
    return bisect_left(places, place) % len(places)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = common.table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_shards": op6_shards}
ORACLE_SQL: dict[str, str] = {}
