"""What the operators share: the shared folder, saved tables, range shards and committed files."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from pagemill.sources.batches import BATCH, frugal, give_back, small_batches  # noqa: F401 - the operators' own

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: the lineage ends here, and a lost executor costs a read."""
    path = new_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most rows of a few longs each that are broadcast; in a hash table about 100 bytes each, 50 MB in all.
SMALL = 500_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of `rows` with `facts`, which has one row for each key and, in the column `count`, about how many of `rows` have it. Keys aren't null.

    Keys with a thousandth of the rows and 10,000 rows at least are hot: there are at most 1,000 of them, so their facts
    are broadcast and their rows stay where they are. The other rows meet their facts by a shuffled join. `facts` is read
    three times: save it first.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in facts.where(F.col(count) >= max(10_000, total // 1000)).select(key).collect()]
    if not hot:
        return rows.join(facts.hint("merge"), key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(facts.where(~is_hot).hint("merge"), key).unionByName(rows.where(is_hot).join(F.broadcast(facts.where(is_hot)), key))


def _by_keys(rows: DataFrame, keys: DataFrame, on: list, how: str) -> DataFrame:
    names = [f"_key_{uuid.uuid4().hex}" for _ in keys.columns]
    condition = F.lit(True)
    for own, name in zip(on, names):
        condition &= (F.col(own) if isinstance(own, str) else own).eqNullSafe(F.col(name))
    return rows.join(keys.toDF(*names).hint("broadcast" if keys.count() <= SMALL else "merge"), condition, how)


def in_keys(rows: DataFrame, keys: DataFrame, on: list) -> DataFrame:
    """The `rows` whose values `on` (names or Columns) are a row of `keys` (longs; nulls equal nulls). `keys` is counted: up to SMALL are broadcast, more are shuffled."""
    return _by_keys(rows, keys, on, "left_semi")


def without_keys(rows: DataFrame, keys: DataFrame, on: list) -> DataFrame:
    """The other `rows`, see in_keys()."""
    return _by_keys(rows, keys, on, "left_anti")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; works in the driver and in tasks, for any store that pyarrow reads."""
    return pafs.FileSystem.from_uri(uri)


def remove_dir(uri: str) -> None:
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


# ---------------------------------------------------------------- range shards


#: Most shards of a range-sorted output. With more rows, shards grow.
MAX_SHARDS = 16_384


def range_bounds(df: DataFrame, key: str, weight: Column, target: int, max_shards: int = MAX_SHARDS) -> list[int]:
    """First keys of shards of about `target` weight each (of more, if there were more than `max_shards`), ascending; the same for the same rows, whatever their partitions.

    The keys' range is divided into cells of equal width, about four for each shard, whose weights reach the driver. A cell
    that outweighs the target is divided again, between its least and its greatest key, into as many cells as its weight
    asks for, so far-off keys cannot press the others into one shard: each time at most 6 * max_shards cells come. Null
    keys have no part in it.
    """
    slim = saved(df.select(F.col(key).cast("long").alias("k"), weight.cast("long").alias("w")).where("k IS NOT NULL"), "weights")
    lo, hi, total = slim.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    if lo is None:
        return [0]
    target = max(target, -(-total // max_shards))
    found, todo = [], [(lo, hi, total)]
    while todo:
        firsts = np.array([x[0] for x in todo], np.int64)
        lasts = np.array([x[1] for x in todo], np.int64)
        widths = np.array([max(1, -(-(last - first + 1) // max(2, 4 * w // target))) for first, last, w in todo], np.uint64)

        @F.pandas_udf("string")
        def cell_of(keys: pd.Series) -> pd.Series:
            k = keys.to_numpy(np.int64)
            i = np.maximum(np.searchsorted(firsts, k, side="right") - 1, 0)
            inside = (k >= firsts[i]) & (k <= lasts[i])
            cell = (k.view(np.uint64) - firsts[i].view(np.uint64)) // widths[i]
            return pd.Series([f"{a}:{b}" if ok else None for a, b, ok in zip(i.tolist(), cell.tolist(), inside.tolist())], dtype=object)

        cells = slim.groupBy(cell_of("k").alias("c")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("w").alias("w")).where("c IS NOT NULL").collect()
        todo = sorted((r.lo, r.hi, r.w) for r in cells if r.w > 2 * target and r.lo < r.hi)
        found += [(r.lo, r.w) for r in cells if not (r.w > 2 * target and r.lo < r.hi)]
    bounds, filled = [], 0
    for first, w in sorted(found):
        if not bounds or filled + w > target and filled:
            bounds.append(first)
            filled = 0
        filled += w
    return bounds


def in_shards(df: DataFrame, key: str, bounds: list[int], order: list[str], spread: list[str] | None = None) -> DataFrame:
    """Rows with the column `shard`, one shard a partition, sorted by `order` in it. Rows with a null key get as many shards again after the others, by a hash of the columns `spread` (else of all others)."""
    starts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(IntegerType())
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(starts, keys.to_numpy(np.int64), side="right") - 1, 0).astype(np.int32))

    n = len(bounds)
    others = spread or [c for c in df.columns if c != key]
    shard = F.when(F.col(key).isNull(), F.lit(n) + F.pmod(F.xxhash64(*others), F.lit(n)).cast("int")).otherwise(shard_of(F.coalesce(F.col(key).cast("long"), F.lit(0))))
    return df.withColumn("shard", shard).repartitionById(2 * n, F.col("shard")).sortWithinPartitions("shard", *order)


# ------------------------------------------------------------- committed files

WRITTEN = "shard int, seq int, temp string, name string, size long, n long, note string"


def commit(written: DataFrame, folder: str) -> None:
    """Publish the files that the tasks of `written` (rows of WRITTEN) left under temporary names.

    Every attempt of a task writes names of its own and only the attempt that Spark accepts reports them. They move to
    their final names in a Spark job that may be repeated, then the manifest, a Parquet table written by Spark, gets its
    name by a rename. Readers open only what the manifest lists; what lost attempts left is removed with the temporary
    folder. Nothing about single files reaches the driver.
    """
    spark = written.sparkSession
    written.write.parquet(f"{folder}/_temp/written")
    files = spark.read.schema(WRITTEN).parquet(f"{folder}/_temp/written")

    def publish(batches):
        for pdf in batches:
            for temp, name in zip(pdf["temp"], pdf["name"]):
                fs, final = filesystem(f"{folder}/{name}")
                if fs.get_file_info(final).type == pafs.FileType.NotFound:
                    fs.move(filesystem(temp)[1], final)
            yield pdf[["name"]]

    files.mapInPandas(publish, "name string").count()
    files.drop("temp").orderBy("shard", "seq").write.parquet(f"{folder}/_temp/manifest")
    fs, path = filesystem(folder)
    fs.move(f"{path}/_temp/manifest", f"{path}/manifest")
    remove_dir(f"{folder}/_temp")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """shard, seq, name, size, n (entries), note for each file of `folder`, in the order of shard and seq."""
    return spark.read.parquet(f"{folder}/manifest")


def temp_name(folder: str, name: str) -> str:
    """A name that no other attempt uses; its folder is made."""
    fs, path = filesystem(f"{folder}/_temp")
    fs.create_dir(path, recursive=True)
    return f"{folder}/_temp/{uuid.uuid4().hex}-{name}"
