"""Operator 4: exact dedup against a persistent digest index, DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import common


def digest(text: Column) -> Column:
    """SHA-256 (hex) of a text whose white-space runs became one space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    spaced = F.when(text.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(text, common.SPACE, " ")).otherwise(text)
    return F.sha2(spaced.cast("binary"), 256)


class DigestIndex:
    """A Parquet table of (digest, keep_id, n), bucketed and sorted by digest, in a shared folder.

    It outlives the session: opening the same folder with the same number of buckets attaches it again. Joins by digest
    read its buckets without a shuffle of the index.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.name = spark, f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id LONG, n LONG) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append the groups (digest, keep_id, n) whose digests the index doesn't hold: a sort-merge anti-join, the index's side from its buckets."""
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", "n").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Add the texts of `docs` (doc_id, text) to `index` and return per row doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the doc_id that the index keeps for the text: one of an earlier batch, else the smallest here; group_size
    counts the rows of the batch that first brought the text. Rows that repeat one doc_id and text are one document and
    share a verdict. A null doc_id never wins over another; where all are null, keep_id is null and the rows are kept.
    """
    slim = common.saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    groups = common.saved(slim.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "digest-groups")
    index.add(groups)
    known = index.table().withColumnRenamed("n", "group_size").join(groups.select("digest", F.col("n").alias("rows")).hint("merge"), "digest")
    found = common.join_facts(slim, common.saved(known, "known"), "digest", "rows")
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def new_index(docs: DataFrame) -> DigestIndex:
    """An empty index in a folder of its own, with a bucket for about two million rows of `docs`, 64 at least."""
    spark = docs.sparkSession
    return DigestIndex(spark, common.new_dir(spark, "digest-index"), max(64, docs.select("doc_id").count() // 2_000_000))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return dedup(docs, new_index(docs))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that dedup() keeps, with all their columns, whatever their names. Texts without any doc_id stay; an empty table stays empty."""
    dropped = dedup(docs, new_index(docs)).where("NOT kept").select("doc_id", "text_sha256").distinct()
    return common.without_keys(docs, common.saved(dropped, "dropped"), [F.col("doc_id").cast("long"), digest(F.col("text"))])


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)"""
}
