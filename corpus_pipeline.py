"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bpe, common, exactdedup, mixing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, calls toxic go. Null and empty texts are judged like any other."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after white space is made one) the smallest doc_id stays; null texts equal empty ones."""
    return exactdedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a five-word Jaccard similarity of 0.8 the smallest doc_id stays; texts without words are one group."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' mix: documents repeat or go as their source's target says, and stand in training order."""
    return mixing.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, part and row (where the document stands in the training order: by part, then by row), n_tokens and the digests of ids and decoded text, a row for each document of the mix. `docs` is read from the files that the mix was written to, whose order is the training order."""
    file = docs.metadataColumn("_metadata")  # not a column of that name
    part = F.regexp_extract(file["file_name"], r"part-(\d+)", 1).cast("int").alias("part")
    return bpe.digests(docs.select("doc_id", "text", part, file["row_index"].alias("row")), carry=("part", "row"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: None: SQL can express neither the classifier nor SimHash nor BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), "stage-" + "-".join(name.lower().split()))
    return docs
