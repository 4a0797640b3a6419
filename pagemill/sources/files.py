"""Saved sites as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def site_files(spark: SparkSession, folder: str) -> DataFrame:
    """site_id, rel_path, ext, size, content of every file below `folder`/<site>/; what lies under _quarantine is left out, files that go meanwhile are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(folder)
    root = folder.rstrip("/").split("://")[-1]
    below = F.regexp_extract(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), f"\\Q{root}\\E/(.*)$", 1)
    rows = found.select(F.regexp_extract(below, "^([^/]+)/", 1).alias("site_id"), F.regexp_extract(below, "^[^/]+/(.*)$", 1).alias("rel_path"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))
    return rows.where(~F.col("rel_path").startswith("_quarantine/")).withColumn("ext", F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)))


def write_changelog(changes: DataFrame, path: str) -> None:
    """Lines 'file | type | description | snippet | line', '-' for what is missing."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("file", "type", "description", "snippet", "line")]
    changes.select(F.concat_ws(" | ", *parts).alias("value")).write.text(path)
