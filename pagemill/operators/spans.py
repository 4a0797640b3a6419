"""Intervals over source text: merged ones and outermost ones. Nulls stand last in every order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(spans: DataFrame) -> DataFrame:
    """file, start_pos, end_pos: touching and overlapping spans of a file as one."""
    order = Window.partitionBy("file").orderBy(F.asc_nulls_last("start_pos"), F.asc_nulls_last("end_pos"))
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("start_pos") > reach), 1).otherwise(0)
    islands = spans.withColumn("new", starts).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("file", "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("island")


def covered(spans: DataFrame) -> DataFrame:
    """file, covered: characters in spans that ran; files without any have 0."""
    ran = merged(spans.where("hits > 0")).groupBy("file").agg(F.sum(F.col("end_pos") - F.col("start_pos")).cast("long").alias("covered"))
    return spans.select("file").distinct().join(ran, "file", "left").select("file", F.coalesce("covered", F.lit(0).cast("long")).alias("covered"))


def outermost(spans: DataFrame) -> DataFrame:
    """Spans that lie in no earlier one: by start, the longest first."""
    order = Window.partitionBy("file").orderBy(F.asc_nulls_last("start_pos"), F.desc_nulls_last("end_pos"), F.asc_nulls_last("hits"))
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("reach", reach).where("reach IS NULL OR start_pos >= reach").drop("reach")
