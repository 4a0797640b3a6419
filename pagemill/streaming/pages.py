"""The same transformations over pages that keep arriving: they look at one page at a time, so no state and no watermark."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import extract

PAGES = "page_id long, url string, html string"


def classify_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Classifies the resources of every page that is in `folder` (Parquet) or will be, until what is there is done; `checkpoint` and `out` survive restarts."""
    arriving = spark.readStream.schema(PAGES).parquet(folder)
    return extract.classified(arriving).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
