"""What goes to Python workers at a time, and what they keep when a task ends."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows and bytes that go to Python at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """From now on texts of this session go to Python in batches of BATCH, unless smaller ones are set: the JVM, its buffers and the worker each hold one."""
    for name, most in BATCH.items():
        own = spark.conf.get(name)
        if not own.isdigit() or not 0 < int(own) <= int(most):
            spark.conf.set(name, most)


def frugal(function):
    """A function over batches for mapInArrow, at whose end the task's memory goes back to the system: workers live on and hold it otherwise while later stages run."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """What Python, Arrow and the C library have freed and still hold goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, rows: int = 256, size: int = 256 << 10) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `size` bytes of the strings in `column` (where there is one); a row that has more is a slice of its own. What Python makes of a slice is bounded by the longest row, not by the batch."""
    known = column in batch.schema.names
    sizes, first, held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist() if known else [0] * batch.num_rows, 0, 0
    for i, n in enumerate(sizes):
        if i > first and (i - first == rows or held + n > size):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield batch.slice(first)
