"""Memory of Python workers, which live on between tasks and stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch of texts, about: long texts then come few at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes an Arrow batch, if it is higher: ten thousand long texts don't fit a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = str(spark.conf.get(name)).lower().rstrip("b")
    if not known.isdigit() or int(known) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], pool: bool = True):
    """run, with batches allocated so that they go back to the system, and freed memory given back at the end.

    Without `pool` the allocator stays as it is: faster where many batches are made.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pool:
            pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        trim()

    return wrapped


def trim() -> None:
    """Give freed memory back to the system."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
