"""Python workers with bounded memory: batches are cut by bytes, and what a task has freed goes back to the system."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

#: A batch that goes to a worker is closed at so many bytes; without it 10,000 long texts would be one batch.
BATCH_BYTES = 8 << 20
_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Arrow's pool and the C library keep freed memory for themselves; a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, made: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(made, schema); batches have BATCH_BYTES at most, or one row. A smaller setting of the session stays."""
    spark = df.sparkSession
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_CONF, str(BATCH_BYTES))

    def held(batches):
        try:
            yield from made(batches)
        finally:
            give_back()

    return df.mapInArrow(held, schema)
