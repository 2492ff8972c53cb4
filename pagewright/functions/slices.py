"""Rows of an Arrow UDF made and handed on in slices, so that a task holds few of them, whatever Spark's batches are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: What is made before it is handed on: so many rows, or fewer of so many characters.
SLICE_ROWS, SLICE_BYTES = 64, 1 << 20

#: Rows that Spark hands to a worker at once: pages may be long, so its 10,000 would be too many.
BATCH_ROWS = "1024"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def sliced(kind: pa.DataType, made: Callable, *columns: pa.Array) -> Iterator[pa.Array]:
    """``made`` of each row of equally long columns, the first of which holds texts, as arrays of ``kind``."""
    out: list = []
    size = 0
    for values in zip(*columns, strict=True):
        plain = [v.as_py() for v in values]
        out.append(made(*plain))
        size += len(plain[0] or "")
        if len(out) == SLICE_ROWS or size >= SLICE_BYTES:
            yield pa.array(out, kind)
            out, size = [], 0
    if out:
        yield pa.array(out, kind)
