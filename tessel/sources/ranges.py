"""Bounded sources: the indices of count elements, in partitions of about a wanted size, made on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def bundles(count: int, size: int, desired_bytes: int) -> list[tuple[int, int]]:
    """Ranges of elements of size bytes (0 counts as 1), each of about desired_bytes and one element at least."""
    if count < 0 or size < 0:
        raise ValueError(f"count and size must not be negative: {count}, {size}")
    step = max(1, desired_bytes // max(size, 1))
    return [(a, min(a + step, count)) for a in range(0, count, step)]


def range_source(spark: SparkSession, count: int, size: int, desired_bytes: int = 64 << 20) -> DataFrame:
    """index 0 to count - 1."""
    return spark.range(0, count, 1, max(1, len(bundles(count, size, desired_bytes)))).withColumnRenamed("id", "index")


def range_elements(spark: SparkSession, count: int, size: int, get_element: Callable[[int], dict], schema: str, desired_bytes: int = 64 << 20) -> DataFrame:
    """One row for each index, made by get_element on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [get_element(i) for i in batch.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return range_source(spark, count, size, desired_bytes).mapInArrow(run, schema)
