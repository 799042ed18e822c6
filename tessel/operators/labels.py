"""Names of stages: what Spark's pages show for the jobs of a sink."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_numbers: dict[str, Iterator[int]] = defaultdict(itertools.count)


def unique(name: str) -> str:
    """The name itself the first time, then with a number behind it."""
    n = next(_numbers[name])
    return f"{name}-{n}" if n else name


@contextmanager
def stage(spark: SparkSession, name: str) -> Iterator[str]:
    """Jobs begun inside are described by a unique name; the description before holds again afterwards."""
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    label = unique(name)
    context.setJobDescription(label)
    try:
        yield label
    finally:
        context.setJobDescription(before)
