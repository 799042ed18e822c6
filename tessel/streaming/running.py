"""An extension: means by label over a stream. The array pipelines had bounded sources only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.means import present


def windowed_means(stream: DataFrame, time: str, by: Sequence[str], variables: Sequence[str], width: str, delay: str) -> DataFrame:
    """The mean of each variable by window and group; rows later than delay are dropped by the watermark, which bounds the state."""
    out = [F.avg(present(stream, v)).alias(v) for v in variables]
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(*out)
