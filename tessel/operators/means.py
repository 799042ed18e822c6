"""Means over dimensions, over bags of datasets and by key, as plain aggregations of cells.

NaN counts as missing: with skipna it is left out, without it (or a cell that has no row) makes the mean missing. A mean of nothing is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fanout import bin_columns


def present(df: DataFrame, name: str, dtype: str | None = None) -> Column:
    """The variable with NaN as NULL, cast if asked for."""
    c = df[name]
    if dtype:
        c = c.cast(dtype)
    floating = dtype in ("float", "double") or dtype is None and isinstance(df.schema[name].dataType, T.FloatType | T.DoubleType)
    return F.nanvl(c, F.lit(None).cast(dtype or df.schema[name].dataType)) if floating else c


def sum_and_count(df: DataFrame, variables: Sequence[str], dtype: str | None = None) -> list[Column]:
    """The partial result of a mean: the sum and the number of present values of each variable."""
    out = []
    for v in variables:
        x = present(df, v, dtype)
        out += [F.sum(x).alias(f"{v}_sum"), F.count(x).alias(f"{v}_count")]
    return out


def partial_means(df: DataFrame, by: Sequence[str], variables: Sequence[str], dtype: str | None = None) -> DataFrame:
    """Unfinished means: sums and counts by group."""
    return df.groupBy(*by).agg(*sum_and_count(df, variables, dtype))


def merge_partials(parts: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Partial results of equal groups added up."""
    return parts.groupBy(*by).agg(*[F.sum(f"{v}_{k}").alias(f"{v}_{k}") for v in variables for k in ("sum", "count")])


def finish(parts: DataFrame, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Sums over counts; NULL where there is nothing."""
    return parts.select(*by, *[F.try_divide(F.col(f"{v}_sum"), F.col(f"{v}_count")).alias(v) for v in variables])


def mean(df: DataFrame, by: Sequence[str], variables: Sequence[str], skipna: bool = True, dtype: str | None = None, expected: int | None = None) -> DataFrame:
    """The mean of each variable by group: one partial and one final aggregation around one exchange.

    Without skipna a group with a missing value is NULL; with expected, also a group with fewer rows than that.
    """
    out = []
    for v in variables:
        x = present(df, v, dtype)
        m = F.avg(x)
        if not skipna:
            whole = F.count(x) == (F.count(F.lit(1)) if expected is None else F.lit(expected))
            m = F.when(whole, m)
        out.append(m.alias(v))
    return df.groupBy(*by).agg(*out)


def mean_in_stages(df: DataFrame, by: Sequence[str], variables: Sequence[str], index: Column, bins: Sequence[int], dtype: str | None = None) -> DataFrame:
    """A mean as a tree: rows of a group are dealt to bins by index, and each level merges the bins of one digit.

    For a few very hot groups. Every level is one exchange; groups without heat are better served by mean().
    """
    digits = bin_columns(index, bins)
    names = [f"bin_{k}" for k in range(len(bins))]
    salted = df.withColumns(dict(zip(names, digits, strict=True)))
    parts = partial_means(salted, [*by, *names], variables, dtype)
    for k in range(1, len(bins) + 1):
        parts = merge_partials(parts, [*by, *names[k:]], variables)
    return finish(parts, by, variables)


def mean_by_label(df: DataFrame, labels: Mapping[str, Column], by: Sequence[str], variables: Sequence[str], skipna: bool = True) -> DataFrame:
    """Means by derived labels (month, hour, season) and the other dimensions."""
    return mean(df.withColumns(dict(labels)), [*labels, *by], variables, skipna)


def season(ts: Column) -> Column:
    """DJF, MAM, JJA or SON."""
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isNotNull(), "SON")


def resample_index(ts: Column, days: int, origin: Column) -> Column:
    """The number of the bucket of so many days, counted from the first day's midnight."""
    return F.floor(F.datediff(F.to_date(ts), F.to_date(origin)) / days).cast("bigint")


# ---- extensions: not among the combiners that the array pipelines had ------------------------------------------------------------------

EXTENSIONS = {"sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop, "count": F.count, "median": F.median}


def reduce(df: DataFrame, how: str, by: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Another aggregate of the present values by group."""
    if how == "mean":
        return mean(df, by, variables)
    if how not in EXTENSIONS:
        raise ValueError(f"{how!r} is none of {sorted([*EXTENSIONS, 'mean'])}")
    return df.groupBy(*by).agg(*[EXTENSIONS[how](present(df, v)).alias(v) for v in variables])
