"""Command-line programs: rechunk a store, and the mean of a store by month and hour.

python -m tessel.cli rechunk IN OUT --chunks time=-1,...=100MB [--shards SPEC] [--format 3]
python -m tessel.cli climatology IN OUT --time time
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import means
from .operators.cube import Cube
from .sources.template import Template, Variable


def parse_chunks(text: str) -> Any:
    """'-1', '100MB' or 'time=31,x=-1,...=100MB' as a chunk spec."""
    size = lambda s: int(s) if s.strip().lstrip("-").isdigit() else s.strip()
    if "=" not in text:
        return size(text)
    out: dict = {}
    for part in text.split(","):
        dim, eq, value = part.partition("=")
        if not eq or not dim.strip():
            raise ValueError(f"chunks are given as dim=size, not {part!r}")
        out[... if dim.strip() == "..." else dim.strip()] = size(value)
    return out


def rechunk(spark: SparkSession, source: str, target: str, chunks: Any, shards: Any = None, zarr_format: int | None = None, split_vars: bool = True) -> None:
    """Copy a store to other chunks; with shards, chunks lie in shards."""
    cube = Cube.from_zarr(spark, source, split_vars=split_vars)
    cube = cube.rechunk(shards if shards is not None else chunks)
    cube.to_zarr(target, zarr_chunks=chunks, zarr_shards=shards, zarr_format=zarr_format)


def climatology(spark: SparkSession, source: str, target: str, time: str = "time") -> None:
    """Means by month and hour of day; month is stored at position month - 1. Absent combinations stay missing."""
    cube = Cube.from_zarr(spark, source)
    stamps = cube.template.labels[time].astype("datetime64[s]").astype(np.int64)
    labels = spark.createDataFrame([(k, int(s)) for k, s in enumerate(stamps)], f"{time} bigint, seconds bigint")
    labels = labels.select(time, (F.month(F.timestamp_seconds("seconds")) - 1).cast("long").alias("month"), F.hour(F.timestamp_seconds("seconds")).cast("long").alias("hour"))
    hours = sorted({int(h) for h in stamps // 3600 % 24})
    tables, variables = {}, {}
    for dims, t in cube.tables.items():
        names = cube.names_over(dims)
        if time not in dims:
            tables[dims] = t
            variables |= {n: cube.template.variables[n] for n in names}
            continue
        rest = tuple(d for d in dims if d != time)
        place = F.element_at(F.create_map(*[F.lit(x) for k, h in enumerate(hours) for x in (h, k)]), F.col("hour").cast("int")).cast("long")
        joined = t.join(labels, time).withColumn("hour", place)
        new = ("month", "hour", *rest)
        tables[new] = means.mean(joined, new, names)
        variables |= {n: Variable(new, np.dtype("float64")) for n in names}
    sizes = {"month": 12, "hour": len(hours), **{d: n for d, n in cube.sizes.items() if d != time}}
    template = Template(sizes, variables, {"month": np.arange(1, 13), "hour": np.array(hours), **{d: x for d, x in cube.template.labels.items() if d != time}}, cube.template.attrs)
    chunks = {"month": 1, "hour": 1, **{d: c for d, c in cube.chunks.items() if d != time}}
    replace(cube, tables=tables, template=template, chunks=chunks, untouched=False, load=None).to_zarr(target)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="program", required=True)
    r = sub.add_parser("rechunk")
    r.add_argument("source")
    r.add_argument("target")
    r.add_argument("--chunks", required=True, type=parse_chunks)
    r.add_argument("--shards", type=parse_chunks)
    r.add_argument("--format", type=int, choices=(2, 3))
    c = sub.add_parser("climatology")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--time", default="time")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.program == "rechunk":
        rechunk(spark, a.source, a.target, a.chunks, a.shards, a.format)
    else:
        climatology(spark, a.source, a.target, a.time)


if __name__ == "__main__":
    main()
