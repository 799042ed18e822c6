"""Templates: the dimensions, sizes, labels and types of a dataset, without values. They live on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPARK = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "bool": "boolean", "uint8": "smallint", "uint16": "int", "uint32": "bigint"}
_NUMPY = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.BooleanType: "bool"}


def spark_type(dtype: Any) -> str:
    """The Spark type of a numpy type."""
    name = np.dtype(dtype).name
    if name not in _SPARK:
        raise TypeError(f"variables of type {name} have no cell type")
    return _SPARK[name]


def numpy_type(kind: T.DataType) -> np.dtype:
    if type(kind) not in _NUMPY:
        raise TypeError(f"{kind.simpleString()} columns cannot be variables")
    return np.dtype(_NUMPY[type(kind)])


@dataclass(frozen=True)
class Variable:
    dims: tuple[str, ...]
    dtype: np.dtype
    attrs: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Template:
    """sizes of the dimensions, variables over them, labels (index coordinates) of some dimensions, attributes.

    eager: small variables that are known already, as (dimensions, array), scalars too. A store gets them with its metadata; cells never hold them.
    """

    sizes: Mapping[str, int]
    variables: Mapping[str, Variable]
    labels: Mapping[str, np.ndarray] = field(default_factory=dict)
    attrs: Mapping[str, Any] = field(default_factory=dict)
    eager: Mapping[str, tuple[tuple[str, ...], np.ndarray]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, (dims, x) in self.eager.items():
            if name in self.variables:
                raise ValueError(f"{name!r} is both a variable of cells and an eager one")
            if np.shape(x) != tuple(self.sizes.get(d) for d in dims):
                raise ValueError(f"eager variable {name!r} over {dims} has shape {np.shape(x)}")
        for name, v in self.variables.items():
            if missing := [d for d in v.dims if d not in self.sizes]:
                raise ValueError(f"variable {name!r} has dimensions {missing} without a size")
        for d, x in self.labels.items():
            if len(x) != self.sizes.get(d):
                raise ValueError(f"{len(x)} labels for dimension {d!r} of size {self.sizes.get(d)}")

    @property
    def values(self) -> Any:
        raise ValueError("a template has no values to compute")

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(self.sizes)

    def itemsizes(self) -> dict[str, int]:
        return {n: v.dtype.itemsize for n, v in self.variables.items()}

    def shape(self, name: str) -> tuple[int, ...]:
        return tuple(self.sizes[d] for d in self.variables[name].dims)

    def nbytes(self) -> int:
        return sum(v.dtype.itemsize * math.prod(self.shape(n)) for n, v in self.variables.items())

    def select(self, names: Iterable[str]) -> Template:
        """Only these variables and the dimensions that they use."""
        kept = {n: self.variables[n] for n in names if n not in self.eager}
        eager = {n: self.eager[n] for n in names if n in self.eager}
        used = {d for dims in (*[v.dims for v in kept.values()], *[dims for dims, _ in eager.values()]) for d in dims}
        return replace(self, sizes={d: n for d, n in self.sizes.items() if d in used}, variables=kept, labels={d: x for d, x in self.labels.items() if d in used}, eager=eager)

    def with_values(self, **values: tuple[tuple[str, ...], Any]) -> Template:
        """More eager variables, each given as (dimensions, array)."""
        return replace(self, eager={**self.eager, **{n: (tuple(dims), np.asarray(x)) for n, (dims, x) in values.items()}})

    def replace_dims(self, **dims: int | np.ndarray | list) -> Template:
        """Dimensions with new sizes, which drop their labels, or with new labels, which set their size too; order of dims stays."""
        sizes, labels = dict(self.sizes), dict(self.labels)
        for d, x in dims.items():
            if isinstance(x, int | np.integer):
                sizes[d] = int(x)
                labels.pop(d, None)
            else:
                labels[d] = np.asarray(x)
                sizes[d] = len(labels[d])
        unused = [d for d in dims if d not in self.sizes]
        if unused:
            raise ValueError(f"{unused} are not dimensions of the template: {list(self.sizes)}")
        if fixed := [n for n, (ds, _) in self.eager.items() if any(sizes[d] != self.sizes[d] for d in ds)]:
            raise ValueError(f"eager variables {fixed} have values along dimensions that change their size")
        return replace(self, sizes=sizes, labels=labels)

    def add_dims(self, names: Iterable[str] | None = None, **dims: int | np.ndarray | list) -> Template:
        """New leading dimensions for the given variables (all)."""
        chosen = set(self.variables if names is None else names)
        sizes = {d: x if isinstance(x, int) else len(x) for d, x in dims.items()}
        labels = {d: np.asarray(x) for d, x in dims.items() if not isinstance(x, int)}
        variables = {n: replace(v, dims=(*dims, *v.dims)) if n in chosen else v for n, v in self.variables.items()}
        return replace(self, sizes={**sizes, **self.sizes}, variables=variables, labels={**labels, **self.labels})

    def drop_dims(self, *dims: str) -> Template:
        variables = {n: replace(v, dims=tuple(d for d in v.dims if d not in dims)) for n, v in self.variables.items()}
        eager = {n: (ds, x) for n, (ds, x) in self.eager.items() if not set(ds) & set(dims)}
        return replace(self, sizes={d: n for d, n in self.sizes.items() if d not in dims}, variables=variables, labels={d: x for d, x in self.labels.items() if d not in dims}, eager=eager)

    def __repr__(self) -> str:
        lines = [f"Template({', '.join(f'{d}: {n}' for d, n in self.sizes.items())})"]
        lines += [f"  {n} ({', '.join(v.dims)}) {v.dtype.name}" for n, v in self.variables.items()]
        return "\n".join(lines)


def discover(df: DataFrame, dims: list[str], variables: list[str] | None = None) -> Template:
    """The template of a cell table: each dimension's size is its largest position plus one, found in one aggregation."""
    row = df.agg(*[F.coalesce(F.max(d) + 1, F.lit(0)).alias(d) for d in dims]).first() if dims else {}
    names = variables if variables is not None else [c for c in df.columns if c not in dims]
    return Template({d: int(row[d]) for d in dims}, {n: Variable(tuple(dims), numpy_type(df.schema[n].dataType)) for n in names})
