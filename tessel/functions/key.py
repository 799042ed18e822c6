"""Chunk keys: where a block of a dataset lies.

A key names the first position of a block along each dimension (offsets), or its chunk number (indices), and the variables it holds. In
DataFrames a key is plain bigint columns, or the struct of KEY_SCHEMA.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_SCHEMA = "struct<offsets: map<string,bigint>, vars: array<string>, indices: map<string,bigint>>"

_UNSET: Any = object()


def _frozen(x: Mapping[str, int] | None) -> Mapping[str, int]:
    return MappingProxyType(dict(sorted((x or {}).items())))


@dataclass(frozen=True, eq=False, repr=False)
class ChunkKey:
    """An immutable, hashable key. Offsets and indices exclude each other; vars None stands for all variables."""

    offsets: Mapping[str, int] = field(default_factory=dict)
    vars: frozenset[str] | None = None
    indices: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.offsets and self.indices:
            raise ValueError(f"offsets and indices cannot both be set: {dict(self.offsets)} and {dict(self.indices)}")
        if isinstance(self.vars, str):
            raise TypeError(f"vars must be a set of names or None, not the string {self.vars!r}")
        object.__setattr__(self, "offsets", _frozen(self.offsets))
        object.__setattr__(self, "indices", _frozen(self.indices))
        object.__setattr__(self, "vars", None if self.vars is None else frozenset(self.vars))

    def replace(self, offsets: Any = _UNSET, vars: Any = _UNSET, indices: Any = _UNSET) -> ChunkKey:  # noqa: A002
        """This key with whole parts exchanged."""
        pick = lambda new, old: old if new is _UNSET else new
        return ChunkKey(pick(offsets, self.offsets), pick(vars, self.vars), pick(indices, self.indices))

    def with_offsets(self, **changes: int | None) -> ChunkKey:
        """Set single offsets; None removes one, which must be there."""
        if self.indices:
            raise ValueError(f"{self} has indices, so offsets cannot be set")
        return self.replace(offsets=_changed(self.offsets, changes))

    def with_indices(self, **changes: int | None) -> ChunkKey:
        """Set single indices; None removes one, which must be there."""
        if self.offsets:
            raise ValueError(f"{self} has offsets, so indices cannot be set")
        return self.replace(indices=_changed(self.indices, changes))

    def _state(self) -> tuple:
        """Canonical and independent of the order in which parts were given."""
        return tuple(self.offsets.items()), None if self.vars is None else tuple(sorted(self.vars)), tuple(self.indices.items())

    def __eq__(self, other: object) -> bool:
        return self._state() == other._state() if isinstance(other, ChunkKey) else NotImplemented

    def __hash__(self) -> int:
        return hash(self._state())

    def __reduce__(self) -> tuple:
        offsets, names, indices = self._state()
        return _rebuilt, (offsets, names, indices)

    def __repr__(self) -> str:
        parts = [f"{k}={v}" for k, v in (("offsets", dict(self.offsets)), ("indices", dict(self.indices))) if v]
        if self.vars is not None:
            parts.append(f"vars={{{', '.join(map(repr, sorted(self.vars)))}}}")
        return f"ChunkKey({', '.join(parts)})"


def _rebuilt(offsets: Iterable, names: Iterable[str] | None, indices: Iterable) -> ChunkKey:
    return ChunkKey(dict(offsets), None if names is None else frozenset(names), dict(indices))


def _changed(old: Mapping[str, int], changes: Mapping[str, int | None]) -> dict[str, int]:
    out = dict(old)
    for dim, value in changes.items():
        if value is None:
            del out[dim]
        else:
            out[dim] = value
    return out


def key_column(dims: Iterable[str], names: Iterable[str] | None = None) -> Column:
    """The key struct of offset columns named after their dimensions."""
    pairs = [x for d in sorted(dims) for x in (F.lit(d), F.col(d).cast("bigint"))]
    offsets = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,bigint>")
    held = F.array(*[F.lit(v) for v in sorted(names)]) if names is not None else F.lit(None).cast("array<string>")
    return F.struct(offsets.alias("offsets"), held.alias("vars"), F.create_map().cast("map<string,bigint>").alias("indices"))


def canonical(key: Column) -> Column:
    """A sortable, groupable form of a key struct that does not depend on the order of its maps."""
    return F.struct(F.array_sort(F.map_entries(key["offsets"])).alias("offsets"), F.array_sort(key["vars"]).alias("vars"), F.array_sort(F.map_entries(key["indices"])).alias("indices"))
