"""Blocks: labelled numpy arrays of one chunk, and moves between chunk grids in memory."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..functions.grid import split_bounds
from ..functions.key import ChunkKey

Record = tuple[ChunkKey, "Block"]


@dataclass
class Block:
    """Variables over named dimensions: data[name] = (dims, array); labels of dimensions; attributes."""

    data: dict[str, tuple[tuple[str, ...], np.ndarray]]
    labels: dict[str, np.ndarray] = field(default_factory=dict)
    attrs: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, (dims, x) in self.data.items():
            if np.ndim(x) != len(dims):
                raise ValueError(f"variable {name!r} has {np.ndim(x)} axes for dimensions {dims}")
            for d, n in zip(dims, np.shape(x), strict=True):
                if self.sizes.get(d) != n:
                    raise ValueError(f"dimension {d!r} has sizes {self.sizes.get(d)} and {n}")

    @property
    def sizes(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for dims, x in self.data.values():
            for d, n in zip(dims, np.shape(x), strict=True):
                out.setdefault(d, n)
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        return self.data[name][1]

    def select(self, names: Iterable[str]) -> Block:
        kept = {n: self.data[n] for n in names}
        dims = {d for ds, _ in kept.values() for d in ds}
        return Block(kept, {d: x for d, x in self.labels.items() if d in dims}, self.attrs)

    def isel(self, **slices: slice) -> Block:
        cut = {n: (dims, x[tuple(slices.get(d, slice(None)) for d in dims)]) for n, (dims, x) in self.data.items()}
        return Block(cut, {d: x[slices.get(d, slice(None))] for d, x in self.labels.items()}, self.attrs)

    def map(self, f) -> Block:
        """The same function on every variable's array; it must keep the shape."""
        return Block({n: (d, f(x)) for n, (d, x) in self.data.items()}, self.labels, self.attrs)

    def reduce(self, f, *dims: str) -> Block:
        """f(array, axis=...) over the given dimensions of each variable that has them."""
        out = {}
        for n, (ds, x) in self.data.items():
            axes = tuple(k for k, d in enumerate(ds) if d in dims)
            out[n] = (tuple(d for d in ds if d not in dims), f(x, axis=axes) if axes else x)
        return Block(out, {d: x for d, x in self.labels.items() if d not in dims}, self.attrs)

    def mean(self, *dims: str, skipna: bool = True) -> Block:
        return self.reduce(np.nanmean if skipna else np.mean, *dims)

    def coarsen(self, f=np.mean, **factors: int) -> Block:
        """f over windows of k positions along each dimension, which must divide it."""
        out = {}
        for n, (dims, x) in self.data.items():
            shape, axes = [], []
            for d, size in zip(dims, x.shape, strict=True):
                k = factors.get(d, 1)
                if size % k:
                    raise ValueError(f"{d!r} has {size} positions, which {k} does not divide")
                shape += [size // k, k]
                axes.append(len(shape) - 1)
            out[n] = (dims, f(x.reshape(shape), axis=tuple(axes)))
        return Block(out, {d: x[:: factors.get(d, 1)] for d, x in self.labels.items()}, self.attrs)

    def equals(self, other: Block) -> bool:
        same = lambda a, b: np.array_equal(a, b, equal_nan=np.asarray(a).dtype.kind == "f" and np.asarray(b).dtype.kind == "f")
        return self.data.keys() == other.data.keys() and all(self.data[n][0] == other.data[n][0] and same(self[n], other[n]) for n in self.data) and all(same(x, other.labels.get(d, x)) for d, x in self.labels.items())


def validate_block(key: ChunkKey, block: Block | list[Block]) -> None:
    """Values are there, and the key names only dimensions and variables that the block has."""
    for b in block if isinstance(block, list) else [block]:
        for name, (_, x) in b.data.items():
            if not isinstance(x, np.ndarray | np.generic):
                raise ValueError(f"variable {name!r} of the chunk with {key} has no computed values: {type(x).__name__}")
        if missing := [d for d in key.offsets if d not in b.sizes]:
            raise ValueError(f"{key} has offsets along {missing}, which the chunk's dimensions {list(b.sizes)} lack")
        if key.vars is not None and key.vars != frozenset(b.data):
            raise ValueError(f"{key} names variables other than the chunk's: {sorted(b.data)}")


def split_chunks(key: ChunkKey, block: Block, target: Mapping[str, int]) -> Iterator[Record]:
    """The parts of a block between multiples of target; the first may be short. Dimensions the block lacks are left out."""
    dims = [d for d in target if d in block.sizes]
    parts = []
    for d in dims:
        start = key.offsets.get(d, 0)
        parts.append([(a, slice(a - start, b - start)) for a, b in split_bounds(start, start + block.sizes[d], target[d])])
    for combo in itertools.product(*parts):
        yield key.with_offsets(**{d: a for d, (a, _) in zip(dims, combo, strict=True)}), block.isel(**{d: s for d, (_, s) in zip(dims, combo, strict=True)})


def _joined(dim: str, blocks: list[Block]) -> Block:
    """Blocks put together along one dimension; variables without it must agree."""
    first = blocks[0]
    out = {}
    for name, (dims, x) in first.data.items():
        if any(name not in b.data or b.data[name][0] != dims for b in blocks):
            raise ValueError(f"chunks disagree on variable {name!r}")
        if dim in dims:
            out[name] = (dims, np.concatenate([b[name] for b in blocks], axis=dims.index(dim)))
        else:
            if not all(np.array_equal(b[name], x) for b in blocks):
                raise ValueError(f"variable {name!r} has no dimension {dim!r} but differs between chunks")
            out[name] = (dims, x)
    labels = {d: np.concatenate([b.labels[d] for b in blocks]) if d == dim else x for d, x in first.labels.items()}
    return Block(out, labels, first.attrs)


def consolidate_chunks(records: Iterable[Record]) -> Record:
    """One block of all records of the same variables; they must be unique and form a full grid."""
    found = _unique(records)
    if len({k.vars for k in found}) > 1:
        raise ValueError(f"chunks hold different variables: {sorted(map(repr, found))}")
    dims = {frozenset(k.offsets) for k in found}
    if len(dims) > 1:
        raise ValueError(f"chunks have offsets along different dimensions: {sorted(map(repr, found))}")
    names = list(next(iter(found)).offsets)
    axes = {d: sorted({k.offsets[d] for k in found}) for d in names}
    grid = list(itertools.product(*axes.values()))
    by_offset = {tuple(k.offsets[d] for d in names): b for k, b in found.items()}
    if missing := [g for g in grid if g not in by_offset]:
        raise ValueError(f"chunks are missing at {missing[:5]} of dimensions {names}")
    level = by_offset
    for k in reversed(range(len(names))):
        rows: dict[tuple, list[Block]] = defaultdict(list)
        for at in sorted(level):
            rows[at[:k]].append(level[at])
        level = {at: _joined(names[k], bs) for at, bs in rows.items()}
    first = next(iter(found))
    return ChunkKey({d: a[0] for d, a in axes.items()}, first.vars), level[()]


def _unique(records: Iterable[Record]) -> dict[ChunkKey, Block]:
    out: dict[ChunkKey, Block] = {}
    for k, b in records:
        if k in out:
            raise ValueError(f"two chunks have the key {k}")
        out[k] = b
    if not out:
        raise ValueError("there are no chunks to consolidate")
    return out


def consolidate_variables(records: Iterable[Record]) -> Iterator[Record]:
    """Blocks of equal offsets merged into one with all their variables, whose key has vars None."""
    at: dict[ChunkKey, list[Block]] = defaultdict(list)
    for k, b in records:
        at[k.replace(vars=None)].append(b)
    for key, blocks in at.items():
        yield key, _merged(blocks)


def _merged(blocks: list[Block]) -> Block:
    data: dict = {}
    for b in blocks:
        if both := data.keys() & b.data.keys():
            raise ValueError(f"chunks to merge share the variables {sorted(both)}")
        data |= b.data
    return Block(data, {d: x for b in blocks for d, x in b.labels.items()}, blocks[0].attrs)


def consolidate_fully(records: Iterable[Record]) -> Record:
    """All records as one block; variables may have different dimensions but must begin at the same offsets."""
    groups: dict[frozenset[str] | None, list[Record]] = defaultdict(list)
    for k, b in records:
        groups[k.vars].append((k, b))
    whole = [consolidate_chunks(g) for g in groups.values()]
    offsets: dict[str, int] = {}
    for k, _ in whole:
        for d, o in k.offsets.items():
            if offsets.setdefault(d, o) != o:
                raise ValueError(f"variables begin at different offsets along {d!r}: {offsets[d]} and {o}")
    names = [k.vars for k, _ in whole]
    return ChunkKey(offsets, None if None in names else frozenset().union(*names)), _merged([b for _, b in whole])


def split_variables(key: ChunkKey, block: Block) -> Iterator[Record]:
    """One record for each variable, with offsets along its own dimensions only."""
    for name, (dims, _) in block.data.items():
        yield ChunkKey({d: o for d, o in key.offsets.items() if d in dims}, frozenset([name])), block.select([name])


def rechunk_in_memory(records: Iterable[Record], target: Mapping[str, int]) -> Iterator[Record]:
    """Consolidate, then split."""
    return split_chunks(*consolidate_chunks(records), target)
