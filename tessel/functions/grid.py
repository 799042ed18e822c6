"""Chunk geometry: specs, offsets, indices and bounds, on the driver and as Column expressions."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .key import ChunkKey

Chunks = Mapping[str, int]

# ---- offsets and keys ---------------------------------------------------------------------------------------------------------


def offsets_to_slices(offsets: Chunks, sizes: Chunks, base: Chunks | None = None) -> dict[str, slice]:
    """The slice that a block of the given sizes takes in each dimension, counted from base (0 where it has none)."""
    unknown = [d for d in offsets if d not in sizes]
    if unknown:
        raise ValueError(f"offsets along {unknown} but sizes only for {list(sizes)}")
    base = base or {}
    begin = {d: offsets.get(d, 0) - base.get(d, 0) if d in offsets else 0 for d in sizes}
    return {d: slice(begin[d], begin[d] + n, 1) for d, n in sizes.items()}


def block_offsets(blocks: Mapping[str, tuple[int, ...]]) -> dict[str, list[int]]:
    """Where each block begins, from the blocks' sizes."""
    return {d: [0, *itertools.accumulate(sizes)][: len(sizes)] for d, sizes in blocks.items()}


def chunk_keys(offsets: Mapping[str, list[int]], names: set[str] | None = None) -> Iterator[ChunkKey]:
    """A key for each combination of offsets, the last dimension fastest; one empty key without dimensions."""
    for at in itertools.product(*offsets.values()):
        yield ChunkKey(dict(zip(offsets, at, strict=True)), None if names is None else frozenset(names))


def offset_ordinals(offsets: Mapping[str, list[int]]) -> dict[str, dict[int, int]]:
    """The ordinal of each offset."""
    return {d: dict(zip(at, range(len(at)), strict=True)) for d, at in offsets.items()}


def regular_chunks(blocks: Mapping[str, tuple[int, ...]]) -> dict[str, int]:
    """The chunk size of a regular grid: all blocks alike but the last, which may be smaller."""
    out = {}
    for d, sizes in blocks.items():
        size = sizes[0] if sizes else 0
        if any(s != size for s in sizes[:-1]):
            raise ValueError(f"blocks along {d!r} are irregular: {sizes}")
        if sizes and sizes[-1] > size:
            raise ValueError(f"the last block along {d!r} is larger than the first: {sizes}")
        out[d] = size
    return out


stored_chunks = regular_chunks


def expand_chunks(chunks: Mapping[str, int | tuple[int, ...]], sizes: Chunks) -> dict[str, tuple[int, ...]]:
    """Block sizes along each dimension: from one size (-1 or none: the whole dimension) or from a tuple of them."""
    out = {}
    for d, n in sizes.items():
        c = chunks.get(d, -1)
        if isinstance(c, tuple):
            if sum(c) != n:
                raise ValueError(f"blocks along {d!r} add up to {sum(c)}, the dimension has {n}: {c}")
            out[d] = c
        else:
            c = n if c == -1 else c
            full, rest = divmod(n, c) if c else (0, 0)
            out[d] = (c,) * full + ((rest,) if rest else ())
    return out


def round_key(key: ChunkKey, target: Chunks) -> ChunkKey:
    """The key of the target chunk that a chunk begins in; dimensions that target doesn't name stay."""
    moved = {d: 0 if target[d] == -1 else o - o % target[d] for d, o in key.offsets.items() if d in target}
    return key.with_offsets(**moved)


def split_bounds(start: int, stop: int, multiple: int) -> list[tuple[int, int]]:
    """The parts of [start, stop) between multiples; -1 leaves it whole."""
    if multiple == -1:
        return [(start, stop)]
    cuts = [start, *range(start - start % multiple + multiple, stop, multiple), stop]
    return list(itertools.pairwise(cuts))


def chunk_number(key: ChunkKey, dims: list[str], chunks: Chunks, sizes: Chunks) -> int:
    """The row-major number of a chunk among those along dims."""
    number = 0
    for d in dims:
        number = number * math.ceil(sizes[d] / chunks[d]) + key.offsets.get(d, 0) // chunks[d]
    return number


def finalize_chunks(chunks: Chunks | None, sizes: Chunks) -> dict[str, int]:
    """A size for each dimension: -1 and absent ones take the dimension's."""
    chunks = chunks or {}
    unknown = [d for d in chunks if d not in sizes]
    if unknown:
        raise ValueError(f"chunks for {unknown}, which are not among the dimensions {list(sizes)}")
    return {d: n if chunks.get(d, -1) == -1 else chunks[d] for d, n in sizes.items()}


def plain_chunks(chunks: Mapping[str, int | tuple[int, ...]], sizes: Chunks) -> dict[str, int]:
    """Chunk sizes for planning: -1 and absent ones take the dimension's size, tuples must be constant; sizes are not clamped."""
    unknown = [d for d in chunks if d not in sizes]
    if unknown:
        raise ValueError(f"chunks for {unknown}, which are not among the dimensions {list(sizes)}")
    out = {}
    for d, n in sizes.items():
        c = chunks.get(d, -1)
        if isinstance(c, tuple):
            if len(set(c)) > 1:
                raise ValueError(f"blocks along {d!r} are not constant: {c}")
            c = c[0]
        out[d] = n if c == -1 else c
    return out


# ---- the spec language ----------------------------------------------------------------------------------------------------------

_BYTES = re.compile(r"\s*(\d+(?:\.\d+)?)\s*([kmgtpe]?i?)b?\s*", re.I)


def parse_bytes(text: str) -> int:
    """'80B', '100 MB', '64KiB' as a number of bytes: kB, MB... are powers of 1000 and KiB, MiB... of 1024."""
    m = _BYTES.fullmatch(text)
    if not m:
        raise ValueError(f"not a size in bytes: {text!r}")
    unit = m[2].lower()
    power = "kmgtpe".index(unit[0]) + 1 if unit[:1] and unit[0] in "kmgtpe" else 0
    return int(float(m[1]) * (1024 if unit.endswith("i") else 1000) ** power)


def human_size(n: float) -> str:
    """Bytes in powers of 1000, with two digits at least."""
    units = ["B", "kB", "MB", "GB", "TB", "PB", "EB"]
    k = 0
    while n >= 1000 and k < len(units) - 1:
        n, k = n / 1000, k + 1
    return f"{n:.1f} {units[k]}" if n < 10 and k else f"{n:.0f} {units[k]}"


def solve_bytes(sizes: Chunks, fixed: Chunks, budget: int, itemsize: int, previous: Chunks | None = None) -> dict[str, int]:
    """Chunk sizes for the dimensions that aren't fixed, so that a chunk has about budget bytes.

    All free dimensions grow or shrink from their previous size (else 1) by one common factor; one that reaches its end is held there. Growing
    sizes are rounded down to multiples of the previous one, shrinking ones to whole numbers of at least 1. No tolerance is applied.
    """
    previous = previous or {}
    room = budget / itemsize / math.prod(fixed.values())
    free = {d: max(1, min(previous.get(d, 1), n)) for d, n in sizes.items() if d not in fixed}
    out = dict(fixed)
    while free:
        factor = (room / math.prod(free.values())) ** (1 / len(free))
        ended = [d for d, p in free.items() if p * factor >= sizes[d] * (1 - 1e-12)]
        if not ended:
            for d, p in free.items():
                value = p * factor * (1 + 1e-12)
                out[d] = max(1, int(value // p) * p if factor >= 1 else int(value))
            break
        for d in ended:
            out[d] = sizes[d]
            room /= sizes[d]
            del free[d]
    return {d: out[d] for d in sizes}


def normalize_chunks(spec: Any, sizes: Chunks, itemsizes: Mapping[str, int], split_vars: bool = False, previous: Chunks | None = None) -> dict[str, int]:
    """The chunk size of each dimension from a spec.

    spec is one size for all dimensions or a mapping from dimensions to sizes, where ... names all others. A size is a number of positions, -1 for
    the whole dimension, a tuple of equal block sizes, or bytes ('100MB', at most one value), shared by the dimensions that have it. A dimension without a size has its previous
    chunk, else all of it. itemsizes (bytes of each variable's elements) add up, or with split_vars the largest counts. Sizes are clamped to dimensions.
    """
    if isinstance(spec, int | str | tuple):
        if spec == "auto":
            raise ValueError("'auto' chunks are not supported: give a size in bytes, such as '100MB'")
        spec = {...: spec}
    elif not isinstance(spec, Mapping):
        raise TypeError(f"chunks must be a size or a mapping from dimensions to sizes, not {type(spec).__name__}: {spec!r}")
    texts = {v for v in spec.values() if isinstance(v, str)}
    if "auto" in texts:
        raise ValueError(f"'auto' chunks are not supported in a mapping: {spec}")
    if len(texts) > 1:
        raise ValueError(f"only one size in bytes can be given, not {sorted(texts)}")
    unknown = [d for d in spec if d is not ... and d not in sizes]
    if unknown:
        raise ValueError(f"chunks for {unknown}, which are not among the dimensions {list(sizes)}")
    rest = spec.get(..., None)
    fixed: dict[str, int] = {}
    try:
        for d, n in sizes.items():
            c = spec.get(d, rest)
            if c is None:
                c = (previous or {}).get(d, -1)
            if isinstance(c, tuple):
                c = regular_chunks({d: c})[d]
            if isinstance(c, str):
                continue
            if not isinstance(c, int) or c == 0 or c < -1:
                raise ValueError(f"not a chunk size along {d!r}: {c!r}")
            fixed[d] = n if c == -1 else min(c, n)
        if len(fixed) < len(sizes):
            per_item = (max if split_vars else sum)(itemsizes.values()) if itemsizes else 1
            fixed = solve_bytes(sizes, fixed, parse_bytes(next(iter(texts))), per_item, previous)
    except ValueError as e:
        raise ValueError(f"cannot find chunks for {spec} with sizes {dict(sizes)} and previous chunks {previous}: {e}") from e
    return {d: fixed[d] for d in sizes}


def infer_chunks(old_sizes: Chunks, old_chunks: Chunks, new_sizes: Chunks) -> dict[str, int]:
    """Chunks after a per-chunk function: new dimensions are whole, unchanged ones stay, changed ones keep their number of chunks."""
    out = {}
    for d, n in new_sizes.items():
        if d not in old_sizes:
            out[d] = n
        elif n == old_sizes[d]:
            out[d] = old_chunks[d]
        else:
            count, uneven = divmod(old_sizes[d], old_chunks[d])
            if uneven or n % count:
                raise ValueError(f"{d!r} went from {old_sizes[d]} to {n} in chunks of {old_chunks[d]}: give its chunks, as they don't divide evenly")
            out[d] = n // count
    return out


# ---- the same as Column expressions -----------------------------------------------------------------------------------------------


def offset_of(position: Column, chunk: int) -> Column:
    """The offset of the chunk that holds a position."""
    return (position - position % F.lit(chunk)).cast("bigint")


def index_of(position: Column, chunk: int) -> Column:
    """The number of the chunk that holds a position."""
    return F.floor(position / F.lit(chunk)).cast("bigint")


def number_of(positions: Mapping[str, Column], chunks: Chunks, sizes: Chunks) -> Column:
    """The row-major number of the chunk that holds a position."""
    out = F.lit(0).cast("bigint")
    for d, p in positions.items():
        out = out * math.ceil(sizes[d] / chunks[d]) + index_of(p, chunks[d])
    return out


def split_offset_of(position: Column, source: int, target: int) -> Column:
    """Where the part begins that holds a position once chunks of source are cut at multiples of target."""
    return F.greatest(offset_of(position, source), offset_of(position, target))


def in_slice(position: Column, s: slice) -> Column:
    return (position >= s.start) & (position < s.stop)
