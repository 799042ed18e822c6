"""Helpers shared by the corpus operators: shared-folder tables, Arrow text buffers, 64-bit hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Text bytes handled at once inside a Python worker; a longer single text is still taken whole.
SLICE_BYTES = 1 << 18
#: A table of at most this many rows of one or two integers may be broadcast (about 16 MB).
BROADCAST_ROWS = 1_000_000

U = np.uint64


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in rows and bytes, so that a batch of very long texts fits a Python worker; the same bounds for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def give_back() -> None:
    """Return freed memory to the system; idle workers would otherwise hold it beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        return


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, with Arrow buffers from the system allocator and freed memory given back when a task ends."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def small_join(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a narrow right side: broadcast when its counted rows are within the limit, else a shuffled join.

    For the latter the right side is stored first: a join of plain tables is one that adaptive execution splits where a key is hot.
    """
    right = F.broadcast(right) if right.limit(limit + 1).count() <= limit else materialize(right, "side")
    return left.join(right, on, how)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of an Arrow string or binary column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    big = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    o = np.frombuffer(offs, np.int64 if big else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return d, o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding at most limit bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(salt))


#: Of each hash its base and its bytes' values.
_HASHES = tuple((base, seeds(256, salt) | U(1)) for base, salt in ((0x5851F42D4C957F2D, 77), (0x2545F4914F6CDD1D, 78)))
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^i, base^-i) modulo 2^64 for i <= n; kept for slices of the usual size."""
    if base in _POW and len(_POW[base][0]) > n:
        return _POW[base]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        step = b
        while len(p) <= n:
            p = np.concatenate([p, p * U(step)])
            step = step * step % (1 << 64)
        out.append(p)
    if n <= 4 * SLICE_BYTES:
        _POW[base] = out[0], out[1]
    return out[0], out[1]


class RollingHash:
    """Polynomial hashes of all substrings of a byte array, modulo 2^64; which selects one of two independent ones."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base, value = _HASHES[which]
        self.power, self.inverse = _powers(base, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * self.power[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.prefix[stop] - self.prefix[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def plain(self, width: int) -> np.ndarray:
        """Lightly mixed hashes of all substrings of one width, in order."""
        h = (self.prefix[width:] - self.prefix[:-width]) * self.inverse[: len(self.prefix) - width]
        return (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15)


class Memory:
    """Whole numbers for words met before, known by two independent 64-bit hashes; beyond keep words the longest unused are forgotten."""

    def __init__(self, columns: int, keep: int):
        self.keep, self.turn = keep, 0
        self.hashes = np.empty((2, 0), np.uint64)  # sorted by the first
        self.values = np.empty((columns + 1, 0), np.int64)  # and when each was used last

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, values, places in words of those that are not known, whose values are 0)."""
        self.turn += 1
        data, offs = utf8(words)
        h = np.stack([RollingHash(data, which).of(offs[:-1], offs[1:]) for which in (0, 1)])
        out = np.zeros((len(self.values) - 1, len(words)), np.int64)
        at = np.searchsorted(self.hashes[0], h[0])
        there = np.flatnonzero(at < self.hashes.shape[1])
        there = there[(self.hashes[:, at[there]] == h[:, there]).all(axis=0)]
        out[:, there] = self.values[:-1, at[there]]
        self.values[-1, at[there]] = self.turn
        missing = np.ones(len(words), bool)
        missing[there] = False
        return h, out, np.flatnonzero(missing)

    def add(self, hashes: np.ndarray, values: np.ndarray) -> np.ndarray | None:
        """Remember new words. Where some were forgotten, the old places of those that are left."""
        order = np.argsort(hashes[0])
        to = np.searchsorted(self.hashes[0], hashes[0, order])
        self.hashes = np.insert(self.hashes, to, hashes[:, order], axis=1)
        self.values = np.insert(self.values, to, np.concatenate([values[:, order], np.full((1, len(order)), self.turn)]), axis=1)
        if len(self.hashes[0]) <= self.keep:
            return None
        left = np.flatnonzero(self.values[-1] > np.partition(self.values[-1], self.keep // 2)[self.keep // 2])
        self.hashes, self.values = self.hashes[:, left], self.values[:, left]
        return left


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop) of each word [^\\x20\\x09-\\x0D]+ and, per document, the number of words before it."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, stops = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, whatever else the table holds."""
    return df.select(*[df[c].alias(k) for k, c in columns.items()])


def by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each value of the first column, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and keys[a] != last:
                yield held
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held
