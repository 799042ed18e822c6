"""Zarr stores, formats 2 and 3: metadata, codecs, a Spark data source that reads chunks and a writer of whole chunks or shards.

Stores are reached through pyarrow.fs, so local paths and URIs that it knows work. Every array is read by chunk: ranges of positions leave
out the chunks that they don't meet before anything is read. A stored chunk (or shard) is written by one task.
"""

from __future__ import annotations

import base64
import gzip
import json
import math
import struct
import time
import warnings
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import grid as G
from ..functions.key import ChunkKey
from ..operators.labels import stage
from ..plans.rechunking import count_pieces
from .template import Template, Variable, spark_type

# ---- stores -------------------------------------------------------------------------------------------------------------------------


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def get(path: str) -> bytes | None:
    """A file's bytes; None if there is none."""
    fs, p = _fs(path)
    if fs.get_file_info(p).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(p) as f:
        return f.read()


def get_parts(path: str, choose) -> list[bytes] | None:
    """Ranges of a file: choose(size, read) returns (offset, length) pairs, and may itself read(offset, length) before; None if there is no file."""
    fs, p = _fs(path)
    if fs.get_file_info(p).type != pafs.FileType.File:
        return None
    with fs.open_input_file(p) as f:
        read = lambda offset, length: f.read_at(length, offset)
        return [read(*r) for r in choose(f.size(), read)]


def put(path: str, data: bytes) -> None:
    fs, p = _fs(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(data)


def names_in(path: str) -> list[str]:
    fs, p = _fs(path)
    return sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)) if x.type == pafs.FileType.Directory)


# ---- codecs -------------------------------------------------------------------------------------------------------------------------


def _crc32c_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


_CRC32C = _crc32c_table()
#: Bytes that are walked one by one; longer data is walked in as many lanes side by side as it takes.
_LANE = 1024


def _walk(lanes: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The register of each row of bytes, begun with crc."""
    for column in np.ascontiguousarray(lanes.T):
        crc = _CRC32C[(crc ^ column) & 255] ^ crc >> np.uint32(8)
    return crc


def _after_zeros(n: int) -> np.ndarray:
    """What n zero bytes make of each bit of the register."""
    power = np.uint32(1) << np.arange(32, dtype=np.uint32)
    square = _walk(np.zeros((32, 1), np.uint8), power)
    while n:
        if n & 1:
            power = _linear(square, power)
        square = _linear(square, square)
        n >>= 1
    return power


def _linear(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sum of the columns that x's bits choose."""
    bits = (x[:, None] >> np.arange(32, dtype=np.uint32)) & 1
    return np.bitwise_xor.reduce(np.where(bits, columns, np.uint32(0)), axis=1)


def crc32c(data: bytes) -> int:
    """The Castagnoli checksum. Lanes are walked together and joined in pairs: a lane's register moves on by the zeros that the next lane is long."""
    raw = np.frombuffer(data, np.uint8)
    crc = np.array([0xFFFFFFFF], np.uint32)
    lanes = 1 << (len(raw) // _LANE).bit_length() - 1 if len(raw) >= 2 * _LANE else 0
    if lanes:
        size = len(raw) // lanes
        begin = np.zeros(lanes, np.uint32)
        begin[0] = crc[0]
        parts = _walk(raw[: size * lanes].reshape(lanes, size), begin)
        raw = raw[size * lanes :]
        shift = _after_zeros(size)
        while len(parts) > 1:
            parts = _linear(shift, parts[::2]) ^ parts[1::2]
            shift = _linear(shift, shift)
        crc = parts
    return int(_walk(raw[None], crc)[0]) ^ 0xFFFFFFFF


def _unshuffled(data: np.ndarray, size: int) -> np.ndarray:
    """Elements of size bytes whose bytes lie plane by plane; a rest that is no whole element lies behind."""
    whole = len(data) // size * size
    return np.concatenate([data[:whole].reshape(size, -1).T.ravel(), data[whole:]])


def _unshuffled_bits(data: np.ndarray, size: int) -> np.ndarray:
    """Elements whose bits lie plane by plane, in whole groups of eight elements; the rest lies behind."""
    n = len(data) // size // 8 * 8
    bits = np.unpackbits(data[: n * size].reshape(size, 8, n // 8), axis=2, bitorder="little")
    return np.concatenate([np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").ravel(), data[n * size :]])


def blosc_decompress(data: bytes) -> bytes:
    """A chunk in the version 1 container of blosc, with lz4, zlib, zstd or snappy inside, plain or shuffled by bytes or bits."""
    if len(data) < 16:
        raise ValueError(f"{len(data)} bytes are no blosc container")
    _, _, flags, width, size, block, total = struct.unpack("<BBBBIII", data[:16])
    if total > len(data):
        raise ValueError(f"a blosc container of {total} bytes was cut to {len(data)}")
    if flags & 2:  # stored as it was
        return data[16 : 16 + size]
    codec = {0: "blosclz", 1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if codec in ("blosclz", None):
        raise ValueError(f"the blosc codec {codec or flags >> 5} is not supported: lz4, zlib, zstd and snappy are")
    expand = (lambda x, n: zlib.decompress(x)) if codec == "zlib" else lambda x, n: pa.Codec(codec).decompress(x, n).to_pybytes()
    blocks = -(-size // block)
    out = []
    for k, at in enumerate(struct.unpack(f"<{blocks}i", data[16 : 16 + 4 * blocks])):
        n = min(block, size - k * block)
        # whole blocks of small elements are compressed in one stream for each byte of an element, unless a flag says no
        streams = width if not flags & 16 and width <= 16 and n == block and block // width >= 128 else 1
        parts = []
        for _ in range(streams):
            (held,) = struct.unpack("<i", data[at : at + 4])
            piece = data[at + 4 : at + 4 + held]
            parts.append(piece if held == n // streams else expand(piece, n // streams))
            at += 4 + held
        x = np.frombuffer(b"".join(parts), np.uint8)
        if flags & 1 and width > 1:
            x = _unshuffled(x, width)
        elif flags & 4:
            x = _unshuffled_bits(x, width)
        out.append(x.tobytes())
    return b"".join(out)


def _decompress(name: str, data: bytes, size: int) -> bytes:
    if name == "gzip":
        return gzip.decompress(data)
    if name == "zlib":
        return zlib.decompress(data)
    if name == "zstd":
        return pa.Codec("zstd").decompress(data, size).to_pybytes()
    if name == "lz4":
        (n,) = struct.unpack("<I", data[:4])
        return pa.Codec("lz4_raw").decompress(data[4:], n).to_pybytes()
    if name == "bz2":
        import bz2

        return bz2.decompress(data)
    if name == "blosc":
        return blosc_decompress(data)
    raise ValueError(f"chunks are compressed with {name!r}, which is not supported: blosc, gzip, zlib, zstd, lz4 and bz2 are")


def _compress(name: str, level: int | None, data: bytes) -> bytes:
    if name == "gzip":
        return gzip.compress(data, 5 if level is None else level, mtime=0)
    if name == "zlib":
        return zlib.compress(data, 1 if level is None else level)
    if name == "zstd":
        return pa.Codec("zstd", compression_level=level or None).compress(data).to_pybytes()
    if name == "lz4":
        return struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data).to_pybytes()
    raise ValueError(f"compressor {name!r} is not supported for writing: gzip, zlib, zstd and lz4 are")


# ---- arrays -------------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ArrayMeta:
    """One stored array. chunks: the smallest unit that is decoded; shards: the file's unit, if chunks are grouped in files."""

    path: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    chunks: tuple[int, ...]
    shards: tuple[int, ...] | None
    fill: Any
    format: int
    compressor: tuple[str, int | None] | None
    separator: str
    crc: bool = False
    swapped: bool = False
    attrs: Mapping[str, Any] = None  # type: ignore[assignment]
    shuffle: int = 0
    prefix: bool = True
    order: str = "C"
    index_first: bool = False

    def file_of(self, at: Sequence[int]) -> str:
        parts = [str(i) for i in at]
        if self.format == 3 and self.prefix:
            return f"{self.path}/" + self.separator.join(["c", *parts])
        return f"{self.path}/" + (self.separator.join(parts) if parts else "0")

    def decode(self, data: bytes, shape: Sequence[int]) -> np.ndarray:
        n = math.prod(shape) * np.dtype(self.dtype).itemsize
        if self.crc:
            if struct.pack("<I", crc32c(data[:-4])) != data[-4:]:
                raise ValueError(f"a chunk of {self.path} fails its checksum")
            data = data[:-4]
        if self.compressor:
            data = _decompress(self.compressor[0], data, n)
        if self.shuffle > 1:
            data = _unshuffled(np.frombuffer(data, np.uint8), self.shuffle).tobytes()
        x = np.frombuffer(data, np.dtype(self.dtype).newbyteorder(">" if self.swapped else "<"))
        return x.reshape(shape, order=self.order).astype(self.dtype, order="C")

    def encode(self, x: np.ndarray) -> bytes:
        data = np.asarray(x, np.dtype(self.dtype).newbyteorder(">" if self.swapped else "<")).tobytes(self.order)
        if self.compressor:
            data = _compress(*self.compressor, data)
        return data + struct.pack("<I", crc32c(data)) if self.crc else data

    def unit(self) -> tuple[int, ...]:
        return self.shards or self.chunks

    def read(self, at: Sequence[int], part: Sequence[slice] | None = None) -> np.ndarray:
        """A unit (a file), or a part of it: a chunk, or chunks of a shard, of which only those that meet the part are read. Absent ones have the fill value."""
        unit = self.unit()
        part = tuple(part) if part is not None else tuple(slice(0, u) for u in unit)
        fill = np.array(self.fill if self.fill is not None else 0).astype(self.dtype)
        out = np.full([p.stop - p.start for p in part], fill, self.dtype)
        if not self.shards:
            data = get(self.file_of(at))
            return out if data is None else self.decode(data, unit)[part]
        counts = [s // c for s, c in zip(self.shards, self.chunks, strict=True)]
        met = [range(p.start // c, -(-p.stop // c)) for p, c in zip(part, self.chunks, strict=True)]
        places = [tuple(r[i] for r, i in zip(met, k, strict=True)) for k in np.ndindex(*map(len, met))]

        def choose(size: int, read) -> list[tuple[int, int]]:
            n = 16 * math.prod(counts)
            raw = read(0 if self.index_first else size - n - 4, n + 4)
            if struct.pack("<I", crc32c(raw[:-4])) != raw[-4:]:
                raise ValueError(f"the index of a shard of {self.path} fails its checksum")
            index = np.frombuffer(raw[:-4], "<u8").reshape(*counts, 2)
            places[:] = [p for p in places if int(index[p][0]) != 2**64 - 1]
            return [tuple(map(int, index[p])) for p in places]

        for place, data in zip(places, get_parts(self.file_of(at), choose) or [], strict=False):
            x = self.decode(data, self.chunks)
            begin = [i * c for i, c in zip(place, self.chunks, strict=True)]
            low = [max(p.start, b) for p, b in zip(part, begin, strict=True)]
            high = [min(p.stop, b + c) for p, b, c in zip(part, begin, self.chunks, strict=True)]
            to = tuple(slice(a - p.start, z - p.start) for p, a, z in zip(part, low, high, strict=True))
            out[to] = x[tuple(slice(a - b, z - b) for b, a, z in zip(begin, low, high, strict=True))]
        return out

    def write(self, at: Sequence[int], x: np.ndarray) -> None:
        """A whole unit; x may be short at the end of a dimension and is filled up."""
        unit = self.unit()
        if x.shape != unit:
            full = np.full(unit, np.array(self.fill if self.fill is not None else 0).astype(self.dtype), self.dtype)
            full[tuple(slice(0, n) for n in x.shape)] = x
            x = full
        if not self.shards:
            put(self.file_of(at), self.encode(x))
            return
        counts = [s // c for s, c in zip(self.shards, self.chunks, strict=True)]
        body, index, at_byte = [], [], 0
        for place in np.ndindex(*counts):
            piece = self.encode(x[tuple(slice(i * c, (i + 1) * c) for i, c in zip(place, self.chunks, strict=True))])
            index.append((at_byte, len(piece)))
            body.append(piece)
            at_byte += len(piece)
        raw = np.array(index, "<u8").tobytes()
        put(self.file_of(at), b"".join(body) + raw + struct.pack("<I", crc32c(raw)))

    def _data_type(self) -> Any:
        dt = np.dtype(self.dtype)
        return {"name": "fixed_length_utf32", "configuration": {"length_bytes": dt.itemsize}} if dt.kind == "U" else dt.name

    def metadata(self) -> dict:
        if self.format == 2:
            name, level = self.compressor or (None, None)
            comp = None if name is None else {"id": name} | ({"level": 1 if level is None else level} if name != "lz4" else {"acceleration": 1})
            return {"zarr_format": 2, "shape": list(self.shape), "chunks": list(self.chunks), "dtype": np.dtype(self.dtype).newbyteorder(">" if self.swapped else "<").str, "compressor": comp, "fill_value": _json_fill(self.fill), "order": self.order, "filters": None, "dimension_separator": self.separator}
        inner: list[dict] = [{"name": "bytes", "configuration": {"endian": "little"}} if np.dtype(self.dtype).itemsize > 1 else {"name": "bytes"}]
        if self.compressor:
            name, level = self.compressor
            level = level if level is not None else 0 if name == "zstd" else 5
            inner.append({"name": name, "configuration": {"level": level} | ({"checksum": False} if name == "zstd" else {})})
        if self.crc:
            inner.append({"name": "crc32c"})
        codecs = inner
        if self.shards:
            index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
            codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(self.chunks), "codecs": inner, "index_codecs": index, "index_location": "end"}}]
        return {
            "zarr_format": 3, "node_type": "array", "shape": list(self.shape), "data_type": self._data_type(), "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.unit())}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": self.separator}}, "fill_value": _json_fill(self.fill if self.fill is not None else 0), "codecs": codecs, "dimension_names": list(self.dims), "attributes": dict(self.attrs or {}),
        }


def _json_fill(x: Any) -> Any:
    if isinstance(x, float | np.floating):
        return "NaN" if math.isnan(x) else "Infinity" if x == math.inf else "-Infinity" if x == -math.inf else float(x)
    return x.item() if isinstance(x, np.generic) else x


def _fill(x: Any, dtype: str) -> Any:
    kind = np.dtype(dtype).kind
    if kind == "U":
        return x or ""
    if isinstance(x, str) and kind == "f":
        return {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(x, None)
    if isinstance(x, str):
        return np.frombuffer(base64.b64decode(x), dtype)[0]
    return x


def open_array(path: str) -> ArrayMeta | None:
    """The metadata of an array, or None where there is none."""
    if raw := get(f"{path}/zarr.json"):
        m = json.loads(raw)
        if m.get("node_type") != "array":
            return None
        dtype = m["data_type"]
        if isinstance(dtype, dict):
            if dtype.get("name") != "fixed_length_utf32":
                raise ValueError(f"the type {dtype.get('name')!r} of {path} is not supported")
            dtype = f"<U{dtype['configuration']['length_bytes'] // 4}"
        unit = tuple(m["chunk_grid"]["configuration"]["chunk_shape"])
        codecs, shards, chunks, first = m["codecs"], None, unit, False
        if codecs and codecs[0]["name"] == "sharding_indexed":
            conf = codecs[0]["configuration"]
            first = conf.get("index_location", "end") == "start"
            shards, chunks, codecs = unit, tuple(conf["chunk_shape"]), conf["codecs"]
        compressor, crc, swapped = None, False, False
        for c in codecs:
            conf = c.get("configuration", {})
            if c["name"] == "bytes":
                swapped = conf.get("endian", "little") == "big"
            elif c["name"] == "crc32c":
                crc = True
            elif c["name"] in ("gzip", "zstd"):
                compressor = (c["name"], conf.get("level"))
            else:
                raise ValueError(f"codec {c['name']!r} of {path} is not supported")
        key = m["chunk_key_encoding"]
        v2 = key["name"] == "v2"
        return ArrayMeta(path, tuple(m.get("dimension_names") or [f"dim_{k}" for k in range(len(m["shape"]))]), tuple(m["shape"]), dtype, chunks, shards, _fill(m["fill_value"], dtype), 3, compressor, key.get("configuration", {}).get("separator", "." if v2 else "/"), crc, swapped, m.get("attributes", {}), prefix=not v2, index_first=first)
    if raw := get(f"{path}/.zarray"):
        m = json.loads(raw)
        attrs = json.loads(get(f"{path}/.zattrs") or b"{}")
        dt = np.dtype(m["dtype"])
        shuffle = 0
        for f in m.get("filters") or []:
            if f["id"] != "shuffle":
                raise ValueError(f"filter {f['id']!r} of {path} is not supported")
            shuffle = f.get("elementsize", 4)
        comp = m.get("compressor")
        dims = tuple(attrs.pop("_ARRAY_DIMENSIONS", [f"dim_{k}" for k in range(len(m["shape"]))]))
        return ArrayMeta(path, dims, tuple(m["shape"]), dt.newbyteorder("=").str if dt.kind == "U" else dt.newbyteorder("=").name, tuple(m["chunks"]), None, _fill(m.get("fill_value"), dt.str), 2, (comp["id"], comp.get("level")) if comp else None, m.get("dimension_separator", "."), False, dt.str[0] == ">", attrs, shuffle, order=m.get("order", "C"))
    return None


def open_store(path: str) -> tuple[dict[str, ArrayMeta], dict[str, Any]]:
    """All arrays of a group and the group's attributes."""
    path = path.rstrip("/")
    arrays = {n: a for n in names_in(path) if (a := open_array(f"{path}/{n}"))}
    if raw := get(f"{path}/zarr.json"):
        attrs = json.loads(raw).get("attributes", {})
    else:
        attrs = json.loads(get(f"{path}/.zattrs") or b"{}")
    if not arrays:
        raise ValueError(f"there are no arrays in {path}")
    return arrays, attrs


def whole(meta: ArrayMeta) -> np.ndarray:
    """An array read on the driver; for labels."""
    out = np.empty(meta.shape, meta.dtype)
    unit = meta.unit()
    for at in np.ndindex(*[-(-n // u) for n, u in zip(meta.shape, unit, strict=True)]):
        where = tuple(slice(i * u, min((i + 1) * u, n)) for i, u, n in zip(at, unit, meta.shape, strict=True))
        out[where] = meta.read(at)[tuple(slice(0, w.stop - w.start) for w in where)]
    return out


_EPOCH_UNITS = {"days": "D", "hours": "h", "minutes": "m", "seconds": "s", "milliseconds": "ms", "microseconds": "us", "nanoseconds": "ns"}


def _labels(meta: ArrayMeta) -> np.ndarray:
    x = whole(meta)
    units = (meta.attrs or {}).get("units", "")
    if " since " in units and units.split(" since ")[0] in _EPOCH_UNITS:
        unit, base = units.split(" since ")
        return np.datetime64(base.strip().replace(" ", "T"), "ns") + x.astype(np.int64).astype(f"timedelta64[{_EPOCH_UNITS[unit]}]")
    return x


# ---- the data source ------------------------------------------------------------------------------------------------------------------


#: Stored bytes, uncompressed, that one partition reads, unless there are fewer partitions than cores then.
PARTITION_BYTES = 64 << 20
#: Cells of one record batch.
SLAB = 1 << 16


@dataclass
class Run(InputPartition):
    """Consecutive numbers of the units, or blocks, that meet the bounds."""

    first: int
    stop: int

    def __init__(self, first: int, stop: int):
        super().__init__((first, stop))
        self.first, self.stop = first, stop


class ZarrSource(DataSource):
    """format('tessel_zarr'): options path, variables (comma separated) that share dimensions and stored units, and bounds.

    bounds is JSON {dim: [from, to]}: only units that meet it are read, and only cells inside come out, with positions counted from the bounds' begin. It is
    an option and no pushed filter, as Spark keeps a Python source's pushed filters for later plans of the same DataFrame, which then lack rows.
    cores is the least number of partitions if there are as many units. With blocks, JSON {dim: size}, each row is a block of that size instead of a cell.
    The units of a partition are numbers of a run, so the driver lists partitions only, and a partition holds about PARTITION_BYTES.
    """

    @classmethod
    def name(cls) -> str:
        return "tessel_zarr"

    def _metas(self) -> list[ArrayMeta]:
        names = self.options["variables"].split(",")
        metas = []
        for n in names:
            m = open_array(f"{self.options['path'].rstrip('/')}/{n}")
            if m is None:
                raise ValueError(f"there is no array {n!r} in {self.options['path']}")
            metas.append(m)
        if len({(m.dims, m.shape, m.unit()) for m in metas}) > 1:
            raise ValueError(f"{names} differ in dimensions or stored chunks")
        return metas

    def schema(self) -> str:
        return schema_of(self._metas(), self.options["variables"].split(","), "blocks" in self.options)

    def reader(self, schema: Any) -> DataSourceReader:
        chosen = {k: json.loads(self.options[k]) for k in ("bounds", "blocks") if k in self.options}
        return ZarrReader(self._metas(), self.options["variables"].split(","), chosen.get("bounds", {}), int(self.options.get("cores", "1")), chosen.get("blocks"))


def schema_of(metas: Sequence[ArrayMeta], names: Sequence[str], blocks: bool = False) -> str:
    from ..operators.cube import BLOCKS

    if blocks:
        return ", ".join([*[f"{d}_offset bigint" for d in metas[0].dims], BLOCKS])
    return ", ".join([*[f"{d} bigint" for d in metas[0].dims], *[f"{n} {spark_type(m.dtype)}" for n, m in zip(names, metas, strict=True)]])


class ZarrReader(DataSourceReader):
    def __init__(self, metas: list[ArrayMeta], names: list[str], bounds: Mapping[str, Sequence[int]], cores: int = 1, blocks: Mapping[str, int] | None = None):
        self.metas, self.names, self.cores = metas, names, cores
        m = metas[0]
        self.low = [max(0, bounds.get(d, (0, 0))[0]) for d in m.dims]
        self.high = [min(n, bounds.get(d, (0, n))[1]) for d, n in zip(m.dims, m.shape, strict=True)]
        self.blocks = None if blocks is None else [blocks[d] for d in m.dims]
        # what is numbered: units by their own grid, blocks by a grid that begins at the bounds
        if self.blocks is None:
            self.grid = [range(a // u, -(-b // u)) for a, b, u in zip(self.low, self.high, m.unit(), strict=True)]
        else:
            self.grid = [range(-(-(b - a) // c)) for a, b, c in zip(self.low, self.high, self.blocks, strict=True)]

    def partitions(self) -> Sequence[Run]:
        if any(a >= b for a, b in zip(self.low, self.high, strict=True)):
            return []
        count = math.prod(map(len, self.grid))
        size = math.prod(self.blocks or self.metas[0].unit()) * sum(np.dtype(m.dtype).itemsize for m in self.metas)
        pieces = min(count, max(self.cores, -(-count * size // PARTITION_BYTES)))
        edges = [count * k // pieces for k in range(pieces + 1)]
        return [Run(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        for k in range(partition.first, partition.stop):
            at = [r[int(i)] for r, i in zip(self.grid, np.unravel_index(k, tuple(map(len, self.grid))) if self.grid else (), strict=True)]
            yield from self._unit(at) if self.blocks is None else self._block(at)

    def _unit(self, at: Sequence[int]) -> Iterator[pa.RecordBatch]:
        """The cells of a unit, in slabs."""
        m = self.metas[0]
        begin = [i * u for i, u in zip(at, m.unit(), strict=True)]
        part = [slice(max(a, b) - b, min(z, b + u) - b) for a, z, b, u in zip(self.low, self.high, begin, m.unit(), strict=True)]
        shape = tuple(p.stop - p.start for p in part)
        values = [np.ascontiguousarray(x.read(at, part)).reshape(-1) for x in self.metas]
        move = [b + p.start - a for b, p, a in zip(begin, part, self.low, strict=True)]
        for first in range(0, math.prod(shape), SLAB):
            cells = np.arange(first, min(first + SLAB, math.prod(shape)))
            index = np.unravel_index(cells, shape) if shape else ()
            columns = [pa.array(i + o, pa.int64()) for i, o in zip(index, move, strict=True)] + [pa.array(v[cells[0] : cells[-1] + 1]) for v in values]
            yield pa.RecordBatch.from_arrays(columns, names=[*m.dims, *self.names])

    def _block(self, at: Sequence[int]) -> Iterator[pa.RecordBatch]:
        """A block, put together from the parts of units that meet it."""
        from ..operators.block import Block
        from ..operators.cube import packed

        m = self.metas[0]
        begin = [a + i * c for a, i, c in zip(self.low, at, self.blocks, strict=True)]
        stop = [min(b + c, z) for b, c, z in zip(begin, self.blocks, self.high, strict=True)]
        units = [range(b // u, -(-z // u)) for b, z, u in zip(begin, stop, m.unit(), strict=True)]
        data = {}
        for n, x in zip(self.names, self.metas, strict=True):
            out = np.empty([z - b for b, z in zip(begin, stop, strict=True)], x.dtype)
            for k in np.ndindex(*map(len, units)):
                unit = [r[i] for r, i in zip(units, k, strict=True)]
                start = [i * u for i, u in zip(unit, m.unit(), strict=True)]
                low = [max(b, s) for b, s in zip(begin, start, strict=True)]
                high = [min(z, s + u) for z, s, u in zip(stop, start, m.unit(), strict=True)]
                piece = x.read(unit, [slice(a - s, z - s) for a, z, s in zip(low, high, start, strict=True)])
                out[tuple(slice(a - b, z - b) for a, z, b in zip(low, high, begin, strict=True))] = piece
            data[n] = (m.dims, out)
        yield packed(Block(data), {f"{d}": b - a for d, b, a in zip(m.dims, begin, self.low, strict=True)}, self.names)


@dataclass(frozen=True)
class Stored:
    """A store as a cube reads it: some variables within bounds. Selecting makes another one, which leaves the rest unread."""

    spark: SparkSession
    path: str
    names: tuple[str, ...]
    metas: Mapping[str, ArrayMeta]
    bounds: Mapping[str, tuple[int, int]]

    def select(self, names: Sequence[str]) -> Stored:
        return replace(self, names=tuple(names))

    def within(self, bounds: Mapping[str, Sequence[int]]) -> Stored:
        """Positions a to b along some dimensions, counted from what is selected already."""
        moved = {d: (self._begin(d) + a, self._begin(d) + b) for d, (a, b) in bounds.items()}
        return replace(self, bounds={**self.bounds, **moved})

    def _begin(self, d: str) -> int:
        return self.bounds.get(d, (0, 0))[0]

    def _over(self) -> dict[tuple[str, ...], list[str]]:
        out: dict[tuple[str, ...], list[str]] = {}
        for n in self.names:
            out.setdefault(self.metas[n].dims, []).append(n)
        return out

    def _frame(self, dims: tuple[str, ...], names: list[str], **options: str) -> DataFrame:
        metas = [self.metas[n] for n in names]
        own = json.dumps({d: list(b) for d, b in self.bounds.items() if d in dims})
        reader = self.spark.read.format("tessel_zarr").schema(schema_of(metas, names, "blocks" in options))
        return reader.options(variables=",".join(names), bounds=own, cores=str(self.spark.sparkContext.defaultParallelism), **options).load(self.path)

    def tables(self) -> dict[tuple[str, ...], DataFrame]:
        return {dims: self._frame(dims, names) for dims, names in self._over().items()}

    def block_table(self, dims: tuple[str, ...], chunks: Mapping[str, int]) -> DataFrame | None:
        """One row for each chunk, if that reads no unit much more than once: chunks that cut across units are better dealt by cells."""
        over = {frozenset(d): (d, names) for d, names in self._over().items()}
        own, names = over[frozenset(dims)]
        m = self.metas[names[0]]
        pieces = units = 1
        for d, n, u in zip(m.dims, m.shape, m.unit(), strict=True):
            a, b = self.bounds.get(d, (0, n))
            met = max(1, -(-b // u) - a // u)
            # where the bounds begin inside a unit, the two grids are taken to have no cut in common
            cuts = count_pieces(b - a, chunks[d], u) if a % u == 0 else met - 1 + -(-(b - a) // chunks[d])
            pieces, units = pieces * max(1, cuts), units * met
        if own != tuple(dims) or pieces > 2 * units:
            return None
        return self._frame(own, names, blocks=json.dumps({d: chunks[d] for d in own}))


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(ZarrSource)


def open_template(path: str, **kwargs: Any) -> tuple[Template, dict[str, int]]:
    """(template, chunk sizes) of a store, from its metadata and labels only. Stored units must agree between variables."""
    if "chunks" in kwargs:
        raise TypeError("chunks cannot be given when opening a store: its own are used")
    arrays, attrs = open_store(path)
    labels = {n: _labels(a) for n, a in arrays.items() if a.dims == (n,)}
    sizes: dict[str, int] = {}
    chunks: dict[str, int] = {}
    for n, a in arrays.items():
        for d, size, u in zip(a.dims, a.shape, a.unit(), strict=True):
            sizes[d] = size
            if n in labels:
                continue
            if chunks.setdefault(d, u) != u:
                raise ValueError(f"stored chunks along {d!r} differ between variables: {chunks[d]} and {u}")
    variables = {n: Variable(a.dims, np.dtype(a.dtype), dict(a.attrs or {})) for n, a in arrays.items() if n not in labels}
    used = {d for v in variables.values() for d in v.dims}
    sizes = {d: s for d, s in sizes.items() if d in used}
    return Template(sizes, variables, {d: x for d, x in labels.items() if d in sizes}, attrs), {d: min(chunks[d], s) for d, s in sizes.items()}


def read_cube(spark: SparkSession, path: str, chunks: Any = None, split_vars: bool = False):
    """A cube over a store; chunks start from the stored ones."""
    from ..operators.cube import Cube

    _register(spark)
    template, stored = open_template(path)

    arrays, _ = open_store(path)
    load = Stored(spark, path, tuple(template.variables), {n: arrays[n] for n in template.variables}, {})
    grid = stored if chunks is None else G.normalize_chunks(chunks, template.sizes, template.itemsizes(), split_vars, stored)
    return Cube(load.tables(), template, grid, split_vars, True, load)


# ---- writing ------------------------------------------------------------------------------------------------------------------------


def shards_of(chunks: Mapping[str, int], per_shard: Mapping[Any, int] | int, shards: Mapping[str, int]) -> dict[str, int]:
    """Stored chunk sizes from shard sizes and the number of chunks in a shard along each dimension (... or 1 for the others)."""
    if isinstance(per_shard, int):
        per_shard = {...: per_shard}
    rest = per_shard.get(..., 1)
    if unknown := [d for d in per_shard if d is not ... and d not in shards]:
        raise ValueError(f"chunks per shard for {unknown}, which are not among the dimensions {list(shards)}")
    out = {}
    for d, s in shards.items():
        k = per_shard.get(d, rest)
        if s % k:
            raise ValueError(f"{k} chunks do not evenly divide the shard size {s} along {d!r}")
        out[d] = s // k
    return out


def check_multiples(name: str, stored: Mapping[str, int], chunks: Mapping[str, int], sizes: Mapping[str, int]) -> None:
    """A dataset's chunk must hold whole stored units, unless it holds the whole dimension."""
    for d, c in chunks.items():
        if c % stored[d] and c != sizes[d]:
            raise ValueError(f"chunks of {c} along {d!r} are no multiple of the stored {name} of {stored[d]}")


def setup(template: Template, path: str, chunks: Mapping[str, int], shards: Mapping[str, int] | None = None, zarr_format: int | None = None, encoding: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, ArrayMeta]:
    """Write metadata, labels and eager variables, and the metadata of the variables of cells, whose values come later."""
    if not template.variables:
        raise ValueError("the template has no variable to write")
    if shards:
        if zarr_format == 2:
            raise ValueError("shards need format 3")
        zarr_format = 3
        for d, s in shards.items():
            if s % chunks[d]:
                raise ValueError(f"shards of {s} along {d!r} are no multiple of the chunks of {chunks[d]}")
    zarr_format = zarr_format or 2
    encoding = encoding or {}
    for n, e in encoding.items():
        if n not in template.variables:
            raise ValueError(f"encoding for {n!r}, which is no variable of the template")
        if bad := {"chunks", "shards"} & e.keys():
            raise ValueError(f"encoding of {n!r} must not hold {sorted(bad)}: use the arguments")
        if unknown := e.keys() - {"compressor", "level", "fill_value", "crc32c"}:
            raise ValueError(f"encoding of {n!r} holds {sorted(unknown)}, which is not known")
    path = path.rstrip("/")
    metas, eager_metas = {}, {}
    for n, v in template.variables.items():
        e = encoding.get(n, {})
        comp = (e.get("compressor", "zstd"), e.get("level"))
        fill = e.get("fill_value", math.nan if v.dtype.kind == "f" else 0)
        metas[n] = ArrayMeta(f"{path}/{n}", v.dims, template.shape(n), v.dtype.name, tuple(max(1, chunks[d]) for d in v.dims), tuple(shards[d] for d in v.dims) if shards else None, fill, zarr_format, comp if comp[0] else None, "/" if zarr_format == 3 else ".", bool(e.get("crc32c")) and zarr_format == 3, attrs=dict(v.attrs))
    for n, (dims, x) in template.eager.items():
        unit = tuple(max(1, chunks.get(d, template.sizes[d])) for d in dims)
        eager_metas[n] = (ArrayMeta(f"{path}/{n}", dims, x.shape, x.dtype.name, unit, None, math.nan if x.dtype.kind == "f" else 0, zarr_format, ("zstd", None), "/" if zarr_format == 3 else "."), x)
    label_metas = {}
    for d, x in template.labels.items():
        x, attrs = np.asarray(x), {}
        if x.dtype.kind == "M":
            x = x.astype("datetime64[ns]").astype(np.int64)
            attrs = {"units": "nanoseconds since 1970-01-01", "calendar": "proleptic_gregorian"}
        if x.dtype.kind == "O" and all(isinstance(v, str) for v in x):
            x = x.astype(str)
        if x.dtype.kind not in "iufbU":
            raise ValueError(f"labels of {d!r} are {x.dtype}, which has no stored form: numbers, dates and strings have")
        text = x.dtype.kind == "U"
        label_metas[d] = (ArrayMeta(f"{path}/{d}", (d,), x.shape, x.dtype.str if text else x.dtype.name, (max(1, len(x)),), None, "" if text else 0, zarr_format, ("zstd", None), "/" if zarr_format == 3 else ".", attrs=attrs), x)
    if zarr_format == 3:
        put(f"{path}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": dict(template.attrs)}).encode())
    else:
        put(f"{path}/.zgroup", b'{"zarr_format": 2}')
        put(f"{path}/.zattrs", json.dumps(dict(template.attrs)).encode())
    for m in [*metas.values(), *[m for m, _ in (*label_metas.values(), *eager_metas.values())]]:
        if zarr_format == 3:
            put(f"{m.path}/zarr.json", json.dumps(m.metadata()).encode())
        else:
            put(f"{m.path}/.zarray", json.dumps(m.metadata()).encode())
            put(f"{m.path}/.zattrs", json.dumps({"_ARRAY_DIMENSIONS": list(m.dims), **dict(m.attrs or {})}).encode())
    for m, x in label_metas.values():
        m.write((0,), x)
    for m, x in eager_metas.values():
        for at in np.ndindex(*[-(-n // u) for n, u in zip(m.shape, m.chunks, strict=True)]):
            m.write(at, x[tuple(slice(i * u, (i + 1) * u) for i, u in zip(at, m.chunks, strict=True))])
    return metas


def extend(path: str, dim: str, size: int, labels: np.ndarray | None = None) -> dict[str, ArrayMeta]:
    """Enlarge a dimension of all stored arrays for an append; cells of the new part are written with needs_setup=False."""
    arrays, _ = open_store(path)
    out = {}
    for n, a in arrays.items():
        if dim not in a.dims:
            continue
        is_label = a.dims == (n,)
        x = whole(a) if is_label else None
        shape = tuple(size if d == dim else s for d, s in zip(a.dims, a.shape, strict=True))
        new = ArrayMeta(**{**a.__dict__, "shape": shape, **({"chunks": shape} if is_label else {})})
        name = "zarr.json" if a.format == 3 else ".zarray"
        put(f"{a.path}/{name}", json.dumps(new.metadata()).encode())
        if is_label:
            more = np.asarray(labels if labels is not None else np.zeros(size - len(x)))
            if more.dtype.kind == "M":
                more = more.astype("datetime64[ns]").astype(np.int64)
            new.write((0,), np.concatenate([x, more.astype(x.dtype)]))
        else:
            out[n] = new
    return out


def validate_chunk(key: ChunkKey, sizes: Mapping[str, int], template_sizes: Mapping[str, int], unit: Mapping[str, int], labels: Mapping[str, Any] | None = None, template_labels: Mapping[str, Any] | None = None) -> None:
    """A chunk to write must begin at a stored unit and hold whole ones up to the dimension's end, with the template's labels."""
    for d, x in (labels or {}).items():
        if d not in (template_labels or {}):
            raise ValueError(f"the chunk has labels along {d!r}, which the template lacks")
        o = key.offsets.get(d, 0)
        if not np.array_equal(np.asarray(template_labels[d])[o : o + len(x)], x):
            raise ValueError(f"the chunk's labels along {d!r} differ from the template's")
    for d, n in sizes.items():
        o = key.offsets.get(d, 0)
        if o < 0 or o and o >= template_sizes[d]:
            raise ValueError(f"offset {o} lies outside the {template_sizes[d]} positions of {d!r}")
        if o % unit[d]:
            raise ValueError(f"offset {o} along {d!r} is no multiple of the stored chunk size {unit[d]}")
        if n % unit[d] and o + n != template_sizes[d]:
            raise ValueError(f"the chunk at offset {o} along {d!r} has {n} positions: not whole stored chunks of {unit[d]}, nor up to the end")


def write_cells(df: DataFrame, dims: Sequence[str], metas: Mapping[str, ArrayMeta]) -> int:
    """Write cells whose stored units are complete; returns their number. One task writes each unit; missing cells keep the fill value where the type has NaN."""
    first = next(iter(metas.values()))
    unit, shape = first.unit(), first.shape
    names = list(metas)
    template = Template(dict(zip(dims, shape, strict=True)), {n: Variable(tuple(dims), np.dtype(m.dtype)) for n, m in metas.items()})

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        from ..operators.cube import block_of

        at = [k.as_py() for k in key] if dims else []
        offsets = {d: i * u for d, i, u in zip(dims, at, unit, strict=True)}
        sizes = {d: min(u, n - offsets[d]) for d, u, n in zip(dims, unit, shape, strict=True)}
        try:
            validate_chunk(ChunkKey(offsets), sizes, template.sizes, dict(zip(dims, unit, strict=True)))
            b = block_of(cells, template, names, tuple(dims), offsets, sizes)
            for n, m in metas.items():
                m.write(at, b[n])
        except Exception as e:
            raise RuntimeError(f"failed to write the chunk at {ChunkKey(offsets)}: {e}") from e
        return pa.table({"cells": pa.array([len(cells)], pa.int64())})

    keyed = df.select(*dims, *names).withColumns({f"at_{d}": G.index_of(F.col(d), u) for d, u in zip(dims, unit, strict=True)})
    keys = [f"at_{d}" for d in dims]
    done = keyed.groupBy(*(keys or [F.lit(0).alias("one")])).applyInArrow(run, "cells bigint")
    return done.agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]


def write_blocks(blocks: DataFrame, dims: Sequence[str], metas: Mapping[str, ArrayMeta]) -> int:
    """Write a table of blocks that hold whole stored units, each by the task that has it; returns the number of cells."""
    first = next(iter(metas.values()))
    unit, shape = dict(zip(dims, first.unit(), strict=True)), dict(zip(dims, first.shape, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators.cube import unpacked

        for batch in batches:
            for row in batch.to_pylist():
                key = ChunkKey({d: row[f"{d}_offset"] for d in dims})
                try:
                    b = unpacked(row["variables"])
                    validate_chunk(key, b.sizes, shape, unit)
                    for n, m in metas.items():
                        for k in np.ndindex(*[-(-b.sizes[d] // unit[d]) for d in dims]):
                            part = tuple(slice(i * unit[d], min((i + 1) * unit[d], b.sizes[d])) for i, d in zip(k, dims, strict=True))
                            m.write([key.offsets[d] // unit[d] + i for i, d in zip(k, dims, strict=True)], b[n][part])
                except Exception as e:
                    raise RuntimeError(f"failed to write the chunk at {key}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([b[next(iter(metas))].size], pa.int64())], names=["cells"])

    return blocks.mapInArrow(run, "cells bigint").agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]


def write_cube(cube, path: str, zarr_chunks: Mapping[str, int] | int | str | None = None, zarr_shards: Any = None, zarr_chunks_per_shard: Any = None, zarr_format: int | None = None, encoding: Mapping[str, Mapping[str, Any]] | None = None, needs_setup: bool = True) -> dict[str, float]:
    """Write a cube: metadata when the action runs, then every stored unit by one task. Returns cells, bytes (uncompressed) and seconds.

    Chunks that are at hand as blocks (made by a function, or whole units of another store) are written as they are; else cells are dealt by stored unit.

    zarr_chunks defaults to the cube's chunks. Shards (format 3) are given by size with zarr_shards, or are the cube's chunks if only zarr_chunks_per_shard is given.
    """
    t, sizes = cube.template, cube.template.sizes
    if zarr_chunks is not None and zarr_chunks_per_shard is not None:
        raise ValueError("give zarr_chunks or zarr_chunks_per_shard, not both")
    if zarr_shards is not None and zarr_chunks is None and zarr_chunks_per_shard is None:
        raise ValueError("zarr_shards need zarr_chunks or zarr_chunks_per_shard")
    norm = lambda spec, prev: G.normalize_chunks(spec, sizes, t.itemsizes(), cube.split_vars, prev)
    shards = None
    if zarr_shards is not None or zarr_chunks_per_shard is not None:
        shards = norm(zarr_shards, cube.chunks) if zarr_shards is not None else dict(cube.chunks)
    if zarr_chunks_per_shard is not None:
        chunks = shards_of({}, zarr_chunks_per_shard, shards)
    else:
        chunks = norm(zarr_chunks, cube.chunks) if zarr_chunks is not None else dict(cube.chunks)
    if shards is not None:
        whole_dims = {d for d, s in shards.items() if s == sizes[d]}
        shards = {d: -(-s // chunks[d]) * chunks[d] if d in whole_dims else s for d, s in shards.items()}
        check_multiples("shards", {d: s if d not in whole_dims else sizes[d] for d, s in shards.items()}, cube.chunks, sizes)
    else:
        check_multiples("chunks", chunks, cube.chunks, sizes)
    metas = setup(t, path, chunks, shards, zarr_format, encoding) if needs_setup else {n: open_array(f"{path.rstrip('/')}/{n}") for n in t.variables}
    done = {"cells": 0, "bytes": 0}
    began = time.perf_counter()
    for dims, df in cube.tables.items():
        names = [n for n in cube.names_over(dims)]
        own = {n: metas[n] for n in names}
        order = t.variables[names[0]].dims
        with stage(df.sparkSession, f"write {', '.join(names)} to {path}"):
            if order == dims and dims and (blocks := cube._as_blocks()) is not None:
                cells = write_blocks(blocks, order, own)
            elif any(t.variables[n].dims != order for n in names):
                cells = [write_cells(df, t.variables[n].dims, {n: own[n]}) for n in names][0]
            else:
                cells = write_cells(df, order, own)
        done["cells"] += cells
        done["bytes"] += cells * sum(t.variables[n].dtype.itemsize for n in names)
    return {**done, "seconds": time.perf_counter() - began}


def write_dataframe(df: DataFrame, dims: Sequence[str], path: str, template: Template | Callable[[], Template] | None = None, chunks: Any = -1, **options: Any) -> dict[str, float]:
    """Write a cell table; returns what write_cube does. A template may also be a function that makes it, called when the action runs.

    Without a template its sizes are found in the data, which takes a pass over it and is better avoided.
    """
    from ..operators.cube import Cube

    if callable(template):
        if not options.get("needs_setup", True):
            raise ValueError("needs_setup=False needs a template that is there already")
        template = template()
    if template is None:
        if not options.get("needs_setup", True):
            raise ValueError("needs_setup=False needs a template")
        warnings.warn("no template was given: the sizes are found in the data. Pass template=", FutureWarning, stacklevel=2)
        cube = Cube.from_dataframe(df, dims, chunks=chunks)
    elif not isinstance(template, Template):
        raise TypeError(f"template must be a Template, not {type(template).__name__}")
    else:
        grid = G.normalize_chunks(chunks, template.sizes, template.itemsizes(), False, template.sizes)
        cube = Cube({tuple(dims): df.select(*dims, *template.variables)}, template, grid)
    return write_cube(cube, path, **options)
