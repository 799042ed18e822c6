import json

import numpy as np
import pytest

from tessel import cli
from tessel.functions.key import ChunkKey
from tessel.operators.block import Block
from tessel.operators.cube import Cube
from tessel.operators.threads import thread_map, thread_map_batches
from tessel.sources import ranges, zarr

RNG = np.random.default_rng(1)


def block(n=12, m=6):
    times = np.datetime64("2000-01-01", "ns") + np.arange(n) * np.timedelta64(6, "h")
    return Block({"foo": (("time", "x"), RNG.normal(size=(n, m)).astype("f4")), "flag": (("x",), np.arange(m))}, {"time": times, "x": np.linspace(0, 1, m)}, {"title": "t"})


@pytest.mark.parametrize("options", [{}, {"zarr_format": 3}, {"zarr_shards": {"time": 6}, "zarr_chunks": {"time": 3, "x": 2}}, {"zarr_chunks_per_shard": 2}, {"zarr_chunks": {"time": 2}, "zarr_format": 2}])
def test_roundtrip(spark, tmp_path, options):
    b = block()
    c = Cube.from_block(spark, b, {"time": 6, "x": 6})
    c.to_zarr(str(tmp_path / "s"), **options)
    back = Cube.from_zarr(spark, str(tmp_path / "s"))
    got = back.collect()
    assert got.equals(b) and got.attrs["title"] == "t" and got.labels["time"][3] == b.labels["time"][3]
    part = back.isel(time=slice(7, 11))
    assert np.array_equal(part.collect()["foo"], b["foo"][7:11]) and part.sizes["time"] == 4
    assert part.tables[("time", "x")].rdd.getNumPartitions() < back.tables[("time", "x")].rdd.getNumPartitions() or back.chunks["time"] >= 12
    assert np.array_equal(back.tail(time=3).collect()["foo"], b["foo"][-3:]) and back.collect().equals(b)


@pytest.mark.parametrize("compressor", ["gzip", "zstd", "zlib", "lz4", None])
def test_codecs(spark, tmp_path, compressor):
    b = Block({"v": (("x",), np.arange(10))})
    formats = (2, 3) if compressor in ("gzip", "zstd", None) else (2,)
    for f in formats:
        p = str(tmp_path / f"s{f}")
        Cube.from_block(spark, b, 4).to_zarr(p, zarr_format=f, encoding={"v": {"compressor": compressor, "crc32c": True}})
        assert Cube.from_zarr(spark, p).collect().equals(b)


def test_crc32c_vector():
    assert zarr.crc32c(b"123456789") == 0xE3069283


def test_setup_errors(spark, tmp_path):
    c = Cube.from_block(spark, block(), {"time": 6, "x": 3})
    p = str(tmp_path / "s")
    for bad in ({"zarr_chunks": 2, "zarr_chunks_per_shard": 2}, {"zarr_shards": 6}, {"zarr_chunks": {"time": 4}}, {"zarr_chunks": {"time": 4}, "zarr_shards": {"time": 6}}, {"zarr_chunks_per_shard": {"q": 2}}, {"zarr_chunks_per_shard": {"time": 4}},
                {"encoding": {"nope": {}}}, {"encoding": {"foo": {"chunks": 2}}}, {"zarr_chunks_per_shard": 1, "zarr_format": 2}):
        with pytest.raises(ValueError):
            c.to_zarr(p, **bad)
    with pytest.raises(TypeError):
        zarr.open_template(p, chunks={"x": 1})
    with pytest.raises(ValueError):
        zarr.open_store(str(tmp_path / "none"))


def test_inconsistent_chunks(tmp_path):
    p = str(tmp_path)
    for n, c in (("a", 2), ("b", 3)):
        zarr.put(f"{p}/{n}/.zarray", json.dumps(zarr.ArrayMeta(p, ("x",), (6,), "int64", (c,), None, 0, 2, None, ".").metadata()).encode())
        zarr.put(f"{p}/{n}/.zattrs", b'{"_ARRAY_DIMENSIONS": ["x"]}')
    with pytest.raises(ValueError, match="differ"):
        zarr.open_template(p)


def test_fill_and_blosc(spark, tmp_path):
    p = str(tmp_path)
    meta = zarr.ArrayMeta(f"{p}/v", ("x",), (4,), "float64", (2,), None, float("nan"), 2, None, ".")
    zarr.put(f"{p}/v/.zarray", json.dumps(meta.metadata()).encode())
    zarr.put(f"{p}/v/.zattrs", b'{"_ARRAY_DIMENSIONS": ["x"]}')
    meta.write((0,), np.array([1.0, 2.0]))
    got = Cube.from_zarr(spark, p).collect()["v"]
    assert got[:2].tolist() == [1, 2] and np.isnan(got[2:]).all()
    with pytest.raises(ValueError, match="blosc"):
        zarr.ArrayMeta(p, ("x",), (4,), "float64", (2,), None, 0, 2, ("blosc", None), ".").decode(b"", (2,))


def test_append(spark, tmp_path):
    p = str(tmp_path / "s")
    whole = Block({"foo": (("t", "x"), np.arange(15.0).reshape(3, 5))}, {"t": np.array([100, 101, 102])})
    first = whole.isel(t=slice(0, 2))
    Cube.from_block(spark, first, {"t": 1}).to_zarr(p)
    metas = zarr.extend(p, "t", 3, np.array([102]))
    cells = Cube.from_block(spark, whole, {"t": 1}).df.where("t = 2")
    zarr.write_cells(cells, ["t", "x"], {"foo": metas["foo"]})
    got = Cube.from_zarr(spark, p).collect()
    assert got.equals(whole) and got.labels["t"].tolist() == [100, 101, 102]


def test_write_failure_names_the_chunk(spark, tmp_path):
    c = Cube.from_dataframe(spark.createDataFrame([(0, 1)], "x bigint, v int"), ["x"], sizes={"x": 2}, chunks=2)
    with pytest.raises(Exception, match="failed to write the chunk at ChunkKey"):
        c.to_zarr(str(tmp_path / "s"))


def test_validate_chunk():
    ok = ({"x": 4}, {"x": 10}, {"x": 2})
    zarr.validate_chunk(ChunkKey({"x": 4}), *ok)
    zarr.validate_chunk(ChunkKey({"x": 8}), {"x": 2}, {"x": 10}, {"x": 4}, {"x": [8, 9]}, {"x": np.arange(10)})
    for args in ((ChunkKey({"x": 3}), *ok), (ChunkKey({"x": 4}), {"x": 3}, {"x": 10}, {"x": 2}), (ChunkKey(), *ok, {"x": [9, 9, 9, 9]}, {"x": np.arange(10)}), (ChunkKey(), *ok, {"x": [0]}, {})):
        with pytest.raises(ValueError):
            zarr.validate_chunk(*args)


def test_programs(spark, tmp_path):
    assert cli.parse_chunks("time=-1,...=100MB") == {"time": -1, ...: "100MB"} and cli.parse_chunks("-1") == -1 and cli.parse_chunks("10MB") == "10MB"
    with pytest.raises(ValueError):
        cli.parse_chunks("a=1,b")
    b = block(n=160, m=4)
    a, out, clim = (str(tmp_path / x) for x in ("a", "b", "c"))
    Cube.from_block(spark, b, {"time": 31}).to_zarr(a)
    cli.rechunk(spark, a, out, cli.parse_chunks("time=-1,...=1"))
    got = Cube.from_zarr(spark, out)
    assert got.chunks == {"time": 160, "x": 1} and got.collect().equals(b)
    cli.rechunk(spark, a, out + "s", cli.parse_chunks("time=8,x=2"), cli.parse_chunks("time=16,x=4"))
    assert Cube.from_zarr(spark, out + "s").collect().equals(b)
    cli.climatology(spark, a, clim)
    m = Cube.from_zarr(spark, clim).collect()
    months = b.labels["time"].astype("datetime64[M]").astype(int) % 12
    assert m["foo"].shape == (12, 4, 4) and np.allclose(m["foo"][1, 2], b["foo"][(months == 1) & (np.arange(160) % 4 == 2)].mean(0)) and np.isnan(m["foo"][6]).all()


def test_threads_and_ranges(spark):
    assert list(thread_map(lambda x, k: x * k, range(50), 3)) == [3 * x for x in range(50)]
    assert list(thread_map(lambda a, b: [a, b], [(1, 2), (3, 4)], star=True, flat=True, num_threads=None)) == [1, 2, 3, 4]
    assert thread_map_batches(spark.range(10), lambda p: p * 2, "id long").agg({"id": "sum"}).first()[0] == 90
    assert ranges.bundles(10, 8, 24) == [(0, 3), (3, 6), (6, 9), (9, 10)] and ranges.bundles(3, 0, 2) == [(0, 2), (2, 3)] and ranges.bundles(0, 1, 1) == []
    for bad in ((-1, 1), (1, -1)):
        with pytest.raises(ValueError):
            ranges.bundles(*bad, 1)
    assert ranges.range_source(spark, 10, 8, 24).count() == 10
    assert ranges.range_elements(spark, 5, 1, lambda i: {"index": i, "sq": i * i}, "index long, sq long").agg({"sq": "sum"}).first()[0] == 30


def test_stream_extension(spark, tmp_path):
    from tessel.streaming.running import windowed_means

    spark.sql("SELECT timestamp'2000-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts, double(id) AS v, 'a' AS g FROM range(120)").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, v double, g string").parquet(str(tmp_path / "in"))
    q = windowed_means(s, "ts", ["g"], ["v"], "1 hour", "0 minutes").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["v"] for r in spark.sql("SELECT v FROM w").collect()) == [29.5, 89.5]


def test_write_dataframe_and_custom_sinks(spark, tmp_path):
    df = spark.range(10).selectExpr("id AS x", "double(id) AS v")
    with pytest.warns(FutureWarning):
        zarr.write_dataframe(df, ["x"], str(tmp_path / "a"), chunks=4)
    c = Cube.from_zarr(spark, str(tmp_path / "a"))
    zarr.write_dataframe(df, ["x"], str(tmp_path / "b"), c.template, chunks=5)
    assert Cube.from_zarr(spark, str(tmp_path / "b")).collect().equals(c.collect())
    with pytest.raises(TypeError):
        zarr.write_dataframe(df, ["x"], str(tmp_path / "c"), {"x": 10})
    with pytest.raises(ValueError):
        zarr.write_dataframe(df, ["x"], str(tmp_path / "c"), needs_setup=False)
    out = str(tmp_path)

    def save(key, block):
        np.save(f"{out}/{key.offsets['x']}.npy", block["v"])

    assert c.foreach_block(save) == 3 and np.load(f"{out}/8.npy").tolist() == [8, 9]
    seen, counts = c.observed("copy")
    seen.df.count()
    assert counts[("x",)].get == {"cells": 10, "v_present": 10}


def partitions(cube):
    return cube.df.rdd.getNumPartitions()


def plan(df):
    return df._jdf.queryExecution().toString()


def test_selections_reach_the_store(spark, tmp_path):
    """Variables and bounds stay with the source through selections, transposes and further bounds."""
    p = str(tmp_path / "s")
    b = Block({n: (("t", "x"), RNG.normal(size=(20, 6))) for n in ("a", "b")})
    Cube.from_block(spark, b, {"t": 2, "x": 6}).to_zarr(p)
    c = Cube.from_zarr(spark, p)
    full = partitions(c)
    assert full >= 4
    for part in (c["a"].head(t=2), c.head(t=2)["a"], c["a"].transpose("x", "t").head(t=2), c.isel(t=slice(4, 12))["a"].isel(t=slice(2, 4))):
        assert partitions(part) == 1 and "b" not in part.df.columns
    cut = c.isel(t=slice(4, 12)).transpose("x", "t").isel(t=slice(1, 5), x=slice(2, 6))["b"]
    assert np.array_equal(cut.collect()["b"], b["b"][5:9, 2:6].T)
    assert "[t#" in plan(c["a"].df) and "b#" not in plan(c["a"].df)


def test_blocks_of_a_store_need_no_exchange(spark, tmp_path):
    p, q, r = (str(tmp_path / n) for n in "pqr")
    b = Block({n: (("t", "x"), RNG.normal(size=(20, 6))) for n in ("a", "b")}, {"t": np.array([f"day {k}" for k in range(20)])})
    Cube.from_block(spark, b, {"t": 2, "x": 3}).to_zarr(p, zarr_format=3)
    c = Cube.from_zarr(spark, p).rechunk({"t": 4, "x": -1})
    m = c.map_blocks(lambda k: k.map(lambda v: v - v.mean(axis=1, keepdims=True)))
    assert "Exchange" not in plan(m.df) and "Exchange" not in plan(m.blocks)
    want = b.map(lambda v: v - v.mean(axis=1, keepdims=True))
    assert np.allclose(m.collect()["a"], want["a"]) and m.collect().labels["t"].tolist() == b.labels["t"].tolist()
    m.to_zarr(q, zarr_chunks={"t": 2, "x": 3})
    back = Cube.from_zarr(spark, q)
    assert np.allclose(back.collect()["b"], want["b"]) and back.chunks == {"t": 2, "x": 3} and back.template.labels["t"].tolist() == b.labels["t"].tolist()
    # chunks across all units are dealt by cells
    assert Cube.from_zarr(spark, p).rechunk({"t": -1, "x": 1})._as_blocks() is None
    part = Cube.from_zarr(spark, p).isel(t=slice(3, 17)).rechunk({"t": 5, "x": 3})
    part.to_zarr(r)
    assert Cube.from_zarr(spark, r).collect().equals(b.isel(t=slice(3, 17)))


def test_only_inner_chunks_of_a_shard_are_read(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "s")
    b = Block({"v": (("t", "x"), np.arange(96.0).reshape(8, 12))})
    Cube.from_block(spark, b, -1).to_zarr(p, zarr_chunks={"t": 2, "x": 3}, zarr_shards={"t": 8, "x": 12}, encoding={"v": {"crc32c": True}})
    meta = zarr.open_array(f"{p}/v")
    decoded = []
    inner = zarr.ArrayMeta.decode
    monkeypatch.setattr(zarr.ArrayMeta, "decode", lambda self, data, shape: decoded.append(1) or inner(self, data, shape))
    assert np.array_equal(meta.read((0, 0), (slice(3, 5), slice(4, 6))), b["v"][3:5, 4:6]) and len(decoded) == 2
    assert np.array_equal(meta.read((0, 0)), b["v"]) and len(decoded) == 18


def slow_crc32c(data):
    crc = 0xFFFFFFFF
    for x in data:
        crc ^= x
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@pytest.mark.parametrize("n", [0, 1, 1000, 2047, 2048, 5000, 70_001])
def test_crc32c_of_any_length(n):
    data = RNG.bytes(n)
    assert zarr.crc32c(data) == slow_crc32c(data)


def blosc(data, width, shuffle, codec, block, split):
    """The container, written plainly: 1 byte shuffle, 2 bit shuffle; codec 1 lz4, 3 zlib, 4 zstd."""
    import pyarrow as pa
    import struct
    import zlib

    pack = {1: lambda x: pa.Codec("lz4_raw").compress(x).to_pybytes(), 3: zlib.compress, 4: lambda x: pa.Codec("zstd").compress(x).to_pybytes()}[codec]
    blocks = []
    for k in range(0, len(data), block):
        x = np.frombuffer(data[k : k + block], np.uint8)
        n = len(x) // width
        if shuffle == 1:
            x = np.concatenate([x[: n * width].reshape(n, width).T.ravel(), x[n * width :]])
        if shuffle == 2:
            m = n // 8 * 8
            bits = np.unpackbits(x[: m * width].reshape(m, width, 1), axis=2, bitorder="little")
            x = np.concatenate([np.packbits(bits.transpose(1, 2, 0), axis=2, bitorder="little").ravel(), x[m * width :]])
        streams = width if split and len(x) == block and width <= 16 and block // width >= 128 else 1
        out = b""
        for part in x.reshape(streams, -1):
            held = pack(part.tobytes())
            held = held if len(held) < len(part) else part.tobytes()
            out += struct.pack("<i", len(held)) + held
        blocks.append(out)
    starts = np.cumsum([16 + 4 * len(blocks), *map(len, blocks)])[:-1]
    body = struct.pack(f"<{len(blocks)}i", *starts) + b"".join(blocks)
    flags = {0: 0, 1: 1, 2: 4}[shuffle] | codec << 5 | (0 if split else 16)
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(data), block, 16 + len(body)) + body


@pytest.mark.parametrize("codec", [1, 3, 4])
@pytest.mark.parametrize("shuffle", [0, 1, 2])
@pytest.mark.parametrize("split", [False, True])
def test_blosc_containers(codec, shuffle, split):
    for width, n in ((8, 5003), (4, 4096), (1, 999)):
        data = np.cumsum(RNG.integers(0, 3, n)).astype(f"i{width}" if width > 1 else "u1").tobytes()
        for block in (1024, 2048, len(data)):
            assert zarr.blosc_decompress(blosc(data, width, shuffle, codec, block, split)) == data
    raw = RNG.bytes(100)
    import struct

    assert zarr.blosc_decompress(struct.pack("<BBBBIII", 2, 1, 2, 4, 100, 100, 116) + raw) == raw
    with pytest.raises(ValueError, match="blosclz"):
        zarr.blosc_decompress(struct.pack("<BBBBIII", 2, 1, 0, 4, 100, 100, 116) + raw)


def test_blosc_and_fortran_stores(spark, tmp_path):
    """A store of format 2 as other writers leave it: blosc chunks in Fortran order."""
    p = str(tmp_path)
    x = RNG.normal(size=(6, 4)).astype("f4")
    meta = zarr.ArrayMeta(f"{p}/v", ("t", "x"), (6, 4), "float32", (4, 4), None, float("nan"), 2, None, ".", order="F")
    told = meta.metadata() | {"compressor": {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1, "blocksize": 0}}
    zarr.put(f"{p}/v/.zarray", json.dumps(told).encode())
    zarr.put(f"{p}/v/.zattrs", b'{"_ARRAY_DIMENSIONS": ["t", "x"]}')
    for k in range(2):
        part = np.full((4, 4), np.nan, "f4")
        part[: min(4, 6 - 4 * k)] = x[4 * k : 4 * k + 4]
        zarr.put(meta.file_of((k, 0)), blosc(part.tobytes("F"), 4, 1, 1, 64, True))
    assert np.array_equal(Cube.from_zarr(spark, p).collect()["v"], x)


@pytest.mark.parametrize("zarr_format", [2, 3])
def test_string_labels(spark, tmp_path, zarr_format):
    b = Block({"v": (("x",), np.arange(3.0))}, {"x": np.array(["a", "", "größer"])})
    Cube.from_block(spark, b, 2).to_zarr(str(tmp_path / "s"), zarr_format=zarr_format)
    assert Cube.from_zarr(spark, str(tmp_path / "s")).collect().labels["x"].tolist() == ["a", "", "größer"]
    with pytest.raises(ValueError, match="no stored form"):
        Cube.from_block(spark, Block({"v": (("x",), np.arange(1.0))}, {"x": np.array([1j])}), 1).to_zarr(str(tmp_path / "c"))


def test_eager_variables_are_stored_with_the_metadata(spark, tmp_path):
    b = Block({"v": (("t", "x"), np.arange(12.0).reshape(4, 3))})
    c = Cube.from_block(spark, b, {"t": 2})
    mask, year = np.array([1, 0, 1]), np.array(1979)
    t = c.template.with_values(mask=(("x",), mask), year=((), year))
    for zarr_format in (2, 3):
        p = str(tmp_path / f"s{zarr_format}")
        Cube(c.tables, t, c.chunks).to_zarr(p, zarr_format=zarr_format)
        got = Cube.from_zarr(spark, p).collect()
        assert np.array_equal(got["v"], b["v"]) and got["mask"].tolist() == [1, 0, 1] and got["year"] == 1979
    assert t.drop_dims("x").eager.keys() == {"year"} and t.select(["v", "mask"]).eager.keys() == {"mask"} and t.replace_dims(t=9).sizes["t"] == 9
    for bad in (lambda: t.replace_dims(x=9), lambda: t.with_values(mask=(("x",), [1])), lambda: t.with_values(v=((), 1))):
        with pytest.raises(ValueError):
            bad()


def test_metrics_labels_and_deferred_templates(spark, tmp_path):
    from tessel.operators.labels import stage, unique

    df = spark.range(10).selectExpr("id AS x", "double(id) AS v")
    c = Cube.from_dataframe(df, ["x"], chunks=4)
    told = c.to_zarr(str(tmp_path / "a"))
    assert (told["cells"], told["bytes"]) == (10, 80) and told["seconds"] > 0
    again = Cube.from_zarr(spark, str(tmp_path / "a")).to_zarr(str(tmp_path / "b"))
    assert (again["cells"], again["bytes"]) == (10, 80)
    zarr.write_dataframe(df, ["x"], str(tmp_path / "c"), lambda: c.template, chunks=5)
    assert Cube.from_zarr(spark, str(tmp_path / "c")).chunks == {"x": 5}
    with pytest.raises(ValueError):
        zarr.write_dataframe(df, ["x"], str(tmp_path / "d"), lambda: c.template, needs_setup=False)
    seen, counts = c.observed("sized", with_bytes=True)
    seen.df.count()
    assert counts[("x",)].get == {"cells": 10, "bytes": 80, "v_present": 10}
    assert (unique("a stage"), unique("a stage"), unique("another")) == ("a stage", "a stage-1", "another")
    with stage(spark, "outer") as name:
        with stage(spark, "outer") as inner:
            assert spark.sparkContext.getLocalProperty("spark.job.description") == inner == "outer-1"
        assert spark.sparkContext.getLocalProperty("spark.job.description") == name == "outer"
