import pickle
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessel.functions import grid as G
from tessel.functions.key import ChunkKey, canonical, key_column


def test_key_basics():
    k = ChunkKey({"y": 2, "x": 0}, {"a"})
    assert k == ChunkKey({"x": 0, "y": 2}, {"a"}) and hash(k) == hash(ChunkKey({"x": 0, "y": 2}, {"a"}))
    assert k != ChunkKey({"x": 0}, {"a"}) and k != ChunkKey({"x": 0, "y": 2}) and k != "k"
    assert ChunkKey({"x": 0}) != ChunkKey()
    assert pickle.loads(pickle.dumps(k)) == k
    assert repr(ChunkKey()) == "ChunkKey()" and "vars={'a'}" in repr(k) and "indices" not in repr(k)
    assert k.replace(vars=None) == ChunkKey({"x": 0, "y": 2})
    assert k.replace(offsets={}, indices={"x": 1}) == ChunkKey(indices={"x": 1}, vars={"a"})
    with pytest.raises(AttributeError):
        k.vars = None
    with pytest.raises(TypeError):
        k.offsets["x"] = 3


def test_key_changes_and_errors():
    k = ChunkKey({"x": 0})
    assert k.with_offsets(y=1) == ChunkKey({"x": 0, "y": 1}) and k.with_offsets(x=None) == ChunkKey()
    assert ChunkKey(indices={"x": 1}).with_indices(x=2, y=3) == ChunkKey(indices={"x": 2, "y": 3})
    with pytest.raises(KeyError):
        k.with_offsets(z=None)
    with pytest.raises(ValueError):
        ChunkKey({"x": 0}, indices={"x": 0})
    with pytest.raises(TypeError):
        ChunkKey({"x": 0}, "ab")
    with pytest.raises(ValueError):
        k.with_indices(x=1)
    with pytest.raises(ValueError):
        ChunkKey(indices={"x": 1}).with_offsets(x=0)
    assert ChunkKey({}, indices={"x": 0}).indices == {"x": 0}


def test_key_column_groups(spark):
    df = spark.range(10).selectExpr("id % 2 AS x", "id % 3 AS y")
    assert df.select(canonical(key_column(["y", "x"], {"v"})).alias("k")).distinct().count() == 6
    assert df.select(key_column(["x"]).alias("k")).first()["k"]["vars"] is None


def test_slices():
    assert G.offsets_to_slices({"x": 10}, {"x": 5, "y": 2}) == {"x": slice(10, 15, 1), "y": slice(0, 2, 1)}
    assert G.offsets_to_slices({"x": 10}, {"x": 5}, {"x": 8}) == {"x": slice(2, 7, 1)}
    with pytest.raises(ValueError):
        G.offsets_to_slices({"z": 1}, {"x": 5})


def test_grids():
    assert G.block_offsets({"x": (3, 3, 2)}) == {"x": [0, 3, 6]}
    assert [dict(k.offsets) for k in G.chunk_keys({"x": [0, 3], "y": [0, 2]})] == [{"x": 0, "y": 0}, {"x": 0, "y": 2}, {"x": 3, "y": 0}, {"x": 3, "y": 2}]
    assert list(G.chunk_keys({})) == [ChunkKey()]
    assert G.offset_ordinals({"x": [0, 3, 6]}) == {"x": {0: 0, 3: 1, 6: 2}}
    assert G.regular_chunks({"x": (3, 3, 2), "y": (4,), "z": ()}) == {"x": 3, "y": 4, "z": 0}
    for bad in ((3, 2, 3), (3, 4)):
        with pytest.raises(ValueError):
            G.regular_chunks({"x": bad})
    assert G.expand_chunks({"x": 3, "y": -1, "z": (1, 4)}, {"x": 8, "y": 2, "z": 5, "w": 1}) == {"x": (3, 3, 2), "y": (2,), "z": (1, 4), "w": (1,)}
    with pytest.raises(ValueError):
        G.expand_chunks({"x": (1, 2)}, {"x": 5})
    assert G.round_key(ChunkKey({"x": 7, "y": 5, "z": 3}), {"x": 3, "y": -1}) == ChunkKey({"x": 6, "y": 0, "z": 3})
    assert G.split_bounds(5, 10, 3) == [(5, 6), (6, 9), (9, 10)] and G.split_bounds(0, 6, 3) == [(0, 3), (3, 6)] and G.split_bounds(2, 5, -1) == [(2, 5)]
    keys = [ChunkKey({"x": x, "y": y}) for x in (0, 2) for y in (0, 3)]
    assert [G.chunk_number(k, ["x", "y"], {"x": 2, "y": 3}, {"x": 4, "y": 6}) for k in keys] == [0, 1, 2, 3]
    assert G.finalize_chunks({"x": -1}, {"x": 4, "y": 2}) == {"x": 4, "y": 2}
    assert G.plain_chunks({"x": -1, "y": (2, 2)}, {"x": 4, "y": 4, "z": 3}) == {"x": 4, "y": 2, "z": 3}
    for bad in ({"q": 1}, {"x": (1, 3)}):
        with pytest.raises(ValueError):
            G.plain_chunks(bad, {"x": 4})


@pytest.mark.parametrize("n, text", [(0, "0 B"), (999, "999 B"), (1000, "1.0 kB"), (12_345, "12 kB"), (1_500_000, "1.5 MB"), (2.5e9, "2.5 GB"), (1e21, "1000 EB")])
def test_human_size(n, text):
    assert G.human_size(n) == text


def test_parse_bytes():
    assert [G.parse_bytes(s) for s in ("80B", "100 MB", "64KiB", "1.5kB", "2GiB")] == [80, 100_000_000, 65536, 1500, 2 << 30]
    with pytest.raises(ValueError):
        G.parse_bytes("lots")


GOLDEN = [
    ({"x": 20, "y": 30}, {"v": 8}, False, -1, None, (20, 30)),
    ({"x": 20, "y": 30}, {"v": 8}, False, {"x": -1}, None, (20, 30)),
    ({"x": 10, "y": 2}, {"v": 8}, False, {"x": 5}, None, (5, 2)),
    ({"x": 5, "y": 4}, {"v": 8}, False, "80B", (5, 1), (5, 2)),
    ({"x": 10}, {"v": 8}, False, "128MiB", None, (10,)),
    ({"x": 2**20}, {"v": 8}, False, "64KiB", None, (8192,)),
    ({"x": 100, "y": 100}, {"v": 1}, False, "1KiB", None, (32, 32)),
    ({"x": 8192}, {"a": 8, "b": 8}, False, "64KiB", None, (4096,)),
    ({"x": 8192}, {"a": 8, "b": 1}, True, "32KiB", None, (4096,)),
    ({"x": 10}, {"v": 8}, False, {}, (5,), (5,)),
    ({"x": 10}, {"v": 8}, False, {"x": 100}, None, (10,)),
    ({"x": 100, "y": 100}, {"v": 8}, False, "8000B", (10, 25), (20, 50)),
    ({"x": 100, "y": 100, "z": 100}, {"v": 8}, False, {"x": 10, ...: 20}, None, (10, 20, 20)),
    ({"time": 365, "lat": 100, "lon": 200}, {"v": 4}, True, {"time": -1, ...: "292000B"}, (31, 100, 200), (365, 10, 20)),
    ({"x": 12}, {"v": 8}, False, "24B", (6,), (3,)),
    ({"x": 12}, {"v": 8}, False, "48B", (6,), (6,)),
]


@pytest.mark.parametrize("sizes, items, split, spec, previous, expected", GOLDEN)
def test_normalize_chunks(sizes, items, split, spec, previous, expected):
    previous = dict(zip(sizes, previous, strict=True)) if previous else None
    assert G.normalize_chunks(spec, sizes, items, split, previous) == dict(zip(sizes, expected, strict=True))


def test_normalize_chunks_errors():
    sizes, items = {"x": 10, "y": 10}, {"v": 8}
    for bad in ("auto", {"x": "auto"}, {"x": "1kB", "y": "2kB"}, {"z": 1}, {"x": "much"}, {"x": (3, 4, 3)}):
        with pytest.raises(ValueError):
            G.normalize_chunks(bad, sizes, items)
    with pytest.raises(TypeError):
        G.normalize_chunks(1.5, sizes, items)


@given(st.integers(1, 500), st.integers(1, 500), st.integers(1, 100_000), st.sampled_from([1, 4, 8]))
def test_byte_solver_stays_in_budget(n, m, budget, item):
    got = G.normalize_chunks(f"{budget}B", {"x": n, "y": m}, {"v": item}, False, None)
    assert 1 <= got["x"] <= n and 1 <= got["y"] <= m
    assert got["x"] * got["y"] * item <= max(budget, item * max(got.values())) or 1 in got.values()


def test_infer_chunks():
    assert G.infer_chunks({"x": 10, "y": 6}, {"x": 5, "y": 3}, {"x": 10, "y": 2, "z": 7}) == {"x": 5, "y": 1, "z": 7}
    for old, chunks, new in (({"x": 10}, {"x": 5}, {"x": 3}), ({"x": 10}, {"x": 4}, {"x": 5})):
        with pytest.raises(ValueError):
            G.infer_chunks(old, chunks, new)


def test_columns_agree_with_driver(spark):
    from pyspark.sql import functions as F

    rows = spark.range(50).select("id", G.offset_of(F.col("id"), 7).alias("o"), G.index_of(F.col("id"), 7).alias("k"), G.split_offset_of(F.col("id"), 20, 7).alias("s")).collect()
    for r in rows:
        i = r["id"]
        assert r["o"] == G.round_key(ChunkKey({"x": i}), {"x": 7}).offsets["x"] and r["k"] == i // 7
        a = i // 20 * 20
        assert r["s"] == next(b for b, e in G.split_bounds(a, a + 20, 7) if b <= i < e)
    random.seed(1)
