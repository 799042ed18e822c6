import numpy as np
import pytest

from tessel.functions.key import ChunkKey
from tessel.operators import block as B
from tessel.operators.block import Block


def line(n=10, start=0):
    return Block({"foo": (("x",), np.arange(start, start + n))})


def test_split_is_ragged_at_the_front():
    parts = [p for o in (0, 5) for p in B.split_chunks(ChunkKey({"x": o}), line(5, o), {"x": 3})]
    assert [(k.offsets["x"], b.sizes["x"]) for k, b in parts] == [(0, 3), (3, 2), (5, 1), (6, 3), (9, 1)]
    key, whole = B.consolidate_chunks(parts)
    assert key == ChunkKey({"x": 0}) and whole.equals(line())


def test_split_ignores_absent_dims_and_2d_roundtrip():
    b = Block({"v": (("x", "y"), np.arange(60).reshape(6, 10))}, {"y": np.arange(10)})
    parts = list(B.split_chunks(ChunkKey(), b, {"x": 4, "y": 3, "z": 2}))
    assert len(parts) == 8
    key, whole = B.consolidate_chunks(reversed(parts))
    assert whole.equals(b) and key == ChunkKey({"x": 0, "y": 0})
    again = dict(B.rechunk_in_memory(parts, {"x": 2, "y": 10}))
    assert len(again) == 3 and again[ChunkKey({"x": 4, "y": 0})].equals(b.isel(x=slice(4, 6)))
    shifted = list(B.rechunk_in_memory([(ChunkKey({"x": 10}), line(5, 10)), (ChunkKey({"x": 15}), line(5, 15))], {"x": 4}))
    assert [k.offsets["x"] for k, _ in shifted] == [10, 12, 16]


def test_consolidate_errors():
    a, b = (ChunkKey({"x": 0}), line(5)), (ChunkKey({"x": 5}), line(5, 5))
    with pytest.raises(ValueError, match="two chunks"):
        B.consolidate_chunks([a, a])
    with pytest.raises(ValueError, match="no chunks"):
        B.consolidate_chunks([])
    grid = [(ChunkKey({"x": x, "y": y}), Block({"v": (("x", "y"), np.zeros((1, 1)))})) for x, y in ((0, 0), (0, 1), (1, 0))]
    with pytest.raises(ValueError, match="missing"):
        B.consolidate_chunks(grid)
    with pytest.raises(ValueError, match="different dimensions"):
        B.consolidate_chunks([a, (ChunkKey({"x": 5, "y": 0}), line(5))])
    scalar = lambda v, n, o: Block({"foo": (("x",), np.arange(o, o + n)), "bar": ((), np.array(v))})
    key, out = B.consolidate_chunks([(a[0], scalar(1, 5, 0)), (b[0], scalar(1, 5, 5))])
    assert out["bar"] == 1 and key.offsets == {"x": 0}
    with pytest.raises(ValueError, match="differs"):
        B.consolidate_chunks([(a[0], scalar(1, 5, 0)), (b[0], scalar(2, 5, 5))])


def test_variables():
    b = Block({"foo": (("x", "y"), np.zeros((2, 3))), "bar": (("x",), np.ones(2)), "baz": (("z",), np.ones(3))})
    parts = list(B.split_variables(ChunkKey({"x": 2, "y": 0, "z": 0}), b))
    assert [k for k, _ in parts] == [ChunkKey({"x": 2, "y": 0}, {"foo"}), ChunkKey({"x": 2}, {"bar"}), ChunkKey({"z": 0}, {"baz"})]
    same = Block({"a": (("x",), np.zeros(2)), "b": (("x",), np.ones(2))})
    ((key, merged),) = B.consolidate_variables(B.split_variables(ChunkKey({"x": 4}), same))
    assert key == ChunkKey({"x": 4}) and merged.equals(same)
    with pytest.raises(ValueError, match="share"):
        list(B.consolidate_variables([(ChunkKey({"x": 0}, {"a"}), same), (ChunkKey({"x": 0}, {"b"}), same)]))
    key, whole = B.consolidate_fully(p for k, s in B.split_chunks(ChunkKey(), same, {"x": 1}) for p in B.split_variables(k, s))
    assert whole.equals(same) and key == ChunkKey({"x": 0}, {"a", "b"})
    with pytest.raises(ValueError, match="different offsets"):
        B.consolidate_fully([(ChunkKey({"x": 0}, {"a"}), same.select("a")), (ChunkKey({"x": 2}, {"b"}), same.select("b"))])


def test_validate_and_shapes():
    B.validate_block(ChunkKey({"x": 0}), line())
    B.validate_block(ChunkKey({"x": 0}), [line(), line()])
    for key in (ChunkKey({"y": 0}), ChunkKey({"x": 0}, {"other"})):
        with pytest.raises(ValueError):
            B.validate_block(key, line())
    with pytest.raises(ValueError, match="no computed"):
        B.validate_block(ChunkKey(), Block({"v": ((), 1.0)}))
    with pytest.raises(ValueError):
        Block({"a": (("x",), np.zeros(2)), "b": (("x",), np.zeros(3))})
    c = Block({"v": (("x",), np.arange(6.0))}).coarsen(x=2)
    assert c["v"].tolist() == [0.5, 2.5, 4.5]
    with pytest.raises(ValueError):
        line(5).coarsen(x=2)
