import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import codec, tree


@given(st.binary(max_size=200), st.sampled_from([0, 1, 2, 4, 8, 16]))
def test_byte_planes_round_trip(data, width):
    assert codec.unshuffle(codec.shuffle(data, width), width) == data


def test_byte_planes_order():
    assert codec.shuffle(b"abcdefg", 2) == b"acebdfg"


@settings(deadline=None)
@given(st.binary(max_size=5000), st.sampled_from([0, 1, 3]))
def test_compression_round_trips(data, level):
    assert codec.decompress(codec.compress(data, level), level) == data


def test_frames_and_prefix():
    data = np.random.default_rng(0).integers(0, 4, 9_000_000, np.uint8).tobytes()
    packed = codec.compress(data)
    assert codec.decompress(packed) == data
    assert codec.decompress_prefix(packed[: len(packed) // 3], 1000) == data[:1000]
    with pytest.raises(Exception):
        codec.decompress_prefix(b"no zstd at all", 10)


def test_deltas():
    r = np.random.default_rng(1)
    base = r.integers(0, 256, 100_000, np.uint8).tobytes()
    near = bytearray(base)
    near[5] ^= 1
    assert codec.xor(base, codec.compute_delta(base, bytes(near))) == bytes(near)
    assert codec.compute_delta(base, base) is None and codec.compute_delta(b"a", b"b") is None
    assert codec.pays_off(base, bytes(near), 1)
    assert not codec.pays_off(base, r.integers(0, 256, 100_000, np.uint8).tobytes(), 1)
    assert codec.delta_density(b"") == 0 and codec.delta_density(b"\0\1\0\1") == 0.5
    with pytest.raises(ValueError):
        codec.xor(b"a", b"ab")


@pytest.mark.parametrize("kind", sorted(codec.FP8))
def test_all_patterns_of_eight_bit_floats(kind):
    table = codec.fp8_table(kind)
    finite = np.isfinite(table)
    back = np.frombuffer(codec.fp32_to_fp8(table, kind, np.float32(1)), np.uint8)
    assert (back[finite] == np.arange(256, dtype=np.uint8)[finite]).all()
    assert np.isnan(codec.fp8_table(kind)[back[np.isnan(table)]]).all()
    mid = np.array([(a + b) / 2 for a, b in zip(table[:100], table[1:101], strict=True)], np.float32)
    even = np.frombuffer(codec.fp32_to_fp8(mid, kind, np.float32(1)), np.uint8)
    assert (even % 2 == 0).all()


def test_spot_values():
    x = np.array([1, 2, 0.5, -1, 3.5, -0.0], np.float32)
    assert codec.fp32_to_fp8(x, "float8_e4m3fn", np.float32(1)).hex() == "384030b84680"
    assert codec.fp32_to_fp8(x, "float8_e5m2", np.float32(1)).hex() == "3c4038bc4380"
    big = np.array([np.inf, 1e9, -1e9], np.float32)
    assert codec.fp32_to_fp8(big, "float8_e4m3fn", np.float32(1)).hex() == "7f7efe"
    assert codec.fp32_to_fp8(big, "float8_e5m2", np.float32(1)).hex() == "7c7bfb"


def test_bfloat16():
    x = np.array([1, 1 + 2**-8, 1 + 3 * 2**-8, np.inf, -2.5], np.float32)
    assert np.frombuffer(codec.bf16_to_fp32(codec.fp32_to_bf16(x.tobytes())), "<f4").tolist() == [1, 1, 1 + 2**-6, np.inf, -2.5]
    assert np.isnan(np.frombuffer(codec.bf16_to_fp32(codec.fp32_to_bf16(np.array([np.nan], "<f4").tobytes())), "<f4")).all()


@pytest.mark.parametrize("source", codec.CASTABLE)
@pytest.mark.parametrize("target", ["float64", "float32", "float16", "bfloat16", "float8_e4m3fn", "float8_e5m2", "none"])
def test_cast_and_back(source, target):
    x = np.linspace(-3, 3, 64, dtype=np.float32)
    data = codec._narrow(x, source)
    stored, dtype, scale = codec.cast_array(data, source, target)
    back = codec._widen(codec.uncast_array(stored, dtype, source, scale), source)
    assert len(stored) == 64 * (codec.element_size(dtype))
    assert np.abs(back - x).max() < 0.3


def test_names_and_scale():
    assert codec.parse_dtype("BF16") == "bfloat16" and codec.parse_dtype("") == "none"
    with pytest.raises(ValueError):
        codec.parse_dtype(" bf16")
    assert codec.fp8_scale(np.array([np.nan, np.inf], np.float32), "float8_e5m2") == 1
    assert codec.fp8_scale(np.array([448, np.inf], np.float32), "float8_e4m3fn") == 1
    with pytest.raises(ValueError):
        codec.uncast_array(b"\0", "float8_e5m2", "float32", None)
    assert codec.cast_array(b"abcd", "int32", "bfloat16") == (b"abcd", "int32", None)


def test_tree_round_trips():
    state = {"w": np.arange(6, dtype=np.float32).reshape(2, 3), "opt": [{"m": np.zeros(0)}, (1, None, "x", 2.5, True)], 3: {"empty": {}}}
    rows = tree.flatten(state, "model")
    arrays = {r[0]: r[3] for r in rows}
    back = tree.unflatten(arrays, "model")
    assert (back["w"] == state["w"]).all() and back["opt"][1] == state["opt"][1] and back[3] == {"empty": {}}
    assert tree.describe(arrays["model._template"])["w"] == ("model.w", (2, 3), "float32")
    del arrays["model.w"]
    with pytest.raises(KeyError, match="model.w"):
        tree.unflatten(arrays, "model")
    with pytest.raises(TypeError):
        tree.flatten({"f": object()})
