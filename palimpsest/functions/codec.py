"""Byte-level codecs of stored arrays: hashes, byte planes, zstd, XOR deltas and narrow floats.

Plain functions on bytes; ``as_udf`` lifts them to Arrow-batched column functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import functions as F

#: Bytes of an element by dtype; any other dtype counts as 1.
ELEMENT_BYTES = {
    "complex128": 16,
    "complex64": 8, "float64": 8, "int64": 8, "uint64": 8,
    "complex32": 4, "float32": 4, "int32": 4, "uint32": 4,
    "bfloat16": 2, "float16": 2, "int16": 2, "uint16": 2,
}
#: Accepted names of save dtypes.
DTYPE_NAMES = {
    "": "none", "none": "none",
    "bf16": "bfloat16", "bfloat16": "bfloat16",
    "fp16": "float16", "float16": "float16",
    "fp32": "float32", "float32": "float32",
    "fp64": "float64", "float64": "float64", "double": "float64",
    "fp8": "float8_e4m3fn", "fp8_e4m3": "float8_e4m3fn", "float8": "float8_e4m3fn", "float8_e4m3fn": "float8_e4m3fn",
    "fp8_e5m2": "float8_e5m2", "float8_e5m2": "float8_e5m2",
}
CASTABLE = ("float64", "float32", "float16", "bfloat16")
#: Exponent bits, mantissa bits, bias, largest finite value, and whether infinities exist.
FP8 = {"float8_e4m3fn": (4, 3, 7, 448.0, False), "float8_e5m2": (5, 2, 15, 57344.0, True)}
#: Buffers below MIN_DELTA bytes are never deltas; samples have SAMPLE bytes at most and SURE at least.
MIN_DELTA, SAMPLE, SURE, MAX_RATIO = 4096, 64 * 1024, 8 * 1024, 0.95
#: Larger buffers are compressed as independent frames of this size.
FRAME = 4 * 1024 * 1024


def element_size(dtype: str) -> int:
    return ELEMENT_BYTES.get(dtype, 1)


def parse_dtype(name: str) -> str:
    try:
        return DTYPE_NAMES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown save dtype {name!r}") from None


def content_hash(data: bytes) -> str:
    """128-bit content hash as 32 hex digits."""
    return xxhash.xxh3_128_hexdigest(data)


def shuffle(data: bytes, width: int) -> bytes:
    """Byte planes: the k-th bytes of all elements together; a partial last element stays at the end."""
    whole = len(data) // max(width, 1) * width
    if width <= 1 or not whole:
        return data
    return np.frombuffer(data[:whole], np.uint8).reshape(-1, width).T.tobytes() + data[whole:]


def unshuffle(data: bytes, width: int) -> bytes:
    whole = len(data) // max(width, 1) * width
    if width <= 1 or not whole:
        return data
    return np.frombuffer(data[:whole], np.uint8).reshape(width, -1).T.tobytes() + data[whole:]


def compress(data: bytes, level: int = 3) -> bytes:
    """Zstandard frames of at most ``FRAME`` bytes one after another; level 0 stores as is."""
    if level == 0:
        return data
    codec = zstandard.ZstdCompressor(level=level)
    return b"".join(codec.compress(data[i : i + FRAME]) for i in range(0, max(len(data), 1), FRAME))


def decompress(data: bytes, level: int = 3) -> bytes:
    if level == 0:
        return data
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
        return reader.read()


def decompress_prefix(data: bytes, most: int, level: int = 3) -> bytes:
    """The first bytes of a stream that may be cut short; an error only if nothing can be decoded."""
    if level == 0:
        return data[:most]
    out = b""
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    try:
        while len(out) < most and (part := reader.read(most - len(out))):
            out += part
    except zstandard.ZstdError:
        if not out:
            raise
    if not out and data:
        raise zstandard.ZstdError("nothing could be decoded")
    return out


def xor(base: bytes, target: bytes) -> bytes:
    if len(base) != len(target):
        raise ValueError(f"buffers of {len(base)} and {len(target)} bytes")
    return (np.frombuffer(base, np.uint8) ^ np.frombuffer(target, np.uint8)).tobytes()


def compute_delta(base: bytes, target: bytes) -> bytes | None:
    """The XOR of two buffers, or None where a delta makes no sense."""
    if len(base) != len(target) or len(target) < MIN_DELTA or base == target:
        return None
    return xor(base, target)


def delta_density(delta: bytes) -> float:
    return float(np.count_nonzero(np.frombuffer(delta, np.uint8)) / len(delta)) if delta else 0.0


def pays_off(base: bytes, target: bytes, width: int, level: int = 3, max_ratio: float = MAX_RATIO) -> bool:
    """Whether the compressed byte planes of a delta beat the compressed target, judged by a sample."""
    n = min(len(base), len(target), SAMPLE)
    if n < SURE:
        return True
    delta = shuffle(xor(base[:n], target[:n]), width)
    return len(compress(delta, level)) < len(compress(target[:n], level)) * max_ratio


def fp32_to_bf16(data: bytes) -> bytes:
    bits = np.frombuffer(data, "<u4")
    rounded = ((bits.astype(np.uint64) + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype("<u2")
    nan = (bits & 0x7FFFFFFF) > 0x7F800000
    return np.where(nan, (bits >> 16).astype("<u2") | 0x40, rounded).astype("<u2").tobytes()


def bf16_to_fp32(data: bytes) -> bytes:
    return (np.frombuffer(data, "<u2").astype("<u4") << 16).tobytes()


def fp8_table(kind: str) -> np.ndarray:
    """The values of all 256 patterns of an 8-bit float."""
    exp_bits, man_bits, bias, top, has_inf = FP8[kind]
    code = np.arange(256)
    exponent, mantissa = (code >> man_bits) & ((1 << exp_bits) - 1), code & ((1 << man_bits) - 1)
    scale = np.where(exponent > 0, exponent, 1) - bias
    value = np.ldexp((exponent > 0) + mantissa / (1 << man_bits), scale)
    if has_inf:
        value = np.where(exponent == (1 << exp_bits) - 1, np.where(mantissa == 0, np.inf, np.nan), value)
    else:
        value = np.where((code & 127) == 127, np.nan, value)
    return np.where(code > 127, -value, value).astype(np.float32)


def finite_amax(values: np.ndarray) -> np.float32:
    finite = np.abs(values[np.isfinite(values)])
    return np.float32(finite.max()) if finite.size else np.float32(0)


def fp8_scale(values: np.ndarray, kind: str) -> np.float32:
    """Greatest finite magnitude over the format's, 1 where that is no normal float."""
    scale = np.float32(finite_amax(values) / np.float32(FP8[kind][3]))
    return scale if np.isfinite(scale) and scale >= np.finfo(np.float32).tiny else np.float32(1)


def fp32_to_fp8(values: np.ndarray, kind: str, scale: np.float32) -> bytes:
    """Nearest pattern, ties to even; finite overflow saturates, infinities stay where the format has them."""
    table = fp8_table(kind)
    ladder = table[:127][np.isfinite(table[:127])].astype(np.float64)
    x = (values.astype(np.float32) / scale).astype(np.float64)
    size = np.minimum(np.abs(x), ladder[-1])
    up = np.minimum(np.searchsorted(ladder, size), len(ladder) - 1)
    down = np.maximum(up - 1, 0)
    low, high = size - ladder[down], ladder[up] - size
    code = np.where((low < high) | ((low == high) & (down % 2 == 0)), down, up)
    code = np.where(size == ladder[up], up, code)
    infinite = np.isinf(x)
    code = np.where(infinite, 0x7C if FP8[kind][4] else 0x7F, code)
    code = np.where(np.isnan(x), 0x7F if not FP8[kind][4] else 0x7E, code)
    return (code.astype(np.uint8) | (np.signbit(x).astype(np.uint8) << 7)).tobytes()


def fp8_to_fp32(data: bytes, kind: str, scale: np.float32) -> bytes:
    return (fp8_table(kind)[np.frombuffer(data, np.uint8)] * np.float32(scale)).astype("<f4").tobytes()


def _widen(data: bytes, dtype: str) -> np.ndarray:
    if dtype == "bfloat16":
        data, dtype = bf16_to_fp32(data), "float32"
    return np.frombuffer(data, {"float64": "<f8", "float32": "<f4", "float16": "<f2"}[dtype]).astype(np.float32)


def _narrow(values: np.ndarray, dtype: str) -> bytes:
    if dtype == "bfloat16":
        return fp32_to_bf16(values.astype("<f4").tobytes())
    with np.errstate(over="ignore"):
        return values.astype({"float64": "<f8", "float32": "<f4", "float16": "<f2"}[dtype]).tobytes()


def cast_array(data: bytes, dtype: str, target: str) -> tuple[bytes, str, float | None]:
    """Bytes, stored dtype and scale of an array that is saved as ``target``; non-floats stay as they are."""
    if target == "none" or dtype not in CASTABLE or dtype == target:
        return data, dtype, None
    values = _widen(data, dtype)
    if target in FP8:
        scale = fp8_scale(values, target)
        return fp32_to_fp8(values, target, scale), target, float(scale)
    return _narrow(values, target), target, None


def uncast_array(data: bytes, stored: str, original: str | None, scale: float | None) -> bytes:
    """The original dtype's bytes of a stored array."""
    if original is None or original == stored:
        return data
    if stored in FP8:
        if scale is None:
            raise ValueError("an 8-bit float without its scale")
        return _narrow(np.frombuffer(fp8_to_fp32(data, stored, np.float32(scale)), "<f4"), original)
    if stored not in CASTABLE or original not in CASTABLE:
        return data
    return _narrow(_widen(data, stored), original)


def as_udf(function, returns: str, *fixed):
    """A pandas UDF that applies ``function(value, *fixed)`` to the non-null values of columns."""

    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else function(*row, *fixed) for row in zip(*columns, strict=True)], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return apply(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return apply(a, b)

    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, returns)(*columns)
