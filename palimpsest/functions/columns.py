"""Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import ELEMENT_BYTES

#: Fixed values of multipart uploads: least part and most parts to plan for.
LEAST_PART, MOST_PARTS = 16 * 1024 * 1024, 10_000 - 16
#: The least normal 32-bit float.
LEAST_NORMAL = 2.0**-126


def glob_to_like(pattern: str) -> str:
    """A LIKE pattern for a glob in which only ``*`` is special."""
    for x in "\\%_":
        pattern = pattern.replace(x, "\\" + x)
    return pattern.replace("*", "%")


def element_size(dtype: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ELEMENT_BYTES.items() for x in pair])
    return F.coalesce(F.element_at(table, dtype), F.lit(1))


def part_size(total: Column) -> Column:
    """Bytes of a part of a multipart upload."""
    return F.greatest(F.lit(LEAST_PART), F.ceil(total / MOST_PARTS)).cast("long")


def object_key(prefix: str, name: Column) -> Column:
    prefix = prefix.strip("/")
    return F.concat(F.lit(prefix + "/" if prefix else ""), name)


def array_density(values: Column) -> Column:
    """Share of non-zero elements; 0 for the empty array."""
    n = F.size(values)
    return F.when(n > 0, F.size(F.filter(values, lambda x: x != 0)) / n).otherwise(0.0)


def array_xor(a: Column, b: Column) -> Column:
    """Element-wise XOR; arrays of different lengths raise."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))).otherwise(F.raise_error(F.lit("arrays differ in length")))


def finite_amax(values: Column) -> Column:
    magnitudes = F.transform(F.filter(values, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), lambda x: F.abs(x).cast("double"))
    return F.coalesce(F.array_max(magnitudes), F.lit(0.0))


def fp8_scale(values: Column, most: float) -> Column:
    """The factor that takes the largest finite element to ``most``; 1 unless it is a normal float."""
    scale = (finite_amax(values) / F.lit(most)).cast("float")
    return F.when((scale >= F.lit(LEAST_NORMAL)) & (scale < float("inf")), scale).otherwise(F.lit(1.0).cast("float"))


def pack_offset(length: str, *, by: list[str], order: str, header: int = 32) -> Column:
    """Where a blob begins in its pack: the lengths before it and the header."""
    from pyspark.sql import Window

    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(before), F.lit(0)) + header
