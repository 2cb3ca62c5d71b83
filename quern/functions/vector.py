"""Vector expressions that stay in the JVM. All sums run over the elements in order, in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    """Sum of the elements, first to last."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return total(F.zip_with(a, b, square))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def truncate(v: Column, dim: int) -> Column:
    """The first ``dim`` elements, again at unit length."""
    return normalize(F.slice(v, 1, dim))


def pattern(key: Column, dim: int) -> Column:
    """A vector that can be checked from its key alone; all values are whole and below 2048."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(key * 7 + i * 13, F.lit(2048)).cast("float"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def scalar_levels(v: Column, bits: int) -> tuple[Column, Column]:
    """(levels, a): elements of [-a, a], a the largest magnitude, rounded half up to 2**bits levels."""
    a = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    a = F.when(a == 0, F.lit(1e-9)).otherwise(a)
    top = (1 << bits) - 1
    level = F.transform(v, lambda x: F.least(F.greatest(F.round((x.cast("double") + a) / (2 * a) * top), F.lit(0.0)), F.lit(float(top))).cast("int"))
    return level, a
