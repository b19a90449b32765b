"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a norm below this counts as none.
TINY_NORM = 1e-7
# Fixed value: a dimension whose range is below this has one code.
TINY_RANGE = 1e-10


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where lengths differ."""
    product = total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 where a vector has next to no length."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na < TINY_NORM) | (nb < TINY_NORM), 0.0).otherwise(dot(a, b) / (na * nb))


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(total(squares))).otherwise(0.0)


def l2_similarity(a: Column, b: Column) -> Column:
    return 1.0 / (1.0 + l2_distance(a, b))


def normalized(a: Column) -> Column:
    """The vector at length one; null where it has next to no length."""
    n = norm(a)
    return F.when(n >= TINY_NORM, F.transform(doubles(a), lambda x: x / n))


def similarity(metric: str, a: Column, b: Column) -> Column:
    return {"cosine": cosine, "dot": dot, "l2": l2_similarity}[metric](a, b)


def quantize(v: Column, low: Column, high: Column) -> Column:
    """Codes 0..255 per dimension; 128 where the dimension has no range."""

    def code(x: Column, i: Column) -> Column:
        lo, hi = F.get(low, i), F.get(high, i)
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / (hi - lo)))
        return F.when(hi - lo < TINY_RANGE, F.lit(128)).otherwise(F.floor(share * 255 + 0.5)).cast("short")

    return F.transform(doubles(v), code)


def dequantize(codes: Column, low: Column, high: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        lo, hi = F.get(low, i), F.get(high, i)
        return lo + c.cast("double") / 255 * (hi - lo)

    return F.transform(codes, value)
