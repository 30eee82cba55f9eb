"""Column functions: fixed-point numbers, half rounding, labels and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(v: Column, width: int = 32) -> Column:
    """Fixed point with ``width - 1`` fraction bits as BIGINT, truncated towards zero, sign kept apart."""
    return (F.signum(v) * F.floor(F.abs(v) * F.lit(float(1 << (width - 1))))).cast("long")


def dequantise(q: Column, width: int = 32) -> Column:
    """The number a fixed-point value stands for."""
    return q / F.lit(float(1 << (width - 1)))


def requantise(q: Column, width: int, out_width: int) -> Column:
    """Another width for a fixed-point value, truncated towards zero."""
    d = width - out_width
    return q * F.lit(1 << -d) if d <= 0 else F.call_function("div", q, F.lit(1 << d))


def fixed_product(a: Column, b: Column, width: int = 32) -> Column:
    """Product of two fixed-point values, truncated to the same width before it is summed."""
    return F.call_function("div", a * b, F.lit(1 << (width - 1)))


def half(v: Column) -> Column:
    """Nearest IEEE half (11 significant bits, ties to even), as DOUBLE; beyond its range infinite."""
    a = F.abs(v)
    e = F.greatest(F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0)))), F.lit(-14))
    step = F.pow(F.lit(2.0), e - 10)
    r = F.rint(a / step) * step
    return F.when(a == 0, F.lit(0.0)).when(r > 65504.0, F.signum(v) * F.lit(float("inf"))).otherwise(F.signum(v) * r)


def nearest_power_of_ten(v: Column) -> Column:
    """The power of ten below, or the one above from over half of it: 488 → 100, 560 → 1000."""
    e = F.floor(F.log10(v))
    return F.pow(F.lit(10.0), e + F.when(v / F.pow(F.lit(10.0), e + 1) > 0.5, 1).otherwise(0))


def shorten(s: Column, most: int) -> Column:
    """Text of at most ``most`` characters, a longer one ending in an ellipsis."""
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)


def exponent_label(v: Column) -> Column:
    """A whole number by its trailing zeros: 10000 → 10^4, 5000 → 5·10^3, 123 → 123."""
    s = v.cast("long").cast("string")
    head = F.regexp_replace(s, "0+$", "")
    zeros = F.length(s) - F.length(head)
    return F.when(head == "1", F.concat(F.lit("10^"), zeros.cast("string"))).when(zeros > 0, F.concat(head, F.lit("·10^"), zeros.cast("string"))).otherwise(s)


def plausible_mtx(fmt: Column, field: Column, symmetry: Column) -> Column:
    """Whether a matrix type code can be: no dense pattern, no real hermitian, no pattern hermitian or skew."""
    return ~((fmt == "array") & (field == "pattern")) & ~((field == "real") & (symmetry == "hermitian")) & ~((field == "pattern") & symmetry.isin("hermitian", "skew-symmetric"))
