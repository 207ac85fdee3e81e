"""Numeric expressions (FLT-08, FN-14..17, FN-22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonzero(col: Column) -> Column:
    return F.nullif(col, F.lit(0).cast("double"))


def fixed(col: Column, scale: int) -> Column:
    """FN-16: a double with fixed decimals, half away from zero, by plain
    floating arithmetic, so that other engines can repeat it bit for bit."""
    d, p = col.cast("double"), F.lit(float(10**scale))
    return F.signum(d) * F.floor(F.abs(d) * p + F.lit(0.5)) / p + F.lit(0.0)


def safe_div(a: Column, b: Column, scale: int | None = None, factor: float = 1.0) -> Column:
    """FLT-08: floating ratio, NULL on a zero divisor, then fixed decimals."""
    ratio = a.cast("double") / nonzero(b.cast("double"))
    if factor != 1.0:
        ratio = F.lit(float(factor)) * a.cast("double") / nonzero(b.cast("double"))
    return ratio if scale is None else fixed(ratio, scale)


def pct(a: Column, b: Column, scale: int = 2) -> Column:
    """100 x a / b as a rounded double."""
    return safe_div(a, b, scale, 100.0)


def money(col: Column, scale: int = 2) -> Column:
    """A decimal sum presented with fixed decimals as a double."""
    return F.round(col, scale).cast("double")


def clamp(col: Column, low, high) -> Column:
    """FN-14: limit to [low, high]."""
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def half_up(col: Column) -> Column:
    """FN-16: round half away from zero to an integer."""
    return F.round(col, 0).cast("bigint")


def ceil_to(col: Column, step: int) -> Column:
    """FN-17: integer ceiling to a multiple of ``step``."""
    return (F.ceil(col / F.lit(step)) * step).cast("bigint")


def hash_bucket(key: Column, salt: str, n: int) -> Column:
    """FN-22: deterministic bucket of an id and a salt, the JVM hash."""
    return F.pmod(F.xxhash64(F.concat(key.cast("string"), F.lit(salt))), F.lit(n)).cast("int")


def md5_bucket(key: Column, salt: str, n: int) -> Column:
    """FN-22: the same by md5, for readers on other engines."""
    head = F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary")), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % n).cast("int")


def finite(col: Column) -> Column:
    """NaN and infinities to NULL."""
    d = col.cast("double")
    bad = F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(~bad, d)
