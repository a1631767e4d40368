"""Column helpers shared by the operators. Everything here is a built-in Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Round to six decimals, the comparison precision of floating outputs."""
    return F.round(col(c), 6)


def clip(c, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(col(c), lo), hi)


def half_even_int(c) -> Column:
    """Nearest integer, ties to even."""
    return F.bround(col(c).cast("double"), 0).cast("bigint")


def mix(a, b) -> Column:
    """Integer hash of two integers, in 0 .. 2^31-1. `a` must stay below 2^31."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.pmod(a.cast("bigint") * F.lit(1103515245) + b.cast("bigint") * F.lit(12345) + F.lit(42),
                  F.lit(2147483648))


def pick(a, b, n) -> Column:
    """Choose one of n values from the high bits of the hash; the low bits are weak."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.floor(mix(a, b) / F.lit(65536.0)).cast("bigint"), n.cast("bigint"))


def gray601(r, g, b) -> Column:
    """ITU-R 601 luminance in 16-bit fixed point."""
    return F.shiftright(col(r) * 19595 + col(g) * 38470 + col(b) * 7471 + 32768, 16)


def smoothstep(t) -> Column:
    u = clip(t, 0.0, 1.0)
    return u * u * (F.lit(3.0) - F.lit(2.0) * u)


def reflect(i: Column, n: Column) -> Column:
    """Index mirrored at both borders with the border sample repeated, for any overshoot."""
    m = F.pmod(i, n * 2)
    return F.when(m >= n, n * 2 - 1 - m).otherwise(m)
