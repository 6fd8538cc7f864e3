"""Small column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, digits: int) -> Column:
    """Round for storage. The nudge keeps decimal ties equal across engines;
    adding zero turns a negative zero into zero."""
    return F.round(col(c) + F.lit(1e-9), digits) + F.lit(0.0)


def half_even(c) -> Column:
    """Whole-number rounding, ties to even."""
    return F.bround(col(c), 0)


def clamp(c, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def or_default(c, default) -> Column:
    """The value, or the default where the value is null or zero."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(F.coalesce(col(c), F.lit(0.0)) == 0.0, d).otherwise(col(c))


def overlap(a_lo, a_hi, b_lo, b_hi) -> Column:
    """Length shared by two intervals, never negative."""
    return F.greatest(
        F.least(col(a_hi), col(b_hi)) - F.greatest(col(a_lo), col(b_lo)), F.lit(0.0)
    )
