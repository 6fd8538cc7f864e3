"""Joins on overlapping intervals.

Every interval is put into the time bins it touches and the join is an equi-join on
(key, bin), so a long or popular video spreads over many partitions. A pair is kept
only in the bin where the later of the two starts lies, so it appears once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .expr import col


def _bins(lo, hi, width: float) -> Column:
    w = F.lit(float(width))
    first = F.floor(col(lo) / w).cast("long")
    last = F.floor(col(hi) / w).cast("long")
    return F.explode(F.sequence(first, F.greatest(first, last)))


def range_join(left: DataFrame, right: DataFrame, key: Sequence[str],
               left_span: tuple[str, str], right_span: tuple[str, str],
               width: float, closed: bool = False) -> DataFrame:
    """Pairs with equal key whose intervals share more than a point (``closed``: at
    least a point). Column names must differ apart from the key. A point is a span
    with the same column twice."""
    (ll, lh), (rl, rh) = left_span, right_span
    pairs = (left.withColumn("_bin", _bins(ll, lh, width))
             .join(right.withColumn("_bin", _bins(rl, rh, width)), [*key, "_bin"]))
    later = F.greatest(F.col(ll), F.col(rl))
    meet = ((F.col(rh) >= F.col(ll)) & (F.col(rl) <= F.col(lh))) if closed else (
        (F.col(rh) > F.col(ll)) & (F.col(rl) < F.col(lh)))
    own = F.floor(later / F.lit(float(width))).cast("long")
    return pairs.filter(meet & (F.col("_bin") == own)).drop("_bin")
