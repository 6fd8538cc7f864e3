"""Joins in which one key of the large side may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SALTS = 32


def join_hot(big: DataFrame, small: DataFrame, key: Sequence[str], spread: str, salts: int = SALTS,
             how: str = "inner") -> DataFrame:
    """Joins facts per key (one row each) to many rows per key. The many rows of a key are
    spread over ``salts`` partitions by another of their columns; the facts are copied to
    each. A side small enough is still broadcast by the optimizer instead."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*key, "_salt"], how).drop("_salt")


def by_merge(df: DataFrame) -> DataFrame:
    """Rows that grow with the input and are never broadcast in the next join. The optimizer judges stored rows by
    their compressed files, before any copies; broadcast, they go through the driver at many times that size."""
    return df.hint("merge")
