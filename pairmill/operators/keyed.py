"""Joins on keys that may be NULL: the keys are compared as one struct, in which NULL equals NULL.

A struct is never NULL itself, so the join is a plain hash join that loses no row, and grouping or a
window by the same struct uses its exchange again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(*keys: str | Column) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") if isinstance(k, str) else k.alias(f"k{i}") for i, k in enumerate(keys)])


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the further columns of ``small``, which has one row per key."""
    further = [c for c in small.columns if c not in keys]
    keyed = small.select(key_of(*keys).alias("_on"), *further)
    return df.withColumn("_on", key_of(*keys)).join(keyed, "_on", how).drop("_on")
