"""A place in the plan where columns are computed exactly once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace ``columns`` behind a one-row generator.

    The optimizer copies plain projections into the filters and projections above them, so a
    parsed row that ten rules look at would be parsed ten times. It does not copy through a
    generator: what is computed here is computed once per row, and a filter on it stays above.
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, made.alias("_once")).select(*kept, "_once.*")
