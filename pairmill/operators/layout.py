"""How rows lie on tasks before heavy per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core rows when the input has fewer splits than there are cores.

    A file with one row group is one task, whatever it holds, and no later rule can split it.
    Inputs with enough splits, as any large one has, come back as they are: nothing shuffles.
    Placement follows the row's own key, so a task that runs again sees the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, *keys)
