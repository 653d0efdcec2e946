"""Use of all cores for inputs that arrive in one or two file splits."""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_SPREAD_BYTES = 1 << 30      # beyond this, file splits alone keep many tasks busy
BYTES_PER_TASK = 1 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; file sizes where nothing better is known."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, size: int) -> DataFrame:
    """Deal the rows of a small input out to more tasks before heavy per-row work.

    A single file with a single row group is one task however many cores there
    are. Inputs of unknown or large size stay as they are: nothing big is shuffled.
    """
    if size > MAX_SPREAD_BYTES:
        return df
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, size // BYTES_PER_TASK)
    return df.repartition(int(tasks)) if tasks > 1 else df
