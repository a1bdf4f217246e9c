"""Storage layouts that save shuffles later on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_by_key(
    df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None
) -> None:
    """Save a side bucketed and sorted by its key.

    Two sides saved with the same keys and number of buckets pair without any shuffle, which
    pays when the same side takes part in many comparisons.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def balanced_by(df: DataFrame, col: str) -> DataFrame:
    """Rows of one value together, but large values split and small ones joined, by size.

    Meant for partitioned writes: without it every task writes a file per value, and with a plain
    repartition a value that holds a third of the rows would end up in one task.
    """
    return df.hint("rebalance", F.col(col))
