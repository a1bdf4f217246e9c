"""Key operators: presence per side, uniqueness, first row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.labels import presence
from tallyframe.operators.tagged import IN_PRIMARY, IN_REPLICATED, per_group, tagged_union


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key columns are all set."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def key_presence(primary: DataFrame, replicated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with the side(s) that hold it.

    Only key columns are read and moved. Repeated keys collapse before the shuffle, so a key
    with very many rows costs no more than any other.
    """
    tagged = known_keys(tagged_union(primary, replicated, list(keys)), keys)
    return (
        tagged.groupBy(*keys)
        .agg(F.sum(IN_PRIMARY).alias("primary_rows"), F.sum(IN_REPLICATED).alias("replicated_rows"))
        .withColumn("presence", presence(F.col("primary_rows") > 0, F.col("replicated_rows") > 0))
    )


def rows_with_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is listed (semi join)."""
    return df.join(keys_df.select(*keys), list(keys), "left_semi")


def rows_without_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not listed (anti join)."""
    return df.join(keys_df.select(*keys), list(keys), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") > 1)


def key_uniqueness(
    primary: DataFrame, replicated: DataFrame, keys: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Per group: is every key unique on both sides?"""
    counted = (
        tagged_union(primary, replicated, [*by, *keys])
        .groupBy(*by, *keys)
        .agg(F.sum(IN_PRIMARY).alias("primary_rows"), F.sum(IN_REPLICATED).alias("replicated_rows"))
    )
    return per_group(
        counted,
        by,
        F.count_if(F.col("primary_rows") > 1).alias("n_duplicate_primary"),
        F.count_if(F.col("replicated_rows") > 1).alias("n_duplicate_replicated"),
    ).withColumn(
        "is_unique", (F.col("n_duplicate_primary") == 0) & (F.col("n_duplicate_replicated") == 0)
    )


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First row of each key in the order of all columns.

    A ``min`` over a row struct: it is combined before the shuffle, unlike a ranking window.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")
