"""Column-set operators; the decisions need table metadata only."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.labels import BOTH, PRIMARY_ONLY, REPLICATED_ONLY


def drop_ignored(df: DataFrame, ignored: Iterable[str], protected: Iterable[str] = ()) -> DataFrame:
    """Drop ignored columns (names match in any case) except the protected ones."""
    keep = {c.lower() for c in protected}
    gone = {c.lower() for c in ignored} - keep
    return df.select(*[c for c in df.columns if c.lower() not in gone])


def compared_columns(
    primary: DataFrame, replicated: DataFrame, keys: Sequence[str] = (), exclude: Iterable[str] = ()
) -> list[str]:
    """Columns of both sides that are neither key nor excluded, in primary order."""
    skip = {*keys, *exclude}
    return [c for c in primary.columns if c in replicated.columns and c not in skip]


def one_sided_columns(primary: DataFrame, replicated: DataFrame) -> tuple[list[str], list[str]]:
    """Columns that only the primary, and only the replicated side has."""
    return (
        [c for c in primary.columns if c not in replicated.columns],
        [c for c in replicated.columns if c not in primary.columns],
    )


def schema_diff(primary: DataFrame, replicated: DataFrame) -> DataFrame:
    """All columns of both sides with presence, types and number of values they hold."""

    def described(df: DataFrame, prefix: str) -> DataFrame:
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
        rows = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(t).alias(f"{prefix}_type"),
                    F.col(f"`{c}`").alias(f"{prefix}_values"),
                )
                for c, t in df.dtypes
            ]
        )
        return counts.select(F.inline(rows))

    both = described(primary, "primary").join(described(replicated, "replicated"), "column", "full")
    return both.withColumn(
        "presence",
        F.when(F.col("replicated_type").isNull(), PRIMARY_ONLY)
        .when(F.col("primary_type").isNull(), REPLICATED_ONLY)
        .otherwise(BOTH),
    )
