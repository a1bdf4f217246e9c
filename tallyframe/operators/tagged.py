"""Both sides of a comparison as one tagged frame, so one aggregation can serve both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IN_PRIMARY = "_p"
IN_REPLICATED = "_r"


def quoted(name: str) -> str:
    """A column name for SQL texts, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def tagged_union(primary: DataFrame, replicated: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    """Rows of both sides, with 1/0 markers for the side they come from."""
    cols = [F.col(quoted(c)) if isinstance(c, str) else c for c in cols]
    left = primary.select(*cols, F.lit(1).alias(IN_PRIMARY), F.lit(0).alias(IN_REPLICATED))
    right = replicated.select(*cols, F.lit(0).alias(IN_PRIMARY), F.lit(1).alias(IN_REPLICATED))
    return left.unionByName(right)


def per_group(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregate per ``by`` columns, or over everything if there are none."""
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def where_group(df: DataFrame, groups: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """Rows whose group has ``flag`` set; without ``by``, ``groups`` is a one-row aggregate."""
    if by:
        return df.join(groups.where(flag).select(*by), list(by), "left_semi")
    return df.where(F.coalesce(groups.select(flag).scalar(), F.lit(False)))
