"""Latest or earliest row per group, and bounded samples per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.session import cut_lineage

LIMITED_IN_TASKS = 1000  # Spark limits groups before the shuffle up to this size
EXPECTED = 400  # sampled rows among a group's first n
BOUND = 490  # the sampled row that bounds them, 4.5 standard deviations later


def latest_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` columns of each group, combined before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(best).select(*by, "_row.*").select(*df.columns)


def earliest_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` columns of each group."""
    rest = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(best).select(*by, "_row.*").select(*df.columns)


def child_of_latest(
    parents: DataFrame,
    children: DataFrame,
    by: Sequence[str],
    parent_id: str,
    parent_order: Sequence[str],
    child_parent: str,
    child_order: Sequence[str],
    which: str = "earliest",
) -> DataFrame:
    """For each group's latest parent, its earliest (or latest) child; null where it has none."""
    if which not in ("earliest", "latest"):
        raise ValueError("which is 'earliest' or 'latest'")
    latest = latest_per_group(parents.select(*dict.fromkeys([*by, parent_id, *parent_order])), by, parent_order)
    pick = earliest_per_group if which == "earliest" else latest_per_group
    mine = children.join(
        latest.select(F.col(parent_id).alias(child_parent)), child_parent, "left_semi"
    )
    child = pick(mine, [child_parent], child_order)
    return latest.select(*by, F.col(parent_id).alias(child_parent)).join(child, child_parent, "left")


def sample_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order.

    Spark limits every task to ``n`` rows per group before the shuffle, up to a size. Beyond it, rows are stored
    and numbered by range, so a group is spread over all tasks; if ``order`` names columns, the rows behind an estimated
    bound of each group are left out before anything is moved.
    """
    if n < 1:
        raise ValueError("a sample holds at least one row")
    if not by:
        return df.orderBy(*order).limit(n)
    if n > LIMITED_IN_TASKS:
        rows = _within_bounds(df, by, order, n) if all(isinstance(c, str) for c in order) else df
        return positions(rows, by, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def _within_bounds(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Rows of ``df`` that hold the first ``n`` of each group, of a large group few more; stored.

    The bound of a group is a row of a sample. Groups without one are kept whole; they have few more than ``n`` rows, as
    a larger one has enough sampled rows. Where fewer than ``n`` rows are within the bound, the rest of the group follows.
    """
    sampled = df.select(*dict.fromkeys([*by, *order])).filter(F.rand(n) < EXPECTED / n)
    place = F.struct(*order)
    names = [f"_by{k}" for k in range(len(by))]
    first = sample_per_group(sampled, by, order, BOUND).select(*[F.col(c).alias(x) for c, x in zip(by, names, strict=True)], place.alias("_place"))
    bounds = first.groupBy(*names).agg(F.max("_place").alias("_bound"), F.count("*").alias("_n")).filter(F.col("_n") == BOUND).drop("_n")
    bounds = cut_lineage(bounds, "bounds")

    def same(right: Sequence[str]) -> Column:
        return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(by, right, strict=True)])

    near = df.join(bounds, same(names), "left").filter(F.col("_bound").isNull() | (place <= F.col("_bound")))
    near = cut_lineage(near.select(*df.columns), "near")
    enough = near.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select(*by)
    short = cut_lineage(bounds.join(enough, same(names), "left_anti"), "short")
    if short.isEmpty():
        return near
    return near.union(df.join(short, same(names)).filter(place > F.col("_bound")).select(*df.columns))


def first_occurrences(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """``df`` with each row's place (from 1) in its group by ``order``; stored.

    Rows are sorted by range and counted per partition, so a group of any size is spread over all tasks.
    """
    by = list(by)
    ordered = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = cut_lineage(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    sizes = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    sizes = cut_lineage(sizes.select(*[F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_in"), "_first", "_before"), "sizes")
    same = F.col("_part") == F.col("_in")
    for k, c in enumerate(by):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_by{k}"))
    numbered = placed.join(sizes, same).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], name)
