"""Whole-table comparison: digests, multiset and distinct-row differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.labels import presence
from tallyframe.operators.tagged import IN_PRIMARY, IN_REPLICATED, per_group, quoted, tagged_union


def table_digest(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count and an order-free 64-bit digest per group, without moving any row.

    The row hash is summed in three pieces of 22, 21 and 21 bits, so the sums cannot overflow
    below 2**41 rows. Different digests prove a difference; equal ones still need
    :func:`multiset_diff` as proof of equality.
    """
    h = F.xxhash64(*[F.col(quoted(c)) for c in df.columns])
    pieces = df.select(
        *by,
        F.shiftrightunsigned(h, 42).alias("_hi"),
        F.shiftrightunsigned(h, 21).bitwiseAND(F.lit((1 << 21) - 1)).alias("_mid"),
        h.bitwiseAND(F.lit((1 << 21) - 1)).alias("_lo"),
    )
    return per_group(
        pieces,
        by,
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("_hi").alias("digest_hi"),
        F.sum("_mid").alias("digest_mid"),
        F.sum("_lo").alias("digest_lo"),
    )


def digests_differ(primary: DataFrame, replicated: DataFrame) -> bool:
    """Cheap proof of inequality (an action that returns two rows)."""
    if primary.dtypes != replicated.dtypes:
        return True
    a, b = table_digest(primary).first(), table_digest(replicated).first()
    return tuple(a) != tuple(b)


def multiset_counts(
    primary: DataFrame,
    replicated: DataFrame,
    cols: Sequence[str] | None = None,
    ts_col: str | None = None,
) -> DataFrame:
    """Every distinct row with its number of copies on each side.

    One shuffle; copies collapse before it, so a row with very many copies stays cheap. With
    ``ts_col`` (not among ``cols``) the earliest time per side comes along as
    ``p_min_ts``/``r_min_ts``.
    """
    cols = list(primary.columns if cols is None else cols)
    aggregates = [
        F.sum(IN_PRIMARY).alias("primary_count"),
        F.sum(IN_REPLICATED).alias("replicated_count"),
    ]
    moved: list = list(cols)
    if ts_col:
        moved.append(F.col(ts_col).alias("_ts"))
        aggregates += [
            F.min(F.when(F.col(IN_PRIMARY) == 1, F.col("_ts"))).alias("p_min_ts"),
            F.min(F.when(F.col(IN_REPLICATED) == 1, F.col("_ts"))).alias("r_min_ts"),
        ]
    return tagged_union(primary, replicated, moved).groupBy(*map(quoted, cols)).agg(*aggregates)


def side_counts(
    primary: DataFrame, replicated: DataFrame, cols: Sequence[str], ts_col: str | None = None
) -> DataFrame:
    """The columns of :func:`multiset_counts` without collapsing equal rows: no shuffle."""
    moved: list = list(cols)
    if ts_col:
        moved.append(F.col(ts_col).alias("_ts"))
    rows = tagged_union(primary, replicated, moved)
    times = {
        "p_min_ts": F.when(F.col(IN_PRIMARY) == 1, F.col("_ts")),
        "r_min_ts": F.when(F.col(IN_REPLICATED) == 1, F.col("_ts")),
    }
    return rows.select(
        *map(quoted, cols),
        F.col(IN_PRIMARY).alias("primary_count"),
        F.col(IN_REPLICATED).alias("replicated_count"),
        *([c.alias(n) for n, c in times.items()] if ts_col else []),
    )


def multiset_diff(
    primary: DataFrame, replicated: DataFrame, cols: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose number of copies differs, both directions at once.

    ``surplus`` is how many more copies the side in ``presence`` holds.
    """
    counts = multiset_counts(primary, replicated, cols)
    more_left = F.col("primary_count") > F.col("replicated_count")
    return (
        counts.where(F.col("primary_count") != F.col("replicated_count"))
        .withColumn("surplus", F.abs(F.col("primary_count") - F.col("replicated_count")))
        .withColumn("presence", presence(more_left, ~more_left))
        .drop("primary_count", "replicated_count")
    )


def distinct_diff(
    primary: DataFrame, replicated: DataFrame, cols: Sequence[str] | None = None
) -> DataFrame:
    """Distinct rows that only one side holds, with the side as ``presence``."""
    counts = multiset_counts(primary, replicated, cols)
    left, right = F.col("primary_count") > 0, F.col("replicated_count") > 0
    return (
        counts.where(~(left & right))
        .withColumn("presence", presence(left, right))
        .drop("primary_count", "replicated_count")
    )


def distinct_merge_summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a distinct-row comparison, from :func:`multiset_counts`.

    ``n_matching_with_diffs`` estimates changed rows as ``min(rows) - rows in both``; it is 0
    where nothing is in both.
    """
    totals = {
        "primary_rows": "coalesce(sum(primary_count), 0)",
        "replicated_rows": "coalesce(sum(replicated_count), 0)",
        "n_primary_only": "count_if(replicated_count = 0)",
        "n_replicated_only": "count_if(primary_count = 0)",
        "n_both": "count_if(primary_count > 0 AND replicated_count > 0)",
        "n_unbalanced": "count_if(primary_count <> replicated_count)",
    }
    estimate = "least(primary_rows, replicated_rows) - n_both"
    return per_group(counts, by, *[F.expr(f"{e} AS {n}") for n, e in totals.items()]).selectExpr(
        *by, *totals, f"CASE WHEN n_both > 0 THEN greatest({estimate}, 0L) ELSE 0L END AS n_matching_with_diffs"
    )


def tables_equal(primary: DataFrame, replicated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: row counts and whether both sides hold the same rows equally often."""
    same_columns = primary.dtypes == replicated.dtypes  # names, their order and types
    if set(primary.columns) != set(replicated.columns):
        cols = [c for c in primary.columns if c in replicated.columns]
    else:
        cols = primary.columns
    counts = multiset_counts(primary, replicated, cols)
    return per_group(
        counts,
        by,
        F.coalesce(F.sum("primary_count"), F.lit(0)).alias("primary_rows"),
        F.coalesce(F.sum("replicated_count"), F.lit(0)).alias("replicated_rows"),
        (F.count_if(F.col("primary_count") != F.col("replicated_count")) == 0).alias("match"),
    ).withColumn("match", F.col("match") & F.lit(same_columns))


def row_counts(primary: DataFrame, replicated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per side and group, in one pass over both sides."""
    return per_group(
        tagged_union(primary, replicated, list(by)),
        by,
        F.coalesce(F.sum(IN_PRIMARY), F.lit(0)).alias("primary_rows"),
        F.coalesce(F.sum(IN_REPLICATED), F.lit(0)).alias("replicated_rows"),
    )
