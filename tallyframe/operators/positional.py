"""Positional comparison: the i-th sorted row of one side against the i-th of the other.

Equal rows occupy a run of positions on each side, so one row with its number of copies stands
for the whole run. Runs are laid out by a range-partitioned sort plus prefix sums; the positions
where a row meets itself are the overlap of its two runs. No row is ranked in a single task and
no join on positions is needed.

One inserted row moves all positions behind it. :func:`aligned_rows` is proof against that: rows that both sides hold are
anchors, and as both sides are in the same order, anchors never cross. What lies between two anchors is a gap, in which the rest
of one side is set against the rest of the other, place by place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.operators.equality import multiset_counts
from tallyframe.operators.ranking import sample_per_group
from tallyframe.operators.tagged import per_group
from tallyframe.session import cut_lineage

STRETCH = 16  # sums run over stretches of at most 2 ** 16 rows of a range partition, so no task holds whole partitions


def positional_runs(
    primary: DataFrame, replicated: DataFrame, by: Sequence[str] = (), cols: Sequence[str] | None = None
) -> DataFrame:
    """Distinct rows with the run of positions (from 0, end excluded) they fill on each side."""
    cols = [c for c in (primary.columns if cols is None else cols) if c not in by]
    return runs_of_counts(multiset_counts(primary, replicated, [*by, *cols]), by)


def runs_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`positional_runs` from the rows of :func:`multiset_counts`."""
    by = list(by)
    cols = [c for c in counts.columns if c not in {*by, "primary_count", "replicated_count"}]
    order = [F.col(f"`{c}`").asc_nulls_first() for c in [*by, *cols]]
    ordered = (
        counts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # The ranges come from sampling: cut here so that every reader sees the same layout.
    placed = cut_lineage(ordered).withColumn("_part", F.shiftright("_id", STRETCH))

    # One row per (stretch, group): at most stretches + groups rows.
    sizes = placed.groupBy("_part", *by).agg(
        F.sum("primary_count").alias("_p"), F.sum("replicated_count").alias("_r")
    )
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        *by,
        F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_r").over(earlier), F.lit(0)).alias("_r0"),
    )
    inside = Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns(
        {
            "_p1": F.coalesce(F.sum("primary_count").over(inside), F.lit(0)),
            "_r1": F.coalesce(F.sum("replicated_count").over(inside), F.lit(0)),
        }
    )
    return summed.join(offsets, ["_part", *by]).select(
        *by,
        *cols,
        (F.col("_p0") + F.col("_p1")).alias("p_start"),
        (F.col("_p0") + F.col("_p1") + F.col("primary_count")).alias("p_end"),
        (F.col("_r0") + F.col("_r1")).alias("r_start"),
        (F.col("_r0") + F.col("_r1") + F.col("replicated_count")).alias("r_end"),
    )


def _meet():
    start = F.greatest("p_start", "r_start")
    end = F.least("p_end", "r_end")
    return start, F.greatest(start, end)


def positional_summary(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per side and number of positions whose rows differ."""
    start, end = _meet()
    totals = per_group(
        runs,
        by,
        F.coalesce(F.sum(F.col("p_end") - F.col("p_start")), F.lit(0)).alias("primary_rows"),
        F.coalesce(F.sum(F.col("r_end") - F.col("r_start")), F.lit(0)).alias("replicated_rows"),
        F.coalesce(F.sum(end - start), F.lit(0)).alias("_same"),
    )
    return totals.select(
        *by,
        "primary_rows",
        "replicated_rows",
        (F.greatest("primary_rows", "replicated_rows") - F.col("_same")).alias("n_different"),
    )


def positional_samples(runs: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` differing positions (from 1) with the rows of both sides as structs."""
    by = list(by)
    cols = [c for c in runs.columns if c not in {*by, "p_start", "p_end", "r_start", "r_end"}]
    start, end = _meet()

    def side(lo: str, hi: str, name: str) -> DataFrame:
        # The run of a row without the stretch where it meets itself: up to two pieces.
        pieces = F.array(
            F.struct(F.col(lo).alias("_from"), F.when(end > start, start).otherwise(F.col(hi)).alias("_to")),
            F.struct(F.when(end > start, end).otherwise(F.col(hi)).alias("_from"), F.col(hi).alias("_to")),
        )
        cut = runs.select(*by, F.struct(*cols).alias(name), F.inline(pieces)).where("_from < _to")
        first = sample_per_group(cut, by, ["_from"], n)
        last = F.least(F.col("_to"), F.col("_from") + n)
        spread = first.select(
            *by, name, F.explode(F.sequence(F.col("_from") + 1, last)).alias("position")
        )
        return sample_per_group(spread, by, ["position"], n)

    both = side("p_start", "p_end", "primary").join(
        side("r_start", "r_end", "replicated"), [*by, "position"], "full"
    )
    return sample_per_group(both, by, ["position"], n)


def aligned_rows(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows that anchors leave over, from :func:`multiset_counts`: their gap, side, and places in the gap; stored.

    Columns: ``by``, ``gap`` (how many anchors come before), ``in_primary``, ``first`` and ``n`` (the run of places from 0 that
    its surplus copies fill) and the ``row`` as a struct. Rows that are equal on both sides are only counted: what is
    stored, shuffled and ranked grows with the differences.
    """
    by = list(by)
    cols = [c for c in counts.columns if c not in {*by, "primary_count", "replicated_count"}]
    order = [F.col(f"`{c}`").asc_nulls_first() for c in [*by, *cols]]
    ordered = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    surplus, anchor = F.col("primary_count") != F.col("replicated_count"), F.least("primary_count", "replicated_count") > 0
    placed = cut_lineage(
        ordered.select(
            *by,
            "_id",
            F.shiftright("_id", STRETCH).alias("_part"),
            anchor.cast("int").alias("_anchor"),
            F.greatest(F.col("primary_count") - F.col("replicated_count"), F.lit(0)).alias("_p"),
            F.greatest(F.col("replicated_count") - F.col("primary_count"), F.lit(0)).alias("_r"),
            F.when(surplus, F.struct(*[F.col(f"`{c}`") for c in cols])).alias("row"),
        ),
        "placed",
    )
    # At most stretches + groups rows.
    sizes = placed.groupBy("_part", *by).agg(
        F.min("_id").alias("_first"), *[F.sum(c).alias(f"_n{c}") for c in ("_anchor", "_p", "_r")]
    )
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        sizes.select(
            F.col("_part").alias("_in"),
            *[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)],
            "_first",
            *[F.coalesce(F.sum(f"_n{c}").over(earlier), F.lit(0)).alias(f"_before{c}") for c in ("_anchor", "_p", "_r")],
        ),
        "offsets",
    )
    # Of the rows before one in its partition, those that are no anchor are themselves left over, so it suffices to rank those.
    inside = Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    left = placed.where(F.col("row").isNotNull()).withColumns(
        {"_single": before(1 - F.col("_anchor")), "_p1": before("_p"), "_r1": before("_r")}
    )
    same = F.col("_part") == F.col("_in")
    for i, c in enumerate(by):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}"))
    found = left.join(offsets, same).select(
        *by,
        (F.col("_before_anchor") + F.col("_id") - F.col("_first") - F.col("_single") + F.col("_anchor")).alias("gap"),
        (F.col("_p") > 0).alias("in_primary"),
        F.when(F.col("_p") > 0, F.col("_before_p") + F.col("_p1")).otherwise(F.col("_before_r") + F.col("_r1")).alias("_place"),
        (F.col("_p") + F.col("_r")).alias("n"),
        "row",
    )
    found = cut_lineage(found, "left")
    starts = found.groupBy(*by, "gap", "in_primary").agg(F.min("_place").alias("_start"))
    named = starts.select(*[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)], F.col("gap").alias("_gap"), F.col("in_primary").alias("_side"), "_start")
    same = (F.col("gap") == F.col("_gap")) & (F.col("in_primary") == F.col("_side"))
    for i, c in enumerate(by):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}"))
    joined = found.join(named, same)
    return cut_lineage(joined.select(*by, "gap", "in_primary", (F.col("_place") - F.col("_start")).alias("first"), "n", "row"), "aligned")


def aligned_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of :func:`aligned_rows` how many rows were changed, and how many more only one side has; groups without any are left out."""
    surplus = rows.groupBy(*by, "gap").agg(
        F.sum(F.when(F.col("in_primary"), F.col("n")).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col("in_primary"), F.lit(0)).otherwise(F.col("n"))).alias("_r"),
    )
    return per_group(
        surplus,
        by,
        F.coalesce(F.sum(F.least("_p", "_r")), F.lit(0)).alias("n_changed"),
        F.coalesce(F.sum(F.greatest(F.col("_p") - F.col("_r"), F.lit(0))), F.lit(0)).alias("n_primary_extra"),
        F.coalesce(F.sum(F.greatest(F.col("_r") - F.col("_p"), F.lit(0))), F.lit(0)).alias("n_replicated_extra"),
    )


def aligned_samples(rows: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` differences in order: gap, place in it, and the rows of both sides (null where a side has none)."""
    by = list(by)

    def side(in_primary: bool, name: str) -> DataFrame:
        own = rows.where(F.col("in_primary") if in_primary else ~F.col("in_primary"))
        first = sample_per_group(own, by, ["gap", "first"], n)
        last = F.col("first") + F.least(F.col("n"), F.lit(n)) - 1
        spread = first.select(*by, "gap", F.col("row").alias(name), F.explode(F.sequence("first", last)).alias("place"))
        return sample_per_group(spread, by, ["gap", "place"], n)

    keys = [*by, "gap", "place"]
    right = side(False, "replicated").select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)], "replicated")
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}"))
    both = side(True, "primary").join(right, same, "full")
    one = F.col("gap").isNotNull()
    named = both.select(*[F.when(one, F.col(f"`{c}`")).otherwise(F.col(f"_k{i}")).alias(c) for i, c in enumerate(keys)], "primary", "replicated")
    return sample_per_group(named, by, ["gap", "place"], n)
