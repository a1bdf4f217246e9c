"""Grouped set comparison: which items of a group are missing or unexpected on the other side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.equality import tables_equal
from tallyframe.operators.keys import known_keys
from tallyframe.operators.tagged import IN_PRIMARY, IN_REPLICATED, per_group, tagged_union, where_group
from tallyframe.session import cut_lineage

MISSING = "missing"
UNEXPECTED = "unexpected"


def group_set_diff(
    primary: DataFrame,
    replicated: DataFrame,
    group: Sequence[str],
    item: str,
    flag: Column | Callable[[], Column] | None = None,
    expected: Sequence[str] = (),
    expected_if_flagged: Sequence[str] = (),
    optional_unless_flagged: Sequence[str] = (),
    info_cols: Sequence[str] = (),
    by: Sequence[str] = (),
    always_check_expected: bool = False,
    equality: DataFrame | None = None,
) -> DataFrame:
    """Missing and unexpected items per group, one row each.

    With P and R the item sets of a group and E its expected items (``expected``, plus
    ``expected_if_flagged`` where any row of either side satisfies ``flag``):

    * missing: P - R without the ``optional_unless_flagged`` items of unflagged groups, and also
      E - R if R is not empty and P does not hold all of E;
    * unexpected: R - P.

    The expectation part needs the two tables (of the same ``by`` values) to differ at all,
    unless ``always_check_expected``; pass ``equality`` (from :func:`tables_equal`) if it is known.
    ``info_cols`` come from the group's first row in the order of all columns: the primary's for
    missing items (the other side's if it has none), the replicated side's for unexpected ones.

    Sets are never built as arrays. Only group, item and flag move: they collapse to distinct
    (group, item) pairs and these to one row of facts per group, both before their shuffles.
    The join of the two has one row per group on one side, so a hot group can be split. Whole
    rows are read again only for the groups that are reported; with ``info_cols`` the reported items are stored for that.
    """
    group = [*by, *[g for g in group if g not in by]]
    wanted = list(dict.fromkeys([*expected, *expected_if_flagged]))
    is_flagged = F.lit(False) if flag is None else F.coalesce(flag() if callable(flag) else flag, F.lit(False))

    rows = known_keys(
        tagged_union(primary, replicated, [*group, F.col(item).alias("item"), is_flagged.alias("flagged")]), group
    )
    items = rows.groupBy(*group, "item").agg(
        F.expr(f"max({IN_PRIMARY}) = 1 AS in_p"),
        F.expr(f"max({IN_REPLICATED}) = 1 AS in_r"),
        F.expr("max(flagged) AS flagged"),
    )
    group_facts = {
        "is_flagged": "max(flagged)",
        "p_any": "coalesce(max(CASE WHEN item IS NOT NULL THEN in_p END), false)",
        "r_any": "coalesce(max(CASE WHEN item IS NOT NULL THEN in_r END), false)",
    }
    for i, e in enumerate(wanted):
        for side in ("p", "r"):
            group_facts[f"{side}_has_{i}"] = f"coalesce(max(CASE WHEN item = {_text(e)} THEN in_{side} END), false)"
    groups = (
        items.groupBy(*group).agg(*[F.expr(f"{e} AS {n}") for n, e in group_facts.items()]).where("p_any OR r_any")
    )

    # Items that only one side of the group holds. Both inputs of this join use the same columns
    # of the pairs, and no filter here can move below their aggregation, so Spark computes and
    # shuffles the pairs once.
    optional = ", ".join(_text(o) for o in optional_unless_flagged)
    reported = f"NOT (in_p AND item IN ({optional}) AND NOT is_flagged)" if optional else "true"
    out = (
        items.where("CASE WHEN in_p <> in_r THEN item END IS NOT NULL")
        .join(groups.select(*group, "is_flagged"), group)
        .selectExpr(*group, "item", "in_p", "is_flagged OR flagged AS is_flagged")
        .where(reported)
        .selectExpr(*group, "item", f"CASE WHEN in_p THEN '{MISSING}' ELSE '{UNEXPECTED}' END AS kind", "is_flagged")
    )
    if wanted:
        # Expected items that the replicated side lacks and the first part has not reported.
        def applies(e: str) -> str:
            return "true" if e in expected else "is_flagged"

        complete = " AND ".join(f"(NOT {applies(e)} OR p_has_{i})" for i, e in enumerate(wanted))
        lacking = []
        for i, e in enumerate(wanted):
            told = f"p_has_{i}" + (" AND is_flagged" if e in optional_unless_flagged else "")
            lacking.append(f"CASE WHEN {applies(e)} AND NOT r_has_{i} AND NOT ({told}) THEN {_text(e)} END")
        candidates = groups.where(f"r_any AND NOT ({complete})")
        if not always_check_expected:
            equality = tables_equal(primary, replicated, by) if equality is None else equality
            candidates = where_group(candidates, equality.withColumn("_differs", ~F.col("match")), by, "_differs")
        absent = (
            candidates.selectExpr(*group, f"explode(array({', '.join(lacking)})) AS item", "is_flagged")
            .where("item IS NOT NULL")
            .selectExpr(*group, "item", f"'{MISSING}' AS kind", "is_flagged")
        )
        out = out.unionByName(absent)
    # Stored, as two branches need it: else one task sorts for both, and the joins above run twice.
    return _with_info(cut_lineage(out, "items"), primary, replicated, group, info_cols) if info_cols else out


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with_info(out, primary, replicated, group, info_cols) -> DataFrame:
    """Adds the chosen columns of the first row of each reported group."""
    cols = list(primary.columns)
    whole = F.struct(*cols)
    rows = tagged_union(primary, replicated, cols).join(out.select(*group).distinct(), group, "left_semi")
    first = rows.groupBy(*group).agg(
        F.min(F.when(F.col(IN_PRIMARY) == 1, whole)).alias("first_p"),
        F.min(F.when(F.col(IN_REPLICATED) == 1, whole)).alias("first_r"),
    )
    source = F.expr(f"CASE WHEN kind = '{MISSING}' THEN coalesce(first_p, first_r) ELSE first_r END")
    return (
        out.join(first, group, "left")
        .withColumn("_first", source)
        .select(*out.columns, *[F.col(f"_first.{c}").alias(f"info_{c}") for c in info_cols])
    )


def group_set_totals(diffs: DataFrame, group: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Totals of :func:`group_set_diff`: missing, unexpected, groups with either."""
    own = [*by, *[g for g in group if g not in by]]
    per_one = diffs.groupBy(*own).agg(
        F.count_if(F.col("kind") == MISSING).alias("_m"), F.count_if(F.col("kind") == UNEXPECTED).alias("_u")
    )
    return per_group(
        per_one,
        by,
        F.coalesce(F.sum("_m"), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum("_u"), F.lit(0)).alias("n_unexpected"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def first_row_info(df: DataFrame, group: Sequence[str], info_cols: Sequence[str]) -> DataFrame:
    """Chosen columns of each group's first row in the order of all columns."""
    cols = [c for c in df.columns if c not in group]
    first = df.groupBy(*group).agg(F.min(F.struct(*cols)).alias("_row"))
    return first.select(*group, *[F.col(f"_row.{c}").alias(c) for c in info_cols if c in cols])
