"""Keyed comparison: pair the rows of both sides and compare their cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.labels import (
    BOTH_DIFFER,
    PRIMARY_ONLY_VALUE,
    REPLICATED_ONLY_VALUE,
    presence,
)
from tallyframe.operators.equality import multiset_counts, side_counts
from tallyframe.operators.keys import known_keys
from tallyframe.operators.ranking import positions, sample_per_group
from tallyframe.operators.tagged import per_group, quoted

Normalizer = Callable[[Column], Column]


def pair_by_key(
    primary: DataFrame,
    replicated: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str] | None = None,
    dedup: str | None = None,
    ts_col: str | None = None,
    track_equality: bool = True,
) -> DataFrame:
    """One row per key: row counts and the row of each side as structs ``p`` and ``r``.

    ``dedup=None`` is a full outer join, for keys that are unique on both sides. ``dedup="first"``
    takes any keys: equal rows collapse first, then each key keeps its first row in the order of
    all columns. Both steps combine before their shuffle, so neither a key nor a row that holds
    a large share of the table ends up in one task, and no key multiplies rows.

    ``unequal`` tells whether the rows of the key differ at all; ``p_min_ts``/``r_min_ts`` (with
    ``ts_col``) are the earliest times of the key on each side. Rows whose key is null belong to no
    key: ``"first"`` keeps them together with ``keyed`` false, so that row totals and equality stay
    whole; the join leaves them out. Without ``track_equality``, ``"first"`` needs one shuffle
    instead of two and ``unequal`` is null.
    """
    keys = list(keys)
    cols = [c for c in (primary.columns if cols is None else cols) if c not in keys]
    row = F.struct(*map(quoted, cols)) if cols else F.struct(F.lit(None).cast("string").alias("_none"))
    if dedup is None:
        return _pair_unique(known_keys(primary, keys), known_keys(replicated, keys), keys, row, ts_col)
    if dedup != "first":
        raise ValueError("dedup is None or 'first'")

    if track_equality:
        counts = multiset_counts(primary, replicated, [*keys, *cols], ts_col)
    else:
        counts = side_counts(primary, replicated, [*keys, *cols], ts_col)
    left, right = F.col("primary_count") > 0, F.col("replicated_count") > 0
    aggregates = [
        F.sum("primary_count").alias("p_rows"),
        F.sum("replicated_count").alias("r_rows"),
        F.expr(
            "count_if(primary_count <> replicated_count) > 0" if track_equality else "CAST(NULL AS BOOLEAN)"
        ).alias("unequal"),
        F.min(F.when(left, row)).alias("p"),
        F.min(F.when(right, row)).alias("r"),
    ]
    if ts_col:
        aggregates += [F.min(t).alias(t) for t in ("p_min_ts", "r_min_ts")]
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    return counts.groupBy(*keys).agg(*aggregates).withColumn("keyed", keyed)


def _pair_unique(primary, replicated, keys, row, ts_col) -> DataFrame:
    def side(df: DataFrame, name: str) -> DataFrame:
        ts = [F.col(ts_col).alias(f"{name}_min_ts")] if ts_col else []
        return df.select(*keys, row.alias(name), *ts)

    return side(primary, "p").join(side(replicated, "r"), keys, "full").select(
        *keys,
        F.col("p").isNotNull().cast("bigint").alias("p_rows"),
        F.col("r").isNotNull().cast("bigint").alias("r_rows"),
        (~F.col("p").eqNullSafe(F.col("r"))).alias("unequal"),
        "p",
        "r",
        F.lit(True).alias("keyed"),
        *(["p_min_ts", "r_min_ts"] if ts_col else []),
    )


def without_equal_rows(
    paired: DataFrame, keys: Sequence[str], cols: Sequence[str], by: Sequence[str] = (), null_is_empty: bool = False
) -> DataFrame:
    """The pairs with keys and rows only where the sides differ; counts stay.

    What all counts and details of a keyed comparison need, small enough to be stored.
    """
    same = ~F.coalesce(F.col("unequal"), F.lit(True))
    for c in cols:
        same &= ~F.coalesce(cell_differs(c, None, null_is_empty), F.lit(False))
    gone = {*keys, "p", "r"} - {*by}
    return paired.withColumns({c: F.when(~same, F.col(quoted(c))) for c in paired.columns if c in gone})


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# SQL texts, so that one call builds a whole expression.
_BOTH = "(keyed AND p_rows > 0 AND r_rows > 0)"
_ONLY_P = "(keyed AND p_rows > 0 AND r_rows = 0)"
_ONLY_R = "(keyed AND p_rows = 0 AND r_rows > 0)"


def in_both() -> Column:
    """The key of a paired row is on both sides."""
    return F.expr(_BOTH)


def only_primary() -> Column:
    return F.expr(_ONLY_P)


def only_replicated() -> Column:
    return F.expr(_ONLY_R)


def cell_differs(col: str, normalize: Normalizer | None = None, null_is_empty: bool = False) -> Column:
    """Whether the cells of one column differ in a paired row (null equals null)."""
    left, right = f"p.{quoted(col)}", f"r.{quoted(col)}"
    if null_is_empty:
        raw = f"coalesce(string({left}), '') <> coalesce(string({right}), '')"
    else:
        raw = f"NOT ({left} <=> {right})"
    if normalize is None:
        return F.expr(raw)
    # Equal cells are equal normalised, so the patterns only run on cells that differ.
    return F.expr(raw) & (normalize(F.col(left)) != normalize(F.col(right)))


def cell_class(col: str, normalize: Normalizer | None = None, null_is_empty: bool = False) -> Column:
    """How the cells of one column differ in a paired row; null if they do not."""
    if normalize is None:
        left, right = (F.expr(f"coalesce(string({s}.{quoted(col)}), '') = ''") for s in "pr")
    else:
        left, right = (normalize(F.col(f"{s}.{quoted(col)}")) == "" for s in "pr")
    return F.when(
        cell_differs(col, normalize, null_is_empty),
        F.when(~left & right, PRIMARY_ONLY_VALUE).when(left & ~right, REPLICATED_ONLY_VALUE).otherwise(BOTH_DIFFER),
    )


def cell_diffs(
    paired: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    normalize: Normalizer | None = None,
    null_is_empty: bool = False,
) -> DataFrame:
    """One row per differing cell of keys on both sides: key, column, both values, class.

    Rows without any difference go before the cells are unpivoted.
    """
    if not cols:
        raise ValueError("no columns to compare")
    any_differs = reduce(lambda a, b: a | b, [cell_differs(c, normalize, null_is_empty) for c in cols])
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.expr(f"string(p.{quoted(c)}) AS primary_value"),
                F.expr(f"string(r.{quoted(c)}) AS replicated_value"),
                cell_class(c, normalize, null_is_empty).alias("diff_class"),
            )
            for c in cols
        ]
    )
    return (
        paired.where(_BOTH)
        .where(any_differs)
        .select(*keys, F.inline(cells))
        .where("diff_class IS NOT NULL")
    )


def keyed_stats(
    paired: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    normalize: Normalizer | None = None,
    null_is_empty: bool = False,
) -> DataFrame:
    """All counts of a keyed comparison per group, in one aggregation over the pairs.

    ``column_stats`` holds one struct per compared column; nothing is unpivoted, so the work per
    pair does not create rows.
    """
    names = [f"_c{i}" for i in range(len(cols))]
    classes = [
        F.when(in_both(), cell_class(c, normalize, null_is_empty)).alias(n) for c, n in zip(cols, names)
    ]
    has_ts = "p_min_ts" in paired.columns
    rows = paired.select(
        *by, "p_rows", "r_rows", "unequal", "keyed", *(["p_min_ts", "r_min_ts"] if has_ts else []), *classes
    )
    any_differs = " OR ".join(f"{n} IS NOT NULL" for n in names) or "false"
    totals = {
        "primary_rows": "coalesce(sum(p_rows), 0)",
        "replicated_rows": "coalesce(sum(r_rows), 0)",
        "n_primary_only": f"count_if({_ONLY_P})",
        "n_replicated_only": f"count_if({_ONLY_R})",
        "n_common": f"count_if({_BOTH})",
        "n_records_with_diffs": f"count_if({any_differs})",
        "n_duplicate_primary": "count_if(keyed AND p_rows > 1)",
        "n_duplicate_replicated": "count_if(keyed AND r_rows > 1)",
        "n_unequal": "count_if(unequal)",
    }
    if has_ts:
        totals["primary_min_ts"] = "min(p_min_ts)"
        totals["extra_min_ts"] = f"min(CASE WHEN {_ONLY_R} THEN r_min_ts END)"
    per_class = {
        f"{n}{suffix}": f"count_if({n} = '{label}')"
        for n in names
        for suffix, label in (("p", PRIMARY_ONLY_VALUE), ("r", REPLICATED_ONLY_VALUE), ("b", BOTH_DIFFER))
    }
    counted = per_group(rows, by, *[F.expr(f"{e} AS {n}") for n, e in {**totals, **per_class}.items()])
    stats = ", ".join(
        f"named_struct('column', {_literal(c)}, 'n_records', {n}p + {n}r + {n}b, 'n_primary_only_value', {n}p,"
        f" 'n_replicated_only_value', {n}r, 'n_both_differ', {n}b)"
        for c, n in zip(cols, names)
    )
    kind = (
        "ARRAY<STRUCT<column: STRING, n_records: BIGINT, n_primary_only_value: BIGINT,"
        " n_replicated_only_value: BIGINT, n_both_differ: BIGINT>>"
    )
    return counted.select(*by, *totals, F.expr(f"CAST(array({stats}) AS {kind}) AS column_stats"))


def column_diffs(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column that differs somewhere, from :func:`keyed_stats`."""
    return stats.select(*by, F.inline("column_stats")).where("n_records > 0")


OLD_DATA = "coalesce(extra_min_ts < primary_min_ts, false)"


def old_data(stats: DataFrame) -> Column:
    """Rows only in the replicated side start before the primary's time range."""
    return F.expr(OLD_DATA)


def pair_presence(paired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side holds, from the pairs."""
    return paired.where(only_primary() | only_replicated()).select(
        *keys, presence(F.col("p_rows") > 0, F.col("r_rows") > 0).alias("presence")
    )


def key_samples(
    cells: DataFrame, keys: Sequence[str], n: int, by: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` differing keys of each column, in key order."""
    own = [k for k in keys if k not in by]
    first = sample_per_group(cells.select(*by, "column", *own), [*by, "column"], own, n)
    return first


def one_sided_samples(
    paired: DataFrame, keys: Sequence[str], n: int, by: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` one-sided rows of each side and group, as JSON text, in key order."""
    own = [k for k in keys if k not in by]
    rows = paired.where(only_primary() | only_replicated()).select(
        *keys,
        presence(F.col("p_rows") > 0, F.col("r_rows") > 0).alias("presence"),
        F.to_json(F.coalesce("p", "r")).alias("record"),
    )
    return sample_per_group(rows, [*by, "presence"], own, n)


def one_sided_keys(
    paired: DataFrame, keys: Sequence[str], order: Column, n: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Keys that only one side holds, with their ``position`` (from 1) per side and group by ``order``.

    The first ``n``, or all of them: those are numbered over all tasks. A key whose ``order`` is null is left out.
    """
    found = pair_presence(paired, keys).withColumn("_order", order).where("_order IS NOT NULL")
    groups, own = [*by, "presence"], [k for k in keys if k not in by]
    if n is None:
        return positions(found, groups, ["_order", *own]).drop("_order")
    first = sample_per_group(found, groups, ["_order", *own], n)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("_order", *own))
    return first.withColumn("position", place.cast("bigint")).drop("_order")


def with_equal_rows(stats: DataFrame, equal: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`keyed_stats` of a part of both sides, with the totals of the equal rest added.

    ``equal`` has n_rows, n_keys, n_repeated and min_ts per group; a group that is equal in whole has no row in ``stats``.
    """
    rest = equal.select(*by, *[F.col(c).alias(f"_{c}") for c in ("n_rows", "n_keys", "n_repeated", "min_ts")])
    joined = stats.join(rest, list(by), "full") if by else stats.crossJoin(rest)  # one row each
    more = {
        "primary_rows": "_n_rows", "replicated_rows": "_n_rows", "n_common": "_n_keys",
        "n_duplicate_primary": "_n_repeated", "n_duplicate_replicated": "_n_repeated",
    }
    out = []
    for c in stats.columns:
        kept = F.coalesce(F.col(c), F.lit(0)) if dict(stats.dtypes)[c] == "bigint" and c not in by else F.col(quoted(c))
        if c in more:
            kept = kept + F.coalesce(more[c], F.lit(0))
        if c == "primary_min_ts":
            kept = F.least(c, "_min_ts")
        if c == "column_stats":
            kept = F.coalesce(c, F.array().cast(stats.schema[c].dataType))
        out.append(kept.alias(c))
    return joined.select(*out)
