"""Compare one pair of tables, or a whole run of datasets for all employers at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import labels
from tallyframe.functions.numbers import exact_number, number_text
from tallyframe.functions.text import is_digits
from tallyframe.functions.values import try_time
from tallyframe.operators import cells, equality, groups, keys, positional, schema
from tallyframe.operators.ranking import sample_per_group
from tallyframe.operators.tagged import per_group, where_group
from tallyframe.plans.rules import CompareRules, DatasetSpec, apply_rules, row_columns, spec_for
from tallyframe.session import cut_lineage

# Texts of summaries.
PERFECT_MATCH = "Perfect match"
MATCH = "Match"
OLD_DATA = "Extra records contain OLD DATA (created before primary's time range)"
# Fixed value: how many differing keys of a column are listed.
LISTED_KEYS = 10

RESULT_SCHEMA = (
    "dataset string, kind string, match boolean, equivalent boolean, status string,"
    " primary_rows bigint, replicated_rows bigint, n_primary_only bigint, n_replicated_only bigint,"
    " n_records_with_diffs bigint, difference_count bigint, n_duplicate_keys bigint, has_old_data boolean,"
    " columns_compared string, summary string, error string"
)
_RESULT_COLS = [part.split()[0] for part in RESULT_SCHEMA.split(",")]


FRAMES = (
    "results",
    "column_diffs",
    "column_samples",
    "key_presence",
    "one_sided_keys",
    "cell_diffs",
    "record_samples",
    "set_diffs",
)


class Diff:
    """Difference frames of a comparison; each starts with the ``by`` columns and ``dataset``.

    ``results`` has one row per group, the others hold the details; a frame that a comparison
    does not have is None. Frames are given as DataFrames or as functions that build them when
    first asked for.
    """

    def __init__(self, **frames: DataFrame | Callable[[], DataFrame] | None) -> None:
        unknown = set(frames) - set(FRAMES)
        if unknown:
            raise TypeError(f"no such frames: {sorted(unknown)}")
        self._frames = {n: f for n, f in frames.items() if f is not None}

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in FRAMES:
            raise AttributeError(name)
        frame = self._frames.get(name)
        if callable(frame):
            frame = self._frames[name] = frame()
        return frame

    def names(self) -> list[str]:
        return [n for n in FRAMES if n in self._frames]

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in self.names()}


# SQL texts of messages; a message is null where it does not apply.
_ROW_COUNT = (
    "CASE WHEN primary_rows <> replicated_rows"
    " THEN concat('Row count: Primary=', primary_rows, ', Replicated=', replicated_rows) END"
)
_BOTH_SIDES = "(primary_rows > 0 AND replicated_rows > 0)"


def _counted(label: str, count: str, where: str = "true") -> str:
    return f"CASE WHEN {where} AND {count} > 0 THEN concat('{label}: ', {count}) END"


def _sql_text(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _result(df: DataFrame, by: Sequence[str], dataset: str, spec: DatasetSpec, columns: Sequence[str],
            messages: Sequence[str], match: str, same_columns: bool = True, **values: str) -> DataFrame:
    """Result rows; ``values`` are SQL texts of the counts a mode knows, the others are 0."""

    def count(name: str) -> str:
        return f"CAST({values.get(name, name if name in df.columns else '0')} AS BIGINT) AS {name}"

    base = df.selectExpr(
        *[f"`{c}`" for c in by],
        f"({match}) AND {str(same_columns).lower()} AS match",
        "CAST(primary_rows AS BIGINT) AS primary_rows",
        "CAST(replicated_rows AS BIGINT) AS replicated_rows",
        *[count(c) for c in ("n_primary_only", "n_replicated_only", "n_records_with_diffs", "n_duplicate_keys")],
        f"{values.get('has_old_data', 'false')} AS has_old_data",
        f"concat_ws('; ', {', '.join([_ROW_COUNT, *messages])}) AS _text",
    )
    derived = {
        "dataset": _sql_text(dataset),
        "kind": f"'{spec.kind}'",
        "equivalent": "match OR _text = ''",
        "status": f"CASE WHEN match THEN '{labels.IDENTICAL}' ELSE '{labels.DIFFERENCES}' END",
        "difference_count": "n_primary_only + n_replicated_only + n_records_with_diffs",
        "columns_compared": _sql_text(",".join(columns)),
        "summary": f"CASE WHEN match THEN '{PERFECT_MATCH}' WHEN _text = '' THEN '{MATCH}' ELSE _text END",
        "error": "CAST(NULL AS STRING)",
    }
    return base.selectExpr(
        *[f"`{c}`" for c in by], *[f"{derived[c]} AS {c}" if c in derived else c for c in _RESULT_COLS]
    )


def _key_text(key_cols: Sequence[str], by: Sequence[str], key_cast: str | None = None) -> Column:
    """Key as text; numbers in their shortest form."""

    def text(k: str) -> Column:
        return number_text(F.col(f"`{k}`")) if key_cast else F.col(f"`{k}`").cast("string")

    return F.concat_ws("|", *[text(k) for k in key_cols if k not in by])


def _keyed_frames(paired, key_cols, compared, spec, by, dataset, n_samples) -> dict[str, Callable[[], DataFrame]]:
    """The detail frames of a keyed comparison, all from the pairs whose rows differ."""
    name = F.lit(dataset).alias("dataset")
    key = _key_text(key_cols, by, spec.key_cast).alias("key")

    def changed() -> DataFrame:
        return paired.where("unequal")

    def diffs() -> DataFrame:
        return cells.cell_diffs(changed(), key_cols, compared, spec.normalize, spec.null_is_empty)

    out = {
        "key_presence": lambda: cells.pair_presence(changed(), key_cols).select(*by, name, key, "presence"),
        "record_samples": lambda: cells.one_sided_samples(changed(), key_cols, n_samples, by).select(
            *by, name, "presence", key, "record"
        ),
    }
    if spec.listed_keys is not None:
        (own,) = spec.keys
        number = F.col(f"`{own}`") if spec.key_cast else F.when(is_digits(F.col(f"`{own}`")), exact_number(F.col(f"`{own}`")))
        n = None if spec.listed_keys == "all" else spec.listed_keys
        out["one_sided_keys"] = lambda: cells.one_sided_keys(changed(), key_cols, number, n, by).select(
            *by, name, "presence", "position", key
        )
    if compared:
        out["cell_diffs"] = lambda: diffs().select(
            *by, name, key, "column", "primary_value", "replicated_value", "diff_class"
        )
        out["column_samples"] = lambda: cells.key_samples(diffs(), key_cols, LISTED_KEYS, by).select(
            *by, name, "column", key
        )
    return out


def _compare_keyed(primary, replicated, cols, spec, dataset, by, n_samples, stored, equal=None) -> Diff:
    """First row per key on each side, cells compared through the normaliser."""
    key_cols = [*by, *spec.keys]
    if spec.key_cast:
        if spec.key_cast != "number":
            raise ValueError("key_cast is 'number' or None")
        primary, replicated = (
            df.withColumns({k: exact_number(F.col(k)) for k in spec.keys}) for df in (primary, replicated)
        )
    ts = spec.ts_col if spec.ts_col in primary.columns and spec.ts_col in replicated.columns else None
    if ts:
        primary, replicated = (df.withColumn("_time", try_time(F.col(ts))) for df in (primary, replicated))
    row_cols = [c for c in cols if c not in key_cols and c in replicated.columns]
    compared = schema.compared_columns(
        primary.select(*row_cols), replicated, key_cols, spec.compare_exclude
    )
    paired = cells.pair_by_key(
        primary, replicated, key_cols, row_cols, dedup="first", ts_col="_time" if ts else None
    )
    if stored:
        paired = cut_lineage(cells.without_equal_rows(paired, key_cols, compared, by, spec.null_is_empty), "paired")
    stats = cells.keyed_stats(paired, compared, by, spec.normalize, spec.null_is_empty)
    if equal is not None:
        stats = cells.with_equal_rows(stats, equal, by)
    if stored:
        stats = cut_lineage(stats, "stats")
    duplicates = "n_duplicate_primary + n_duplicate_replicated"
    values = {"n_duplicate_keys": duplicates}
    messages = [
        _counted(f"{spec.record_noun} in primary but NOT in replicated", "n_primary_only"),
        _counted(f"{spec.record_noun} in replicated but NOT in primary", "n_replicated_only"),
        _counted(f"Matching {spec.matching_noun} with data differences", "n_records_with_diffs"),
    ]
    if ts:
        values["has_old_data"] = cells.OLD_DATA
        messages.insert(2, f"CASE WHEN {cells.OLD_DATA} THEN {_sql_text(OLD_DATA)} END")
    if spec.dedup == "error":
        messages.append(_counted("Duplicate keys", f"({duplicates})"))
    same = primary.columns == replicated.columns
    return Diff(
        results=_result(stats, by, dataset, spec, cols, messages, "n_unequal = 0", same, **values),
        column_diffs=lambda: _column_diffs(stats, by, dataset),
        **_keyed_frames(paired, key_cols, compared, spec, by, dataset, n_samples),
    )


def _column_diffs(stats: DataFrame, by: Sequence[str], dataset: str) -> DataFrame:
    return cells.column_diffs(stats, by).select(*by, F.lit(dataset).alias("dataset"), *_COLUMN_STATS)


_COLUMN_STATS = ["column", "n_records", "n_primary_only_value", "n_replicated_only_value", "n_both_differ"]


def _compare_groups(primary, replicated, cols, spec, dataset, by, n_samples, stored) -> Diff:
    """Items per group; needs the group and item columns on both sides."""
    rules = spec.groups
    for side in (primary, replicated):
        lacking = [c for c in (*spec.keys, rules.item) if c not in side.columns]
        if lacking:
            raise ValueError(f"{dataset}: no column {', '.join(lacking)}")
    cols = [c for c in cols if c in replicated.columns]
    primary, replicated = primary.select(*cols), replicated.select(*cols)
    group = [*by, *spec.keys]
    has_flag = rules.flag is not None and "object_changes" in cols
    # One row per group; two parts of the result need it, and it takes all columns to compute.
    equal = cut_lineage(equality.tables_equal(primary, replicated, by), "equality")
    diffs = groups.group_set_diff(
        primary,
        replicated,
        group,
        rules.item,
        flag=rules.flag if has_flag else None,
        expected=rules.expected,
        expected_if_flagged=rules.expected_if_flagged,
        optional_unless_flagged=rules.optional_unless_flagged,
        info_cols=[c for c in rules.info_cols if c in cols],
        by=by,
        always_check_expected=rules.always_check_expected,
        equality=equal,
    )
    if stored:
        diffs = cut_lineage(diffs, "sets")
    info = [c for c in rules.info_cols if c in cols]
    named = [x for c in info for x in (F.lit(c), F.col(f"info_{c}").cast("string"))]
    own = _key_text(group, by).alias("group_key")
    set_diffs = diffs.select(
        *by,
        F.lit(dataset).alias("dataset"),
        own,
        "item",
        "kind",
        "is_flagged",
        (F.create_map(*named) if named else F.expr("CAST(map() AS MAP<STRING, STRING>)")).alias("info"),
    )
    totals = groups.group_set_totals(diffs, group, by)
    if by:
        totals = equal.join(totals, list(by), "left")
    else:
        totals = equal.withColumns(
            {c: totals.select(c).scalar() for c in ("n_missing", "n_unexpected", "n_groups")}
        )
    n_missing, n_unexpected, n_groups = (
        f"coalesce({c}, 0)" for c in ("n_missing", "n_unexpected", "n_groups")
    )
    messages = [
        _counted("Missing actions in replicated", n_missing),
        _counted("Unexpected actions in replicated", n_unexpected),
        _counted("Row numbers with action mismatches", n_groups),
    ]
    return Diff(
        results=_result(
            totals, by, dataset, spec, cols, messages, "match", n_primary_only=n_missing,
            n_replicated_only=n_unexpected,
        ),
        set_diffs=set_diffs,
    )


def _compare_generic(primary, replicated, cols, spec, dataset, by, n_samples, stored) -> Diff:
    """Keyed where the key is unique on both sides, whole rows elsewhere (per ``by`` group)."""
    left_only, right_only = schema.one_sided_columns(primary, replicated)
    if left_only or right_only:
        return _compare_schemas(primary, replicated, left_only, right_only, spec, dataset, by)
    same = primary.columns == replicated.columns
    replicated = replicated.select(*primary.columns)
    if not set(spec.keys) <= set(primary.columns):
        return _compare_rows(primary, replicated, cols, spec, dataset, by, same, n_samples)
    # Keys compare as text, null like the empty text.
    primary, replicated = (
        df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in spec.keys})
        for df in (primary, replicated)
    )
    # Stored because it is small and read again: Spark then knows its size and broadcasts it only
    # if that is safe.
    unique = keys.key_uniqueness(primary, replicated, spec.keys, by)
    repeated = cut_lineage(unique.where(~F.col("is_unique")), "repeated")
    if repeated.isEmpty():
        return _compare_unique(primary, replicated, cols, spec, dataset, by, same, n_samples, stored)
    if not by:
        return _compare_rows(primary, replicated, cols, spec, dataset, by, same, n_samples)
    by_keys, by_rows = [], []
    for df in (primary, replicated):
        by_keys.append(keys.rows_without_keys(df, repeated, by))
        by_rows.append(keys.rows_with_keys(df, repeated, by))
    return union_diffs(
        [
            _compare_unique(*by_keys, cols, spec, dataset, by, same, n_samples, stored),
            _compare_rows(*by_rows, cols, spec, dataset, by, same, n_samples),
        ]
    )


def _compare_unique(primary, replicated, cols, spec, dataset, by, same_columns, n_samples, stored, equal=None) -> Diff:
    key_cols = [*by, *spec.keys]
    row_cols = [c for c in cols if c not in key_cols]
    compared = [c for c in row_cols if c not in spec.compare_exclude]
    paired = cells.pair_by_key(primary, replicated, key_cols, row_cols)
    if stored:
        paired = cut_lineage(cells.without_equal_rows(paired, key_cols, compared, by, spec.null_is_empty), "paired")
    stats = cells.keyed_stats(paired, compared, by, spec.normalize, spec.null_is_empty)
    if equal is not None:
        stats = cells.with_equal_rows(stats, equal, by)
    if stored:
        stats = cut_lineage(stats, "stats")
    messages = [
        _counted("Records in primary but NOT in replicated", "n_primary_only", _BOTH_SIDES),
        _counted("Records in replicated but NOT in primary", "n_replicated_only", _BOTH_SIDES),
        _counted("Matching records with data differences", "n_records_with_diffs", _BOTH_SIDES),
    ]
    return Diff(
        results=_result(stats, by, dataset, spec, cols, messages, "n_unequal = 0", same_columns),
        column_diffs=lambda: _column_diffs(stats, by, dataset),
        **_keyed_frames(paired, key_cols, compared, spec, by, dataset, n_samples),
    )


def _compare_rows(primary, replicated, cols, spec, dataset, by, same_columns, n_samples) -> Diff:
    """Whole rows: positional, distinct or multiset."""
    row_cols = [c for c in cols if c not in by]
    counts = equality.multiset_counts(primary, replicated, [*by, *row_cols])
    totals = equality.distinct_merge_summary(counts, by)
    if spec.full_row in ("multiset", "aligned"):
        mode = _multiset_rows if spec.full_row == "multiset" else _aligned_rows
        return mode(counts, totals, row_cols, cols, spec, dataset, by, same_columns, n_samples)

    totals = cut_lineage(totals, "totals")
    use_position = {"auto": "primary_rows = replicated_rows", "positional": "true", "distinct": "false"}[spec.full_row]
    merged, placed = f"{_BOTH_SIDES} AND NOT ({use_position})", f"{_BOTH_SIDES} AND ({use_position})"
    record = F.to_json(F.struct(*row_cols)).alias("record")
    samples: list[Callable[[], DataFrame]] = []
    if spec.full_row != "positional":

        def one_sided() -> DataFrame:
            rows = where_group(
                counts.where("(primary_count = 0) <> (replicated_count = 0)"),
                totals.withColumn("_use", F.expr(merged)), by, "_use",
            )
            side = labels.presence(F.col("primary_count") > 0, F.col("replicated_count") > 0)
            return rows.select(*by, side.alias("presence"), record)

        samples.append(one_sided)
    if spec.full_row != "distinct":
        shifted = where_group(
            counts, totals.withColumn("_use", F.expr(f"{placed} AND n_unbalanced > 0")), by, "_use"
        )
        runs = positional.runs_of_counts(shifted, by)
        moved = positional.positional_summary(runs, by).select(*by, "n_different")
        if by:
            totals = totals.join(moved, list(by), "left")
        else:
            totals = totals.withColumn("n_different", moved.select("n_different").scalar())

        def displaced() -> DataFrame:
            pairs = positional.positional_samples(runs, n_samples, by)
            return reduce(
                DataFrame.unionByName,
                [
                    pairs.where(F.col(side).isNotNull()).select(
                        *by, F.lit(label).alias("presence"), F.to_json(side).alias("record")
                    )
                    for side, label in (("primary", labels.PRIMARY_ONLY), ("replicated", labels.REPLICATED_ONLY))
                ],
            )

        samples.append(displaced)
    else:
        totals = totals.withColumn("n_different", F.lit(0))

    only_p, only_r, changed = (
        f"CASE WHEN {merged} THEN {c} ELSE 0 END"
        for c in ("n_primary_only", "n_replicated_only", "n_matching_with_diffs")
    )
    moved_rows = f"CASE WHEN {placed} THEN coalesce(n_different, 0) ELSE 0 END"
    messages = [
        _counted("Rows with data differences", moved_rows),
        _counted("Records in primary but NOT in replicated", only_p),
        _counted("Records in replicated but NOT in primary", only_r),
        _counted("Matching records with data differences", changed),
    ]
    return Diff(
        results=_result(
            totals, by, dataset, spec, cols, messages, "n_unbalanced = 0", same_columns,
            n_primary_only=only_p, n_replicated_only=only_r, n_records_with_diffs=f"{moved_rows} + {changed}",
        ),
        record_samples=lambda: _record_samples(
            reduce(DataFrame.unionByName, [s() for s in samples]), dataset, by, n_samples
        ),
    )


def _multiset_rows(counts, totals, row_cols, cols, spec, dataset, by, same_columns, n_samples) -> Diff:
    surplus = counts.where("primary_count <> replicated_count").withColumn(
        "_more", F.expr("primary_count - replicated_count")
    )
    over = per_group(
        surplus, by, F.expr("sum(greatest(_more, 0L)) AS over_p"), F.expr("sum(greatest(-_more, 0L)) AS over_r")
    )
    if by:
        totals = totals.join(over, list(by), "left")
    else:
        totals = totals.withColumns({c: over.select(c).scalar() for c in ("over_p", "over_r")})
    over_p, over_r = "coalesce(over_p, 0)", "coalesce(over_r, 0)"
    messages = [
        _counted("Records in primary but NOT in replicated", over_p),
        _counted("Records in replicated but NOT in primary", over_r),
    ]
    record = F.to_json(F.struct(*row_cols)).alias("record")
    side = labels.presence(F.col("_more") > 0, F.col("_more") < 0).alias("presence")
    return Diff(
        results=_result(
            totals, by, dataset, spec, cols, messages, "n_unbalanced = 0", same_columns,
            n_primary_only=over_p, n_replicated_only=over_r,
        ),
        record_samples=lambda: _record_samples(surplus.select(*by, side, record), dataset, by, n_samples),
    )


def _aligned_rows(counts, totals, row_cols, cols, spec, dataset, by, same_columns, n_samples) -> Diff:
    """Sorted rows of both sides set against each other between the rows that both hold."""
    left = positional.aligned_rows(counts, by)
    found = positional.aligned_summary(left, by)
    names = ("n_changed", "n_primary_extra", "n_replicated_extra")
    if by:
        totals = totals.join(found, list(by), "left")
    else:
        totals = totals.withColumns({c: found.select(c).scalar() for c in names})
    changed, only_p, only_r = (f"coalesce({c}, 0)" for c in names)
    messages = [
        _counted("Rows with data differences", changed),
        _counted("Records in primary but NOT in replicated", only_p),
        _counted("Records in replicated but NOT in primary", only_r),
    ]

    def samples() -> DataFrame:
        pairs = positional.aligned_samples(left, n_samples, by)
        sides = [("primary", labels.PRIMARY_ONLY), ("replicated", labels.REPLICATED_ONLY)]
        rows = [
            pairs.where(F.col(side).isNotNull()).select(*by, F.lit(label).alias("presence"), F.to_json(side).alias("record"))
            for side, label in sides
        ]
        return _record_samples(rows[0].unionByName(rows[1]), dataset, by, n_samples)

    return Diff(
        results=_result(
            totals, by, dataset, spec, cols, messages, "n_unbalanced = 0", same_columns,
            n_primary_only=only_p, n_replicated_only=only_r, n_records_with_diffs=changed,
        ),
        record_samples=samples,
    )


def _record_samples(rows: DataFrame, dataset: str, by: Sequence[str], n: int) -> DataFrame:
    """The first rows of each side, without a key."""
    return sample_per_group(rows, [*by, "presence"], ["record"], n).select(
        *by, F.lit(dataset).alias("dataset"), "presence", F.lit(None).cast("string").alias("key"), "record"
    )


def _compare_schemas(primary, replicated, left_only, right_only, spec, dataset, by) -> Diff:
    """Different column sets: rows are counted but not compared."""
    totals = equality.row_counts(primary, replicated, by)
    messages = [
        f"CASE WHEN {_BOTH_SIDES} THEN {_sql_text(f'Columns only in {side}: ' + ', '.join(sorted(names)))} END"
        for side, names in (("primary", left_only), ("replicated", right_only))
        if names
    ]
    return Diff(results=_result(totals, by, dataset, spec, primary.columns, messages, "false"))


_MODES: dict[str, Callable[..., Diff]] = {
    "generic": _compare_generic,
    "keyed": _compare_keyed,
    "groups": _compare_groups,
}


def compare_tables(
    primary: DataFrame,
    replicated: DataFrame,
    dataset: str = "dataset",
    spec: DatasetSpec | None = None,
    rules: CompareRules | None = None,
    by: Sequence[str] = (),
    stored: bool = False,
) -> Diff:
    """Compare two versions of a dataset; ``by`` columns (such as ``emp_id``) compare apart.

    The result frames are lazy, apart from what decides how to go on: whether keys are unique,
    totals of whole rows, equality of grouped tables, and the layout of a positional comparison.
    With ``stored``, the pairs are computed once into the shared folder, equal rows without their cells, and
    so are the counts, which pays when several frames are read.
    """
    rules = rules or CompareRules()
    spec = spec or spec_for(dataset)
    by = list(by)
    primary, replicated = (_wrap(apply_rules(df, dataset, rules, spec), by) for df in (primary, replicated))
    return _unwrap(_compare(primary, replicated, dataset, spec, rules, by, stored), by)


def _wrap(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by`` values as structs of one field: these are never null, so a null employer is a group like any other."""
    return df.withColumns({c: F.struct(F.col(f"`{c}`").alias("value")) for c in by}) if by else df


def _unwrap(diff: Diff, by: Sequence[str]) -> Diff:
    def plain(name: str) -> Callable[[], DataFrame]:
        return lambda: getattr(diff, name).withColumns({c: F.col(f"`{c}`.value") for c in by})

    return Diff(**{name: plain(name) for name in diff.names()}) if by else diff


def _compare(primary, replicated, dataset, spec, rules, by, stored) -> Diff:
    cols = row_columns(primary, dataset, rules, spec)
    if spec.mode == "keyed" and not set(spec.keys) <= {*primary.columns} & {*replicated.columns}:
        # Without its key such a dataset is only counted and tested for equality.
        totals = equality.tables_equal(primary.select(*cols), replicated.select(
            *row_columns(replicated, dataset, rules, spec)), by)
        return Diff(results=_result(totals, by, dataset, spec, cols, [], "match"))
    return _MODES[spec.mode](primary, replicated, cols, spec, dataset, by, rules.max_samples, stored)


def compare_prepared(primary, replicated, cols, spec, dataset, by, n_samples, stored, equal) -> Diff:
    """By key, two sides to which rules are applied already and whose other rows, totalled in ``equal``, are equal.

    For datasets whose keys are unique where their mode asks for that.
    """
    sides = [_wrap(df, by) for df in (primary, replicated)]
    if spec.mode == "keyed":
        return _unwrap(_compare_keyed(*sides, cols, spec, dataset, by, n_samples, stored, _wrap(equal, by)), by)
    return _unwrap(_compare_unique(*sides, cols, spec, dataset, by, True, n_samples, stored, _wrap(equal, by)), by)


def union_diffs(diffs: Sequence[Diff]) -> Diff:
    """The frames of several comparisons under each other."""

    def stacked(name: str) -> Callable[[], DataFrame]:
        return lambda: reduce(DataFrame.unionByName, [getattr(d, name) for d in diffs if name in d.names()])

    return Diff(**{n: stacked(n) for n in FRAMES if any(n in d.names() for d in diffs)})


def error_result(spark: SparkSession, dataset: str, kind: str, problem: str, by_schema: str = "") -> DataFrame:
    """Result row of a dataset that could not be compared."""
    head = by_schema + ", " if by_schema else ""
    n_by = len(by_schema.split(",")) if by_schema else 0
    row = (None,) * n_by + (
        dataset, kind, False, False, labels.ERROR, None, None, 0, 0, 0, 0, 0, False, "",
        f"Error: {problem}", problem,
    )
    return spark.createDataFrame([row], head + RESULT_SCHEMA)


def compare_run(
    spark: SparkSession,
    tables: Mapping[str, tuple[DataFrame, DataFrame]],
    rules: CompareRules | None = None,
    specs: Mapping[str, DatasetSpec] | None = None,
    by: Sequence[str] = ("emp_id",),
    stored: bool = False,
) -> Diff:
    """Compare all datasets of a run, every employer in the same jobs.

    Excluded datasets are left out. A dataset that cannot be compared becomes a result row with
    status ``ERROR``; the others go on. The frames are lazy, so that holds for what fails before it runs. With ``stored``,
    each dataset is computed apart into the shared folder (:func:`tallyframe.plans.batch.run_isolated`), and it holds for
    whatever fails while running, too.
    """
    rules = rules or CompareRules()
    if stored:
        from tallyframe.plans.batch import run_isolated  # it builds on this module

        return run_isolated(spark, tables, None, rules, specs, by).diff()
    diffs: list[Diff] = []
    failed: list[tuple[str, str, str]] = []
    by_schema = ""
    for name in sorted(n for n in tables if not rules.is_excluded(n)):
        spec = (specs or {}).get(name) or spec_for(name)
        try:
            primary, replicated = tables[name]
            diffs.append(compare_tables(primary, replicated, name, spec, rules, by))
            by_schema = by_schema or _by_schema(primary, by)
        except Exception as problem:  # one dataset must not stop the others
            failed.append((name, spec.kind, str(problem).splitlines()[0]))
    by_schema = by_schema or ", ".join(f"`{c}` string" for c in by)
    errors = [Diff(results=error_result(spark, *f, by_schema)) for f in failed]
    if not diffs and not errors:
        raise ValueError("no datasets to compare")
    return union_diffs([*diffs, *errors])


def write_run(diff: Diff, path: str, mode: str = "overwrite") -> None:
    """Write every difference frame as a Parquet table under ``path``."""
    for name, df in diff.tables().items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def write_datasets(
    spark: SparkSession,
    tables: Mapping[str, tuple[DataFrame, DataFrame]],
    path: str,
    rules: CompareRules | None = None,
    specs: Mapping[str, DatasetSpec] | None = None,
    by: Sequence[str] = ("emp_id",),
) -> dict[str, str]:
    """Compare and write dataset by dataset, so that a failure while running stays with its own.

    Every dataset gets its own folders ``path/<frame>/dataset_name=<name>``; returns status per
    dataset. The next dataset starts only when the one before is written.
    """
    rules = rules or CompareRules()
    status = {}
    for name in sorted(n for n in tables if not rules.is_excluded(n)):
        spec = (specs or {}).get(name) or spec_for(name)
        try:
            diff = compare_tables(*tables[name], name, spec, rules, by, stored=True)
            for frame, df in diff.tables().items():
                df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{frame}/dataset_name={name}")
            status[name] = "ok"
        except Exception as problem:
            text = str(problem).splitlines()[0]
            status[name] = f"error: {text}"
            failed = error_result(spark, name, spec.kind, text, _by_schema(tables[name][0], by))
            failed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/results/dataset_name={name}")
    return status


def _by_schema(df: DataFrame, by: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types.get(c, 'string')}" for c in by)
