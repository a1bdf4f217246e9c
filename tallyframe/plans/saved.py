"""Comparing sides that are stored with digest trees: what is equal is not read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.numbers import exact_number, number_text
from tallyframe.functions.values import try_time
from tallyframe.operators import digests
from tallyframe.operators.tagged import quoted
from tallyframe.plans.compare import Diff, compare_prepared, compare_tables, union_diffs
from tallyframe.plans.rules import CompareRules, DatasetSpec, apply_rules, row_columns, spec_for
from tallyframe.session import cut_lineage

_TIME = "_time_of_row"


def save_side(
    df: DataFrame,
    path: str,
    dataset: str,
    spec: DatasetSpec | None = None,
    rules: CompareRules | None = None,
    by: Sequence[str] = (),
    bits: int = 8,
) -> digests.DigestTree:
    """Store one side of a dataset as its rules have it, in ranges of its key, with digests for :func:`compare_saved`.

    For datasets that are compared by key. Keys are stored in the form in which they compare.
    """
    rules, spec = rules or CompareRules(), spec or spec_for(dataset)
    if spec.mode == "groups" or not set(spec.keys) <= set(df.columns):
        raise ValueError(f"{dataset}: only datasets with a key per row are stored with digests")
    ready = apply_rules(df, dataset, rules, spec)
    cols = row_columns(ready, dataset, rules, spec)

    def key(c: str):
        if spec.key_cast:
            return number_text(exact_number(F.col(quoted(c))))
        return F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) if spec.mode == "generic" else F.col(quoted(c))

    ready = ready.withColumns({k: key(k) for k in spec.keys})
    ts = _TIME if spec.ts_col in ready.columns else None
    if ts:
        ready = ready.withColumn(_TIME, try_time(F.col(quoted(spec.ts_col))))
    return digests.save_digested(ready, path, [*by, *spec.keys], by, bits, cols, ts)


def compare_saved(
    spark: SparkSession,
    primary: str | digests.DigestTree,
    replicated: str | digests.DigestTree,
    dataset: str,
    spec: DatasetSpec | None = None,
    rules: CompareRules | None = None,
    by: Sequence[str] = (),
    stored: bool = False,
) -> Diff:
    """What :func:`compare_tables` gives for the two sides, from their digests and the rows of unequal ranges.

    Employers whose repeated keys forbid a comparison by key are compared in whole, unless they are equal.
    """
    rules, spec, by = rules or CompareRules(), spec or spec_for(dataset), list(by)
    sides = [digests.open_digested(spark, s) if isinstance(s, str) else s for s in (primary, replicated)]
    changed = digests.changed_rows(*sides)
    plain = [df.drop(_TIME) for df in (changed.primary, changed.replicated)]
    cols = sides[0].meta["cols"]
    if spec.mode != "generic":
        return compare_prepared(*plain, cols, spec, dataset, by, rules.max_samples, stored, changed.equal)
    # Groups with a repeated key on a side, among those that differ at all.
    open_ = digests.unequal_ranges(*sides)
    repeated = None
    if open_ is not None:
        levels = [s.level(s.top).where("n_repeated > 0") for s in sides]
        groups = [F.col(f"_b{i}").alias(c) for i, c in enumerate(by)]
        differing = open_.select(*groups).distinct() if by else None
        repeated = levels[0].unionByName(levels[1]).select(*groups, F.lit(True).alias("_repeated")).distinct()
        if by:
            same = F.lit(True)
            for c in by:
                same &= repeated[c].eqNullSafe(differing[c])
            repeated = repeated.join(differing, same, "left_semi")
        repeated = cut_lineage(repeated, "repeated")
    if repeated is None or repeated.isEmpty():
        return compare_prepared(*plain, cols, spec, dataset, by, rules.max_samples, stored, changed.equal)
    whole = [s.data().drop(digests.RANGE, _TIME) for s in sides]
    if not by:
        return compare_tables(*whole, dataset, spec, CompareRules(max_samples=rules.max_samples), by, stored)

    def parted(df: DataFrame, how: str) -> DataFrame:
        marked = repeated.select(*[F.col(quoted(c)).alias(f"_m{i}") for i, c in enumerate(by)])
        same = F.lit(True)
        for i, c in enumerate(by):
            same &= F.col(quoted(c)).eqNullSafe(F.col(f"_m{i}"))
        return df.join(marked, same, how)

    by_key = [parted(df, "left_anti") for df in plain]
    rest = compare_tables(*[parted(df, "left_semi") for df in whole], dataset, spec, CompareRules(max_samples=rules.max_samples), by, stored)
    keyed = compare_prepared(*by_key, cols, spec, dataset, by, rules.max_samples, stored, parted(changed.equal, "left_anti"))
    return union_diffs([keyed, rest])
