"""Comparison rules (ignored, excluded and normalised columns) and dataset specifications."""

from __future__ import annotations

import configparser
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.text import json_flag, normalize_text, normalize_without_none
from tallyframe.operators.schema import drop_ignored
from tallyframe.sources.delimited import canonical

# Sections and settings of a rules file.
SECTIONS = {
    "ignore": "file_specific_ignore_columns",
    "normalize": "normalize_columns",
    "normalize_none": "normalize_none_string_columns",
}
GLOBAL_IGNORE_SECTION = "global_ignore_columns"
EXCLUDE_SECTION = "exclude_files"
SETTINGS_SECTION = "comparison_settings"
DEFAULT_MAX_SAMPLES = 5


@dataclass(frozen=True)
class CompareRules:
    """Per-dataset rules; dataset and column names match in any case."""

    global_ignore: tuple[str, ...] = ()
    ignore: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    normalize: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    normalize_none: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    excluded: tuple[str, ...] = ()
    max_samples: int = DEFAULT_MAX_SAMPLES
    fold_case: bool = False

    @classmethod
    def from_ini(cls, text: str) -> CompareRules:
        """Rules from the text of an INI file; missing sections mean no rules."""
        ini = configparser.ConfigParser()
        ini.read_string(text)

        def switched_on(section: str) -> tuple[str, ...]:
            if not ini.has_section(section):
                return ()
            return tuple(k for k, v in ini.items(section) if v.strip().lower() == "true")

        def lists(section: str) -> dict[str, tuple[str, ...]]:
            if not ini.has_section(section):
                return {}
            return {k: tuple(p.strip() for p in v.split(",") if p.strip()) for k, v in ini.items(section)}

        return cls(
            global_ignore=switched_on(GLOBAL_IGNORE_SECTION),
            excluded=switched_on(EXCLUDE_SECTION),
            max_samples=ini.getint(SETTINGS_SECTION, "max_sample_differences", fallback=DEFAULT_MAX_SAMPLES),
            **{name: lists(section) for name, section in SECTIONS.items()},
        )

    @classmethod
    def from_frame(cls, rules: DataFrame, **settings) -> CompareRules:
        """Rules from a small table ``(dataset, rule, column)``; dataset null means all."""
        found: dict[str, dict[str, tuple[str, ...]]] = {name: {} for name in SECTIONS}
        everywhere: list[str] = []
        excluded: list[str] = []
        for row in rules.select("dataset", "rule", "column").collect():  # configuration, not data
            if row["rule"] == "exclude":
                excluded.append(row["dataset"].lower())
            elif row["dataset"] is None:
                everywhere.append(row["column"])
            else:
                name = row["dataset"].lower()
                found[row["rule"]][name] = (*found[row["rule"]].get(name, ()), row["column"])
        return cls(global_ignore=tuple(everywhere), excluded=tuple(excluded), **found, **settings)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The rules as a table ``(dataset, rule, column)``."""
        rows = [(None, "ignore", c) for c in self.global_ignore]
        rows += [(d, "exclude", None) for d in self.excluded]
        for name in SECTIONS:
            rows += [(d, name, c) for d, cols in getattr(self, name).items() for c in cols]
        return spark.createDataFrame(rows, "dataset string, rule string, column string")

    def ignored(self, dataset: str) -> list[str]:
        return [*self.global_ignore, *self.ignore.get(dataset.lower(), ())]

    def is_excluded(self, dataset: str) -> bool:
        return dataset.lower() in {e.lower() for e in self.excluded}


@dataclass(frozen=True)
class GroupRules:
    """Settings of a grouped set comparison."""

    item: str
    flag: Callable[[], Column] | None = None
    expected: tuple[str, ...] = ()
    expected_if_flagged: tuple[str, ...] = ()
    optional_unless_flagged: tuple[str, ...] = ()
    info_cols: tuple[str, ...] = ()
    always_check_expected: bool = False


@dataclass(frozen=True)
class DatasetSpec:
    """How one kind of dataset is compared.

    ``mode``: ``generic`` (keyed if the key is unique on both sides, else whole rows), ``keyed``
    (first row per key, normalised cells) or ``groups`` (sets of items per group).
    ``full_row`` for whole rows: ``auto`` (positional for equal row counts, else distinct rows),
    ``positional``, ``distinct``, ``multiset`` or ``aligned`` (positions between the rows that both sides hold). ``listed_keys``: how many one-sided keys are listed in the order of their
    numbers; ``all`` for every key of digits alone, None for no list.
    """

    kind: str
    mode: str
    keys: tuple[str, ...]
    key_cast: str | None = None
    protected: tuple[str, ...] = ()
    compare_exclude: tuple[str, ...] = ()
    normalize: Callable[[Column], Column] | None = None
    ts_col: str | None = None
    record_noun: str = "Records"
    matching_noun: str = "records"
    groups: GroupRules | None = None
    full_row: str = "auto"
    null_is_empty: bool = False
    dedup: str = "first"
    listed_keys: int | str | None = None

    def with_(self, **changes) -> DatasetSpec:
        return replace(self, **changes)


# The kinds of datasets and their columns, actions and nouns.
GENERIC = DatasetSpec("generic", "generic", keys=("row_number",), protected=("row_number",))
ISSUES = DatasetSpec(
    "issues",
    "keyed",
    keys=("row_number",),
    protected=("row_number",),
    compare_exclude=("created_at", "updated_at", "issue_id", "assignable_id", "potentials_id", "row_number"),
    normalize=normalize_text,
    record_noun="Row_numbers",
    matching_noun="row_numbers",
    listed_keys="all",
)
ELIGIBILITY = DatasetSpec(
    "eligibility",
    "keyed",
    keys=("id",),
    key_cast="number",
    protected=("id", "row_number"),
    compare_exclude=("created_at", "updated_at", "deposited_file_id", "potentials_id", "row_number"),
    normalize=normalize_text,
    ts_col="created_at",
    listed_keys=20,
)
ACTIVITIES = DatasetSpec(
    "activities",
    "groups",
    keys=("row_number",),
    protected=("row_number", "object_changes"),
    groups=GroupRules(
        item="action",
        flag=lambda: json_flag(F.col("object_changes"), "is_dependent"),
        expected=("execute_potential_resolution", "execute_employer_setting"),
        expected_if_flagged=("execute_dependent_setting",),
        optional_unless_flagged=("execute_dependent_setting",),
        info_cols=("first_name", "last_name", "born_on", "row_number"),
    ),
)


def spec_for(dataset: str) -> DatasetSpec:
    """Specification of a dataset by its name; the first rule that holds wins."""
    n = dataset.lower()
    if n.startswith("8") and "eligib" in n:
        return ELIGIBILITY
    if "5a-activities" in n or "activities-potential" in n:
        return ACTIVITIES
    if "issues" in n and ("potentials" in n or "uep" in n):
        return ISSUES
    return GENERIC


def apply_rules(df: DataFrame, dataset: str, rules: CompareRules, spec: DatasetSpec) -> DataFrame:
    """Canonical text, ignored columns dropped, configured columns normalised.

    The time column of ``spec`` stays even if ignored; :func:`row_columns` leaves it out again.
    """
    keep = [*spec.protected, *([spec.ts_col] if spec.ts_col else [])]
    df = canonical(drop_ignored(df, rules.ignored(dataset), keep))
    plain = {c.lower() for c in rules.normalize.get(dataset.lower(), ())}
    without_none = {c.lower() for c in rules.normalize_none.get(dataset.lower(), ())}

    def value(c: str) -> Column:
        col = F.col(f"`{c}`")
        if c.lower() in plain:
            col = normalize_text(col)
        if c.lower() in without_none:
            col = normalize_without_none(col)
        elif rules.fold_case and isinstance(df.schema[c].dataType, T.StringType):
            col = F.lower(col)
        return col.alias(c)

    return df.select(*[value(c) for c in df.columns])


def row_columns(df: DataFrame, dataset: str, rules: CompareRules, spec: DatasetSpec) -> list[str]:
    """Columns that count for row equality: all but an ignored time column."""
    ignored = {c.lower() for c in rules.ignored(dataset)} - {c.lower() for c in spec.protected}
    return [c for c in df.columns if c.lower() not in ignored]
