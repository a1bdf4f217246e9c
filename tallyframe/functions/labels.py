"""Names and classes: dataset order and kind, presence, parity status, review class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the result tables and reports.
PRIMARY_ONLY = "primary_only"
REPLICATED_ONLY = "replicated_only"
BOTH = "both"

PRIMARY_ONLY_VALUE = "primary_only_value"
REPLICATED_ONLY_VALUE = "replicated_only_value"
BOTH_DIFFER = "both_differ"

IDENTICAL = "IDENTICAL"
DIFFERENCES = "DIFFERENCES"
SKIPPED = "SKIPPED"
ERROR = "ERROR"

PERFECT = "PERFECT"
MINOR_ISSUES = "MINOR ISSUES"
NEEDS_REVIEW = "NEEDS REVIEW"
MINOR_FROM_PERCENT = 90
MANY_DIFFERENCES = 10

# Fixed values: (review priority, issue type) of a compared dataset.
CLASS_IDENTICAL = ("None", "None")
CLASS_SKIPPED = ("Check File", "File Missing")
CLASS_ROW_COUNT = ("HIGH", "Row Count Mismatch")
CLASS_MULTIPLE = ("MEDIUM", "Multiple Differences")
CLASS_MINOR = ("LOW", "Minor Differences")


def presence(in_primary: Column, in_replicated: Column) -> Column:
    """Label of the sides that hold a key."""
    return (
        F.when(in_primary & in_replicated, BOTH)
        .when(in_primary, PRIMARY_ONLY)
        .otherwise(REPLICATED_ONLY)
    )


def dataset_order(name: Column) -> list[Column]:
    """Sort keys of a dataset name: number in front (999 if none), letter after it, name."""
    lower = F.lower(name)
    number = F.regexp_extract(lower, r"^(\d+)([a-z]?)", 1)
    letter = F.regexp_extract(lower, r"^(\d+)([a-z]?)", 2)
    return [F.coalesce(number.try_cast("int"), F.lit(999)), letter, name]


def dataset_kind(name: Column) -> Column:
    """Which comparison a dataset gets; the first rule that holds wins."""
    n = F.lower(name)
    return (
        F.when(n.startswith("8") & n.contains("eligib"), "eligibility")
        .when(n.contains("5a-activities") | n.contains("activities-potential"), "activities")
        .when(n.contains("issues") & (n.contains("potentials") | n.contains("uep")), "issues")
        .otherwise("generic")
    )


def parity_status(rate: Column) -> Column:
    """Status of an employer from its success rate."""
    return (
        F.when(rate == 100, PERFECT)
        .when(rate >= MINOR_FROM_PERCENT, MINOR_ISSUES)
        .otherwise(NEEDS_REVIEW)
    )


def review_class(
    status: Column, primary_only: Column, replicated_only: Column, differences: Column, part: int
) -> Column:
    """Review priority (``part=0``) or issue type (``part=1``) of one compared dataset."""
    return (
        F.when(status == IDENTICAL, CLASS_IDENTICAL[part])
        .when(status == SKIPPED, CLASS_SKIPPED[part])
        .when((primary_only > 0) | (replicated_only > 0), CLASS_ROW_COUNT[part])
        .when(differences > MANY_DIFFERENCES, CLASS_MULTIPLE[part])
        .otherwise(CLASS_MINOR[part])
    )


def review_priority(status, primary_only, replicated_only, differences) -> Column:
    return review_class(status, primary_only, replicated_only, differences, 0)


def issue_type(status, primary_only, replicated_only, differences) -> Column:
    return review_class(status, primary_only, replicated_only, differences, 1)


def severity(priority: Column) -> Column:
    """Sort key of a review priority, most urgent first."""
    return (
        F.when(priority == CLASS_ROW_COUNT[0], 1)
        .when(priority == CLASS_MULTIPLE[0], 2)
        .when(priority == CLASS_MINOR[0], 3)
        .otherwise(4)
    )
