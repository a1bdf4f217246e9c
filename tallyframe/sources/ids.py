"""Employer-id lists and target names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Target names a user may give, and the name each stands for.
TARGET_ALIASES = {
    "primary-dev": "primary-dev",
    "primary-qa": "primary-qa",
    "replicated-dev": "replicated-dev",
    "replicated-qa": "replicated-qa",
    "prod": "prod",
    "production": "prod",
    "pri": "primary-qa",
    "rep": "replicated-qa",
}
DEPRECATED_ALIASES = ("pri", "rep")


def id_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Ids of a list file: trimmed lines without blank ones and ``#`` comments."""
    trimmed = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    return lines.withColumn("emp_id", trimmed).where(
        (F.col("emp_id") != "") & ~F.col("emp_id").startswith("#")
    )


def read_ids(spark: SparkSession, path: str, explicit: Iterable[str] = ()) -> DataFrame:
    """Explicit ids followed by those of the list file, each once, at its first position."""
    given = [(e, i) for i, e in enumerate(explicit)]
    listed = id_lines(spark.read.text(path)).select(
        "emp_id", (F.monotonically_increasing_id() + len(given)).alias("position")
    )
    if given:
        listed = spark.createDataFrame(given, "emp_id string, position bigint").unionByName(listed)
    return listed.groupBy("emp_id").agg(F.min("position").alias("position"))


def resolve_target(
    target: Column,
    aliases: Mapping[str, str] = TARGET_ALIASES,
    deprecated: Iterable[str] = DEPRECATED_ALIASES,
) -> list[Column]:
    """Target name, deprecated flag and error text of user input (case and blanks ignored)."""
    key = F.lower(F.trim(target))
    name = F.lit(None).cast("string")
    for canonical in dict.fromkeys(aliases.values()):
        known = [a for a, c in aliases.items() if c == canonical]
        name = F.when(key.isin(*known), canonical).otherwise(name)
    valid = ", ".join(sorted(a for a in aliases if a not in set(deprecated)))
    return [
        name.alias("target"),
        F.coalesce(key.isin(*deprecated), F.lit(False)).alias("is_deprecated"),
        F.when(
            F.coalesce(~key.isin(*aliases), F.lit(True)),
            F.concat(F.lit("unknown target '"), F.coalesce(target, F.lit("")), F.lit(f"'; valid: {valid}")),
        ).alias("error"),
    ]
