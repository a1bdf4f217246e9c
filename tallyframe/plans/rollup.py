"""Roll-ups of comparison results over many employers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import labels
from tallyframe.functions.values import percent


def executive_summary(results: DataFrame, emp_col: str = "emp_id") -> DataFrame:
    """Datasets compared, identical and differing per employer, plus one row for all.

    ``is_total`` marks the overall row, whose rate is null if nothing was compared.
    """
    rolled = results.rollup(emp_col).agg(
        F.grouping(emp_col).alias("_g"),
        F.count("dataset").alias("files_compared"),
        F.count_if(F.col("status") == labels.IDENTICAL).alias("identical"),
        F.count_if(F.col("status") != labels.IDENTICAL).alias("differences"),
    )
    rate = percent(F.col("identical"), F.col("files_compared"))
    is_total = F.col("_g") == 1
    return rolled.select(
        emp_col,
        is_total.alias("is_total"),
        "files_compared",
        "identical",
        "differences",
        F.when(is_total, rate).otherwise(F.coalesce(rate, F.lit(0.0))).alias("success_rate"),
        F.when(~is_total, labels.parity_status(100.0 * F.col("identical") / F.col("files_compared"))).alias(
            "parity_status"
        ),
    )


def overall_statistics(results: DataFrame, emp_col: str = "emp_id") -> DataFrame:
    """One row: employers tested, datasets compared, identical, differing, success rate."""
    per_employer = results.groupBy(emp_col).agg(
        F.count("dataset").alias("n"), F.count_if(F.col("status") == labels.IDENTICAL).alias("same")
    )
    return per_employer.agg(
        F.count(F.lit(1)).alias("employers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("files_compared"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("identical"),
        F.coalesce(F.sum(F.col("n") - F.col("same")), F.lit(0)).alias("differences"),
    ).withColumn("success_rate", percent(F.col("identical"), F.col("files_compared")))


def detailed_analysis(results: DataFrame, emp_col: str = "emp_id") -> DataFrame:
    """Review priority and issue type of every employer and dataset."""
    counts = (F.col("n_primary_only"), F.col("n_replicated_only"), F.col("difference_count"))
    return results.select(
        labels.review_priority(F.col("status"), *counts).alias("review_priority"),
        emp_col,
        "dataset",
        "status",
        labels.issue_type(F.col("status"), *counts).alias("issue_type"),
        "difference_count",
        F.col("n_records_with_diffs").alias("row_differences"),
        "n_primary_only",
        "n_replicated_only",
        F.coalesce(F.when(F.col("status") != labels.IDENTICAL, F.col("summary")), F.lit("")).alias("notes"),
        F.lit("").alias("review_comments"),
    )


def issues_for_review(results: DataFrame, emp_col: str = "emp_id") -> DataFrame:
    """Only what differs, with a severity to sort by (1 is most urgent)."""
    detail = detailed_analysis(results, emp_col)
    return detail.where(F.col("status") != labels.IDENTICAL).withColumn(
        "severity", labels.severity(F.col("review_priority"))
    )


def run_status(results: DataFrame, emp_col: str = "emp_id") -> DataFrame:
    """Outcome of a run per employer: it succeeds unless a dataset failed; differences are no failure."""
    return results.groupBy(emp_col).agg(
        (F.count_if(F.col("status") == labels.ERROR) == 0).alias("success"),
        F.count("dataset").alias("n_datasets"),
        F.count_if(~F.col("match")).alias("n_different"),
        F.min(F.when(F.col("status") == labels.ERROR, F.col("summary"))).alias("message"),
    )


def batch_outcome(status: DataFrame) -> DataFrame:
    """Totals of a batch from rows ``(…, success)``: all, successful, failed."""
    return status.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )
