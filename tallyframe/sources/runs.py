"""Which runs, sides, datasets and reports there are."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.labels import presence
from tallyframe.operators.ranking import latest_per_group
from tallyframe.session import few_listing_tasks

# Fixed pattern: name of a comparison report.
REPORT_NAME = r"^([^_]+)_.*comparison_report\.txt$"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` with name, size and modification time (contents not read)."""
    with few_listing_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("modificationTime").alias("modified_at"),
        "length",
    )


def list_runs(files: DataFrame) -> DataFrame:
    """Runs, sides and datasets from paths like ``…/{date}/{emp} {stamp}/{target}/{dataset}``."""
    parts = F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/")
    run = F.element_at(parts, -3)
    return files.select(
        F.substring_index(run, " ", 1).alias("emp_id"),
        F.element_at(parts, -4).alias("run_date"),
        run.alias("run_id"),
        F.element_at(parts, -2).alias("target"),
        F.col("file_name").alias("dataset"),
        "modified_at",
        "path",
    )


def latest_run(runs: DataFrame, stamp: str | None = None) -> DataFrame:
    """The most recently modified run of each employer (exact id), optionally of one time stamp."""
    if stamp is not None:
        runs = runs.where(F.col("run_id").contains(stamp))
    return runs.groupBy("emp_id").agg(
        F.max_by("run_id", F.struct("modified_at", "run_id")).alias("run_id"),
        F.max("modified_at").alias("modified_at"),
    )


def run_sides(runs: DataFrame) -> DataFrame:
    """Per run: the two targets to compare in name order, or why it cannot be compared."""
    targets = runs.select("emp_id", "run_id", "target").distinct()
    found = targets.groupBy("emp_id", "run_id").agg(
        F.count(F.lit(1)).alias("n_targets"), F.min("target").alias("_first"), F.max("target").alias("_last")
    )
    two = F.col("n_targets") == 2
    return found.select(
        "emp_id",
        "run_id",
        "n_targets",
        F.when(two, F.col("_first")).alias("primary_target"),
        F.when(two, F.col("_last")).alias("replicated_target"),
        F.when(F.col("n_targets") < 2, "too few targets").when(~two, "choose two targets").alias("problem"),
    )


def pair_datasets(
    primary: DataFrame, replicated: DataFrame, excluded: Iterable[str] = (), name: str = "dataset"
) -> DataFrame:
    """All dataset names with presence and whether they are compared.

    Compared: on both sides and not excluded (in any case). Excluded names stay out entirely.
    """
    tagged = primary.select(F.col(name), F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(
        replicated.select(F.col(name), F.lit(0).alias("p"), F.lit(1).alias("r"))
    )
    names = tagged.groupBy(name).agg(F.max("p").alias("p"), F.max("r").alias("r"))
    banned = [e.lower() for e in excluded]
    if banned:
        names = names.where(~F.lower(name).isin(*banned))
    return names.select(
        name,
        presence(F.col("p") == 1, F.col("r") == 1).alias("presence"),
        ((F.col("p") == 1) & (F.col("r") == 1)).alias("is_compared"),
    )


def anti_excluded(names: DataFrame, excluded: DataFrame, name: str = "dataset") -> DataFrame:
    """Names that a table of excluded names does not list, in any case."""
    banned = excluded.select(F.lower(name).alias("_key")).distinct()
    return names.withColumn("_key", F.lower(name)).join(banned, "_key", "left_anti").drop("_key")


def report_employer(file_name: Column) -> Column:
    """Employer id in front of a report's name; empty if it is no report."""
    return F.regexp_extract(file_name, REPORT_NAME, 1)


def employer_of_path(path: Column, file_name: Column) -> Column:
    """Employer of a report: in front of its name, or in the folder that ``plans.report.write_report`` makes."""
    folder = F.regexp_extract(path, "/emp_id=([^/]*)/[^/]*$", 1)
    named = report_employer(file_name)
    return F.when(named != "", named).otherwise(F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))))


def find_reports(files: DataFrame, date: str | None = None) -> DataFrame:
    """The newest report of each employer, at any depth, optionally of one date (MM-DD-YY)."""
    named = files.withColumn("emp_id", employer_of_path(F.col("path"), F.col("file_name"))).where("emp_id <> ''")
    if date is not None:
        named = named.where(F.col("file_name").contains(f"_{date}_"))
    return latest_per_group(
        named.select("emp_id", "file_name", "path", "modified_at"), ["emp_id"], ["modified_at", "file_name"]
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files as whole texts, one row each."""
    with few_listing_tasks(spark):
        files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_name").alias("report_file"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("value").alias("content"),
        employer_of_path(F.col("_metadata.file_path"), F.col("_metadata.file_name")).alias("emp_id"),
    )
