"""From reports to the executive table: published under their names, found by date, rolled up as they come in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.functions import labels
from tallyframe.operators.ranking import latest_per_group
from tallyframe.plans.report import parse_reports, report_texts, results_of_reports
from tallyframe.sources.published import PUBLICATION, manifest, publish
from tallyframe.sources.runs import report_employer
from tallyframe.streaming.gates import BATCH, batch_folder, read_batches, start_batches

# Fixed value: the end of a report's name, behind employer, date and time.
REPORT_SUFFIX = "comparison_report.txt"


def report_name(emp_id: Column, run_at: Column) -> Column:
    """Name of a report: employer, date, time, and what it is."""
    stamp = F.date_format(run_at, "MM-dd-yy_HHmm")
    return F.concat_ws("_", emp_id.cast("string"), stamp, F.lit(REPORT_SUFFIX))


def publish_reports(lines: DataFrame, path: str, run_at: datetime, emp_col: str = "emp_id") -> str:
    """Publish the reports of a run, a row per employer: its id, the report's name and text.

    Reports share files, so thousands of employers do not make thousands of them.
    """
    name = report_name(F.col(emp_col), F.lit(run_at).cast("timestamp_ntz"))
    texts = report_texts(lines, emp_col).select(F.lit(0).alias("part"), emp_col, name.alias("report_file"), "content")
    return publish(texts, path, run_at, "part", (_named,))


def _named(rows: DataFrame) -> str | None:
    return None if rows.where((F.col("content") == "") | (report_employer(F.col("report_file")) == "")).isEmpty() else "reports without a name or text"


def published_reports(spark: SparkSession, path: str, date: str | None = None, emp_col: str = "emp_id") -> DataFrame:
    """The newest report of each employer, optionally of one date (MM-DD-YY): emp_col, report_file, content, run_at.

    An employer without a report in the last publication has that of an earlier one.
    """
    every = all_reports(spark, path)
    if date is not None:
        every = every.where(F.col("report_file").contains(f"_{date}_"))
    return latest_per_group(every, [emp_col], ["run_at", "report_file"])


def all_reports(spark: SparkSession, path: str) -> DataFrame:
    """Every report of every publication."""
    known = manifest(spark, path)
    if known is None:
        raise FileNotFoundError(f"no reports are published under {path}")
    columns = known.select("columns").first()["columns"]
    runs = known.select(F.col(PUBLICATION).alias("_of"), "run_at")
    rows = spark.read.schema(columns).parquet(f"{path.rstrip('/')}/data")
    return rows.join(runs, F.col(PUBLICATION) == F.col("_of")).drop(PUBLICATION, "_of", "_employer", "part")


def report_results(reports: DataFrame, emp_col: str = "emp_id") -> DataFrame:
    """Results of reports (emp_col, report_file, content) in the shape that the roll-ups take."""
    owners = reports.select("report_file", emp_col).distinct()
    parsed = parse_reports(reports.select("report_file", "content")).join(owners, "report_file")
    return results_of_reports(parsed).withColumn("match", F.col("status") == labels.IDENTICAL)


def follow_reports(
    spark: SparkSession, files: str, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Read report files below ``files`` as they come in, and keep their results as a table below ``path``.

    A file is read once, by the batch that finds it; a restart goes on with new files. Files whose names are no report's are
    passed over. :func:`current_results` is the table's newest report of each employer.
    """
    schema = "value string"
    stream = spark.readStream.schema(schema).text(files, wholetext=True, recursiveFileLookup=True)
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    folder = F.regexp_extract(F.element_at(parts, -2), "^report=(.*)$", 1)  # files that Spark has written by name
    named = stream.select(
        F.when(folder != "", folder).otherwise(F.element_at(parts, -1)).alias("report_file"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("value").alias("content"),
    ).withColumn("emp_id", report_employer(F.col("report_file")))

    def keep(batch: DataFrame, batch_id: int) -> None:
        reports = batch.where("emp_id <> ''").persist()  # the texts are needed several times, the files are read once
        times = reports.select(F.col("report_file").alias("_file"), "modified_at")
        parsed = report_results(reports)
        rows = parsed.join(times, F.col("report_file") == F.col("_file")).drop("_file")
        # A report without a single dataset still replaces an earlier one of its employer.
        heads = reports.select("report_file", "emp_id", "modified_at", F.lit(True).alias("is_head"))
        rows.withColumn("is_head", F.lit(False)).unionByName(heads, allowMissingColumns=True).write.mode("overwrite").parquet(
            batch_folder(f"{path}/results", batch_id)
        )
        reports.unpersist()

    return start_batches(named, keep, checkpoint, trigger, "append")


def current_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of the newest report of each employer, from what :func:`follow_reports` has kept; files are not read again."""
    rows = read_batches(spark, f"{path}/results")
    if rows is None:
        raise FileNotFoundError(f"no reports are kept under {path}")
    heads = rows.where("is_head").select("emp_id", "report_file", "modified_at")
    newest = latest_per_group(heads, ["emp_id"], ["modified_at", "report_file"])
    same = newest.select(F.col("emp_id").alias("_emp"), F.col("report_file").alias("_file"), F.col("modified_at").alias("_at"))
    kept = rows.where("NOT is_head").join(
        same, (F.col("emp_id") == F.col("_emp")) & (F.col("report_file") == F.col("_file")) & (F.col("modified_at") == F.col("_at"))
    )
    return kept.drop("_emp", "_file", "_at", BATCH, "is_head")
