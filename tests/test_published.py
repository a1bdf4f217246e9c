"""Publications, reports under their names, and reports that are followed."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import report, reporting, rollup
from tallyframe.plans.compare import compare_tables
from tallyframe.sources import published as pub

ROWS = "emp_id int, v string"


def day(n):
    return datetime(2024, 1, n, 9, 30)


def table(spark, *rows):
    return spark.createDataFrame(rows, ROWS)


def seen(spark, path, **args):
    return sorted((r["emp_id"] if r["emp_id"] is not None else -1, r["v"]) for r in pub.published(spark, path, **args).collect())


def test_latest_per_employer_and_by_date(spark, tmp_path):
    path = str(tmp_path)
    pub.publish(table(spark, (1, "a"), (1, "a"), (2, "b"), (None, "n")), path, day(1))
    pub.publish(table(spark, (2, "c"), (3, "d")), path, day(2))
    assert seen(spark, path) == [(-1, "n"), (1, "a"), (1, "a"), (2, "c"), (3, "d")]
    assert seen(spark, path, run_date="01-01-24") == [(-1, "n"), (1, "a"), (1, "a"), (2, "b")]
    assert seen(spark, path, run_date="01-03-24") == []
    runs = {(r["emp_id"], r["run_stamp"]) for r in pub.published(spark, path, with_run=True).collect()}
    assert (2, "01-02-24 0930") in runs and (1, "01-01-24 0930") in runs
    # An older run that is published late does not replace a newer one.
    pub.publish(table(spark, (2, "old")), path, day(1))
    assert (2, "c") in seen(spark, path)


def test_nothing_half_written_is_seen(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        pub.published(spark, path)
    pub.publish(table(spark, (1, "a")), path, day(1))
    late = table(spark, (1, "x"), (2, "x")).withColumn("v", F.when(F.col("emp_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        pub.publish(late, path, day(2))
    with pytest.raises(pub.NotPublished, match="rows without emp_id"):
        pub.publish(table(spark, (1, "y"), (None, "y")), path, day(3), audits=(pub.no_null_employer(),))
    # Rows that were written, but never published.
    table(spark, (1, "z")).withColumns({"publication": F.lit("none"), "_employer": F.col("emp_id")}).write.mode("append").partitionBy(
        "publication", "_employer"
    ).parquet(f"{path}/data")
    assert seen(spark, path) == [(1, "a")]
    assert pub.manifest(spark, path).count() == 1


def test_only_published_folders_are_read(spark, tmp_path):
    path = str(tmp_path)
    pub.publish(table(spark, *[(k, "old") for k in range(8)]), path, day(1))
    pub.publish(table(spark, *[(k, "new") for k in range(8)]), path, day(2))
    plan = pub.published(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(publication" in plan
    assert {v for _, v in seen(spark, path)} == {"new"}


def test_exports_by_dataset(spark, tmp_path):
    table(spark, (1, "a"), (2, "b")).createOrReplaceTempView("export_rows")
    status = pub.export_published(
        spark, {"1-a.psv": "SELECT * FROM export_rows", "2-b.psv": "SELECT * FROM no_such_table", "3-c.psv": ""}, str(tmp_path), "p", day(1)
    )
    assert status["1-a.psv"] == "ok" and status["2-b.psv"].startswith("error") and status["3-c.psv"] == "skipped: no query"
    assert seen(spark, f"{tmp_path}/dataset=1-a.psv/target=p") == [(1, "a"), (2, "b")]


def lines_of(spark, changed):
    schema = "emp_id string, row_number string, v string"
    p = spark.createDataFrame([("150", "1", "a"), ("289", "1", "b")], schema)
    r = spark.createDataFrame([("150", "1", "a"), ("289", "1", "x" if changed else "b")], schema)
    return report.report_lines(compare_tables(p, r, "2-a.psv", by=["emp_id"]), generated_at="now")


def test_reports_by_name_and_date(spark, tmp_path):
    path = str(tmp_path / "reports")
    reporting.publish_reports(lines_of(spark, True), path, day(2))
    reporting.publish_reports(lines_of(spark, False).where("emp_id = '289'"), path, day(4))
    found = {r["emp_id"]: r["report_file"] for r in reporting.published_reports(spark, path).collect()}
    assert found == {"150": "150_01-02-24_0930_comparison_report.txt", "289": "289_01-04-24_0930_comparison_report.txt"}
    dated = reporting.report_results(reporting.published_reports(spark, path, "01-02-24"))
    assert {r["emp_id"]: r["match"] for r in dated.collect()} == {"150": True, "289": False}
    newest = rollup.executive_summary(reporting.report_results(reporting.published_reports(spark, path)))
    assert {r["emp_id"]: r["parity_status"] for r in newest.collect()} == {"150": "PERFECT", "289": "PERFECT", None: None}
    assert reporting.published_reports(spark, path, "01-09-24").collect() == []
    with pytest.raises(FileNotFoundError):
        reporting.published_reports(spark, str(tmp_path / "none"))


def test_following_reads_new_files_only(spark, tmp_path):
    files, path = tmp_path / "files", str(tmp_path / "kept")
    (files / "deep er").mkdir(parents=True)
    body = "SUMMARY:\n----\nMATCH 1-a.psv - Perfect match\n{} 2-b.psv - Values\n\nDETAILED RESULTS:\n----\n===="

    def follow():
        query = reporting.follow_reports(spark, str(files), path, f"{path}/checkpoint")
        query.awaitTermination()
        read = sum(p["numInputRows"] for p in query.recentProgress)
        rows = reporting.current_results(spark, path).collect()
        return read, {(r["emp_id"], r["dataset"]): r["match"] for r in rows}

    (files / "7_01-02-24_0930_comparison_report.txt").write_text(body.format("DIFF"))
    (files / "deep er" / "8_01-02-24_0930_comparison_report.txt").write_text(body.format("MATCH"))
    (files / "notes.txt").write_text("SUMMARY: none")
    assert follow() == (3, {("7", "1-a.psv"): True, ("7", "2-b.psv"): False, ("8", "1-a.psv"): True, ("8", "2-b.psv"): True})
    (files / "7_01-03-24_0930_comparison_report.txt").write_text(body.format("MATCH"))
    (files / "8_01-03-24_0930_comparison_report.txt").write_text("nothing was compared")
    read, rows = follow()
    assert read == 2 and rows == {("7", "1-a.psv"): True, ("7", "2-b.psv"): True}
    assert follow() == (0, rows)
