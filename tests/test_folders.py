"""From storage to results: run folders, exports, and the whole way behind the gates."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from tallyframe.plans import report, rollup
from tallyframe.plans.folders import compare_exports, compare_folders, differing_employers, run_files
from tallyframe.plans.rules import CompareRules
from tallyframe.sources import runs
from tallyframe.sources.sql import export_datasets
from tallyframe.streaming import gates


def lay_out(base, files):
    for name, content in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)


def test_run_folders(spark, tmp_path):
    head, late = "01-02-2024/{} 01-02-24 0930/{}/", "01-03-2024/{} 01-03-24 0930/{}/"
    lay_out(
        tmp_path,
        {
            head.format("150", "a") + "1-x.psv": "row_number|v\n1|old\n",
            late.format("150", "a") + "1-x.psv": "row_number|v\n1|NA\n2|p\n",
            late.format("150", "b") + "1-x.psv": "row_number,v\n1,\n2,q\n",
            late.format("150", "a") + "2-y.csv": "v\nu\nu\n",
            late.format("150", "b") + "2-y.csv": "v\nu\nu\n",
            late.format("150", "a") + "skip.psv": "v\n1\n",
            late.format("150", "b") + "skip.psv": "v\n2\n",
            late.format("150", "a") + "only.psv": "v\n1\n",
            late.format("289", "a") + "1-x.psv": "row_number|v\n1|a\n",
            late.format("289", "b") + "1-x.psv": "row_number|v\n1|a\n",
            late.format("300", "a") + "1-x.psv": "row_number|v\n1|a\n1|a|b|c\n",
            late.format("300", "b") + "1-x.psv": "row_number|v\n1|a\n",
            late.format("400", "a") + "1-x.psv": "row_number|v\n1|a\n",
        },
    )
    rules = CompareRules(excluded=("SKIP.psv",))
    diff = compare_folders(spark, str(tmp_path), rules)
    got = {(r.emp_id, r.dataset): (r.status, r.summary) for r in diff.results.collect()}
    assert got == {
        ("150", "1-x.psv"): ("DIFFERENCES", "Matching records with data differences: 1"),
        ("150", "2-y.csv"): ("IDENTICAL", "Perfect match"),
        ("289", "1-x.psv"): ("IDENTICAL", "Perfect match"),
        ("300", "1-x.psv"): ("ERROR", "Error: rows with more fields than the header"),
    }
    assert [(r.emp_id, r.key, r.primary_value, r.replicated_value) for r in diff.cell_diffs.collect()] == [("150", "2", "p", "q")]
    assert {r.emp_id: (r.n_different, r.n_failed) for r in differing_employers(diff).collect()} == {
        "150": (1, 0), "289": (0, 0), "300": (1, 1),
    }
    _, problems = run_files(spark, str(tmp_path))
    assert [(r.emp_id, r.problem) for r in problems.collect()] == [("400", "too few targets")]

    lines = report.report_lines(diff)
    report.write_report(lines, str(tmp_path / "reports"))
    assert {r.emp_id: r.success for r in rollup.run_status(diff.results).collect()} == {"150": True, "289": True, "300": False}

    one = spark.createDataFrame([("289",)], "emp_id string")
    some = compare_folders(spark, str(tmp_path), rules, employers=one, sides=("b", "a"))
    assert [(r.emp_id, r.status) for r in some.results.collect()] == [("289", "IDENTICAL")]


def test_many_reports_are_written_and_listed_in_parallel(spark, tmp_path):
    path, context = str(tmp_path / "reports"), spark.sparkContext
    lines = spark.range(600).selectExpr("CAST(id % 200 AS STRING) AS emp_id", "id AS line_no", "'line ' || id AS text")
    report.write_report(lines, path)
    files = list((tmp_path / "reports").glob("emp_id=*/part-*.txt"))
    assert len(files) == 200
    assert {f.read_text() for f in files} == {f"line {k}\nline {k + 200}\nline {k + 400}\n" for k in range(200)}
    assert len({f.name.split("-")[1] for f in files}) == 8  # a task each for all partitions, however small they are
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    context.setJobGroup("listing", "listing")
    try:
        read = runs.read_reports(spark, path)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert sum(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * context.defaultParallelism
    assert read.count() == 200
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_gates_to_results(spark, tmp_path):
    """Status stream, release, export of both targets, comparison, report."""
    out, status = str(tmp_path / "out"), str(tmp_path / "status")
    rows = [(e, str(k), f"v{k}") for e in ("007", "289") for k in range(4)]
    users = spark.createDataFrame(rows, "emp_id string, row_number string, v string")
    users.createOrReplaceTempView("left_users")
    users.withColumn("v", F.expr("CASE WHEN emp_id = '007' AND row_number = '3' THEN 'w' ELSE v END")).createOrReplaceTempView("right_users")
    done = []

    def compare(ready, batch_id):
        employers = ready.select(F.col("run_id").alias("emp_id"))
        for target, view in (("primary", "left_users"), ("replicated", "right_users")):
            export_datasets(spark, {"11-users": f"SELECT * FROM {view}"}, out, target, employers=employers)
        diff = compare_exports(spark, out, ["11-users"], ("primary", "replicated"), employers=employers)
        done.extend((r.emp_id, r.status, r.n_records_with_diffs) for r in diff.results.collect())

    state = "run_id string, source string, ts timestamp, done boolean"
    when = dt(2024, 1, 1)
    spark.createDataFrame(
        [("007", "queues", when, True), ("007", "states", when, True), ("289", "queues", when, True)], state
    ).write.parquet(f"{status}/1")
    stream = spark.readStream.schema(state).option("recursiveFileLookup", True).parquet(status)
    gates.release_stream(stream, ["queues", "states"], compare, f"{out}/gate", f"{out}/ck").awaitTermination()
    assert done == [("007", "DIFFERENCES", 1)]
