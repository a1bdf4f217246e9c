"""Runs whose datasets are computed apart."""

import pytest
from pyspark.sql import functions as F

from tallyframe.plans.batch import Run, reason, run_isolated
from tallyframe.plans.compare import compare_run
from tallyframe.plans.rules import CompareRules


def side(spark, rows):
    return spark.createDataFrame(rows, "emp_id int, row_number string, v string")


@pytest.fixture(scope="module")
def good(spark):
    p = side(spark, [(1, "1", "a"), (2, "1", "b"), (2, "2", "c")])
    r = side(spark, [(1, "1", "a"), (2, "1", "x"), (2, "3", "c")])
    return p, r


def failing(pair, message="bad row"):
    return pair[0].withColumn("v", F.when(F.col("emp_id") == 2, F.raise_error(F.lit(message))).otherwise(F.col("v"))), pair[1]


def statuses(frame):
    return sorted({(r["dataset"], r["status"]) for r in frame.collect()})


def test_failures_stay_with_their_dataset(spark, good, tmp_path):
    def unread():
        raise OSError("no such share\nand more")

    tables = {"1-good.psv": good, "2-late.psv": failing(good), "3-unread.psv": unread, "4-good.psv": good}
    run = run_isolated(spark, tables, str(tmp_path / "run"), together=3)
    results = run.frame("results")
    assert statuses(results) == [
        ("1-good.psv", "DIFFERENCES"), ("1-good.psv", "IDENTICAL"), ("2-late.psv", "ERROR"), ("3-unread.psv", "ERROR"),
        ("4-good.psv", "DIFFERENCES"), ("4-good.psv", "IDENTICAL"),
    ]
    errors = {r["dataset"]: (r["emp_id"], r["error"]) for r in results.collect() if r["status"] == "ERROR"}
    assert errors["3-unread.psv"] == (None, "no such share") and "bad row" in errors["2-late.psv"][1]
    assert {r["dataset"] for r in run.frame("cell_diffs").collect()} == {"1-good.psv", "4-good.psv"}
    assert run.frame("set_diffs") is None
    # What another process reads by the path alone is the same.
    assert statuses(Run(spark, str(tmp_path / "run")).diff().results) == statuses(results)


def test_a_later_attempt_replaces_an_earlier_one(spark, good, tmp_path):
    path = str(tmp_path / "run")
    run_isolated(spark, {"1-a.psv": good, "2-b.psv": failing(good)}, path)
    first = {r["dataset"]: r["attempt"] for r in Run(spark, path).datasets().collect()}
    run = run_isolated(spark, {"1-a.psv": good, "2-b.psv": good}, path, resume=True)
    second = {r["dataset"]: r["attempt"] for r in run.datasets().collect()}
    assert first["1-a.psv"] == second["1-a.psv"] and first["2-b.psv"] != second["2-b.psv"]
    assert {s for _, s in statuses(run.frame("results"))} == {"DIFFERENCES", "IDENTICAL"}
    assert run.attempts().count() == 3


def test_what_was_never_committed_is_not_read(spark, good, tmp_path):
    path = str(tmp_path / "run")
    run = run_isolated(spark, {"1-a.psv": good}, path)
    run.frame("results").withColumn("dataset", F.lit("9-lost.psv")).write.parquet(f"{path}/data/lost/results")
    assert {d for d, _ in statuses(run.frame("results"))} == {"1-a.psv"}


def test_a_slow_dataset_is_cancelled(spark, good, tmp_path):
    spark.udf.register("wait_long", lambda v: __import__("time").sleep(30) or v)
    slow = good[0].withColumn("v", F.expr("wait_long(v)")), good[1]
    run = run_isolated(spark, {"1-a.psv": slow, "2-b.psv": good}, str(tmp_path / "run"), timeout_s=12)
    found = {r["dataset"]: (r["status"], r["error"]) for r in run.datasets().collect()}
    assert found == {"1-a.psv": ("error", "not done within 12 s"), "2-b.psv": ("ok", None)}


def test_only_failures_and_nothing(spark, good, tmp_path):
    run = run_isolated(spark, {"1-a.psv": failing(good)}, str(tmp_path / "run"), rules=CompareRules(excluded=("2-b.psv",)))
    assert statuses(run.diff().results) == [("1-a.psv", "ERROR")]
    nothing = run_isolated(spark, {"2-b.psv": good}, str(tmp_path / "other"), rules=CompareRules(excluded=("2-b.psv",)))
    assert nothing.frame("results") is None and nothing.datasets().collect() == []


def test_stored_run_survives_a_late_failure(spark, good):
    diff = compare_run(spark, {"1-a.psv": good, "2-b.psv": failing(good)}, stored=True)
    assert statuses(diff.results) == [("1-a.psv", "DIFFERENCES"), ("1-a.psv", "IDENTICAL"), ("2-b.psv", "ERROR")]


def test_reason_without_a_message():
    assert reason(ValueError()) == "ValueError" and reason(ValueError("\n a \n b")) == "a"
