"""Files, SQL templates, exports, listings and id lists."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import delimited, ids, runs, sql


@pytest.mark.parametrize(
    "name, content, sep",
    [
        ("a.psv", "x|y\n1|2\n", "|"),
        ("b.csv", "x,y\n1,2\n", ","),
        ("c.csv", "x|y,z\n1|2\n", "|"),
        ("d.csv", "x\n1\n", ","),
        ("e.psv", "x\n1\n", "|"),
        ("f.csv", "", ","),
    ],
)
def test_detect_separator(spark, tmp_path, name, content, sep):
    path = tmp_path / name
    path.write_text(content)
    assert delimited.detect_separator(spark, str(path)) == sep


def test_read_delimited(spark, tmp_path):
    path = tmp_path / "a.psv"
    path.write_text('id|v|w\n1|NA|x\n2|"p|q"|y\n3|short\n4|a|b|c\n5||"say ""hi"""\n007| b |None\n')
    raw = delimited.read_delimited(spark, str(path))
    good = delimited.good_rows(raw, "|")
    assert good.dtypes == [("id", "string"), ("v", "string"), ("w", "string")]
    assert sorted(tuple(r) for r in good.collect()) == [
        ("007", " b ", ""), ("1", "", "x"), ("2", "p|q", "y"), ("3", "short", ""), ("5", "", 'say "hi"'),
    ]
    assert [r[0] for r in delimited.malformed_rows(raw, "|").collect()] == ["4|a|b|c"]
    assert good.select("id").count() == 5


def test_lines_in_values(spark, tmp_path):
    df = spark.createDataFrame([("1", "two\nlines"), ("2", 'a "b"|c')], "id string, v string")
    delimited.write_delimited(df, str(tmp_path / "out"))
    back = delimited.good_rows(delimited.read_delimited(spark, str(tmp_path / "out"), "|", multi_line=True), "|")
    assert sorted(map(tuple, back.collect())) == [("1", "two\nlines"), ("2", 'a "b"|c')]


def test_template(spark):
    t = sql.QueryTemplate("SELECT '{{employer_id}}' AS a, {{employer_id}} AS b, INTERVAL '{{time_interval}}' AS c")
    assert t.sql == "SELECT :employer_id AS a, :employer_id AS b, :time_interval AS c"
    row = t.run(spark, "150", 150).first()
    assert (row.a, row.b, row.c.total_seconds()) == ("150", "150", 9000)
    with pytest.raises(ValueError):
        t.run(spark, "150")
    assert t.run(spark, "150", on_missing="unbounded").first().c.days > 2000 * 365
    plain = sql.QueryTemplate("SELECT 1 AS x")
    assert plain.sql == "SELECT 1 AS x" and plain.run(spark, "150").first().x == 1
    # A value is never part of the text.
    sly = sql.QueryTemplate("SELECT {{employer_id}} AS a").run(spark, "1 UNION SELECT 2")
    assert [r.a for r in sly.collect()] == ["1 UNION SELECT 2"]


def test_one_row_of_nothing(spark):
    assert sql.one_row(spark.range(0), ["id"]).collect() == []


def test_export_isolates_failures(spark, tmp_path):
    spark.range(6).selectExpr("id % 2 AS emp_id", "id AS v").createOrReplaceTempView("numbers")
    only = spark.createDataFrame([(1,)], "emp_id bigint")
    queries = {"good": "SELECT * FROM numbers", "bad": "SELECT nothing FROM numbers", "late": "SELECT emp_id, raise_error('x') AS v FROM numbers", "none": ""}
    status = sql.export_datasets(spark, queries, str(tmp_path), "primary", employers=only, run_date="2024-01-02")
    assert status["good"] == "ok" and status["none"].startswith("skipped")
    assert status["bad"].startswith("error") and status["late"].startswith("error")
    rows = spark.read.option("basePath", str(tmp_path)).parquet(f"{tmp_path}/dataset=good")
    assert {(r.emp_id, r.v, r.target, r.dataset, str(r.run_date)) for r in rows.collect()} == {
        (1, v, "primary", "good", "2024-01-02") for v in (1, 3, 5)
    }
    as_text = sql.export_datasets(spark, {"good": queries["good"]}, str(tmp_path / "t"), "primary", fmt="delimited")
    assert as_text["good"] == "ok"
    back = delimited.read_delimited(spark, f"{tmp_path}/t/dataset=good/target=primary/*/*.csv", "|")
    assert back.count() == 6


def _tree(tmp_path):
    files = {
        "01-02-2024/150 01-02-24 0900/a/1-x.psv": 100,
        "01-02-2024/150 01-02-24 0900/b/1-x.psv": 110,
        "01-03-2024/150 01-03-24 1000/a/2-y.psv": 200,
        "01-03-2024/15 01-03-24 1000/a/2-y.psv": 300,
        "01-03-2024/15 01-03-24 1000/150_01-03-24_1000_comparison_report.txt": 400,
        "01-03-2024/15 01-03-24 1000/150_01-02-24_0900_comparison_report.txt": 500,
    }
    now = int(time.time()) - 10_000
    for name, age in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("id|v\n1|2\n")
        os.utime(path, (now + age, now + age))


def test_runs_from_files(spark, tmp_path):
    _tree(tmp_path)
    files = runs.list_files(spark, str(tmp_path))
    listed = runs.list_runs(files.where(F.col("file_name").endswith(".psv")))
    latest = {r.emp_id: r.run_id for r in runs.latest_run(listed).collect()}
    # An id is matched whole: 15 is not 150.
    assert latest == {"150": "150 01-03-24 1000", "15": "15 01-03-24 1000"}
    assert {r.emp_id: r.run_id for r in runs.latest_run(listed, "0900").collect()} == {"150": "150 01-02-24 0900"}
    sides = {r.run_id: (r.primary_target, r.replicated_target, r.problem) for r in runs.run_sides(listed).collect()}
    assert sides["150 01-02-24 0900"] == ("a", "b", None)
    assert sides["15 01-03-24 1000"] == (None, None, "too few targets")
    (newest,) = runs.find_reports(files).collect()
    assert (newest.emp_id, newest.file_name) == ("150", "150_01-02-24_0900_comparison_report.txt")
    (dated,) = runs.find_reports(files, "01-03-24").collect()
    assert dated.file_name == "150_01-03-24_1000_comparison_report.txt"
    texts = runs.read_reports(spark, f"{tmp_path}/*/*/*.txt")
    assert {(r.emp_id, r.content) for r in texts.collect()} == {("150", "id|v\n1|2\n")}


def test_pairing(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "dataset string")
    found = runs.pair_datasets(names("a", "b", "Skip.psv"), names("b", "c", "Skip.psv"), ["SKIP.PSV"]).collect()
    assert {(r.dataset, r.presence, r.is_compared) for r in found} == {
        ("a", "primary_only", False), ("b", "both", True), ("c", "replicated_only", False),
    }
    assert {r.dataset for r in runs.anti_excluded(names("a", "B"), names("A")).collect()} == {"B"}


def test_ids(spark, tmp_path):
    path = tmp_path / "ids.txt"
    path.write_text("# list\n  111 \n\n222\n# 333\n111\n444\n")
    rows = ids.read_ids(spark, str(path), explicit=["222", "999"]).orderBy("position").collect()
    assert [r.emp_id for r in rows] == ["222", "999", "111", "444"]
    (tmp_path / "empty.txt").write_text("")
    assert ids.read_ids(spark, str(tmp_path / "empty.txt")).collect() == []


def test_slot_inside_a_longer_text():
    with pytest.raises(ValueError):
        sql.QueryTemplate("SELECT * FROM t WHERE name LIKE '%{{employer_id}}%'")


def test_headers_of_one_folder_must_agree(spark, tmp_path):
    (tmp_path / "a.psv").write_text("x|y\n1|2\n")
    (tmp_path / "b.psv").write_text("x|y\n5|6\n")
    assert delimited.read_delimited(spark, str(tmp_path), "|").count() == 2
    (tmp_path / "b.psv").write_text("y|x\n4|3\n")
    with pytest.raises(Exception, match="(?i)header"):
        delimited.read_delimited(spark, str(tmp_path), "|").collect()
