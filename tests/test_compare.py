"""Whole comparisons, rules, runs, reports and roll-ups."""

import pytest

from tallyframe.plans import report, rollup
from tallyframe.plans.compare import compare_run, compare_tables, write_datasets
from tallyframe.plans.rules import GENERIC, CompareRules, spec_for

INI = """
[global_ignore_columns]
updated_at = true
created_at = true
id = true
kept = false
[file_specific_ignore_columns]
A-Data.psv = extra, Other
[exclude_files]
skip.PSV = true
[normalize_columns]
9-issues-potentials.psv = description
[normalize_none_string_columns]
12-docs.psv = content
[comparison_settings]
max_sample_differences = 7
"""


def table(spark, rows, *cols):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def only(diff):
    (row,) = diff.results.collect()
    return row


def test_rules_file(spark):
    rules = CompareRules.from_ini(INI)
    assert rules.global_ignore == ("updated_at", "created_at", "id")
    assert set(rules.ignored("a-data.PSV")) == {"updated_at", "created_at", "id", "extra", "Other"}
    assert rules.is_excluded("SKIP.psv") and not rules.is_excluded("other.psv")
    assert rules.max_samples == 7
    again = CompareRules.from_frame(rules.to_frame(spark), max_samples=7)
    assert again == rules
    assert CompareRules.from_ini("") == CompareRules()


@pytest.mark.parametrize(
    "name, kind",
    [
        ("8b-eligibilities.psv", "eligibility"),
        ("8B-ELIGIBILITIES.psv", "eligibility"),
        ("18b-eligibilities.psv", "generic"),
        ("5a-activities-potential.psv", "activities"),
        ("9-issues-potentials.psv", "issues"),
        ("10-issues-ueps.psv", "issues"),
        ("6-activities-issues.psv", "generic"),
        ("15-potentials.psv", "generic"),
    ],
)
def test_dispatch(name, kind):
    assert spec_for(name).kind == kind


def test_identical_tables(spark):
    a = table(spark, [("1", "x"), ("2", None)], "row_number", "v")
    row = only(compare_tables(a, table(spark, [("2", ""), ("1", "x")], "row_number", "v"), "1-a.psv"))
    assert row.match and row.equivalent and row.summary == "Perfect match" and row.status == "IDENTICAL"


def test_generic_by_key(spark):
    a = table(spark, [("1", "x", "active"), ("2", "y", "active"), ("3", "z", "")], "row_number", "n", "status")
    b = table(spark, [("1", "x", "active"), ("2", "y", "inactive"), ("4", "z", "")], "row_number", "n", "status")
    diff = compare_tables(a, b, "1-a.psv")
    row = only(diff)
    assert row.summary == (
        "Records in primary but NOT in replicated: 1; Records in replicated but NOT in primary: 1; "
        "Matching records with data differences: 1"
    )
    assert row.difference_count == 3
    assert [(r["column"], r.n_records, r.n_both_differ) for r in diff.column_diffs.collect()] == [("status", 1, 1)]
    assert {(r.key, r.presence) for r in diff.key_presence.collect()} == {("3", "primary_only"), ("4", "replicated_only")}
    assert [(r.key, r.primary_value, r.replicated_value) for r in diff.cell_diffs.collect()] == [("2", "active", "inactive")]


def test_generic_whole_rows(spark):
    a = table(spark, [(c,) for c in "abcd"], "v")
    b = table(spark, [(c,) for c in "bcde"], "v")
    assert only(compare_tables(a, b, "x")).summary == "Rows with data differences: 4"
    multiset = only(compare_tables(a, b, "x", GENERIC.with_(full_row="multiset")))
    assert (multiset.n_primary_only, multiset.n_replicated_only) == (1, 1)
    shorter = only(compare_tables(table(spark, [("a",), ("a",), ("b",)], "v"), table(spark, [("a",), ("c",)], "v"), "x"))
    assert shorter.summary == (
        "Row count: Primary=3, Replicated=2; Records in primary but NOT in replicated: 1; "
        "Records in replicated but NOT in primary: 1; Matching records with data differences: 1"
    )


def test_repeated_row_numbers_compare_by_rows(spark):
    a = table(spark, [("1", "x"), ("1", "y")], "row_number", "v")
    b = table(spark, [("1", "x"), ("1", "z")], "row_number", "v")
    assert only(compare_tables(a, b, "x")).summary == "Rows with data differences: 1"


def test_each_employer_picks_its_own_mode(spark):
    cols = ("emp_id", "row_number", "v")
    a = table(spark, [("e1", "1", "x"), ("e2", "1", "x"), ("e2", "1", "y")], *cols)
    b = table(spark, [("e1", "1", "w"), ("e2", "1", "x"), ("e2", "1", "z")], *cols)
    got = {r.emp_id: r.summary for r in compare_tables(a, b, "x", by=["emp_id"]).results.collect()}
    assert got == {"e1": "Matching records with data differences: 1", "e2": "Rows with data differences: 1"}


def test_schema_difference_skips_rows(spark):
    a, b = table(spark, [("1", "x")], "row_number", "v"), table(spark, [("1", "x")], "row_number", "w")
    row = only(compare_tables(a, b, "x"))
    assert row.summary == "Columns only in primary: v; Columns only in replicated: w" and not row.match


def test_column_order_alone(spark):
    a, b = table(spark, [("1", "x")], "row_number", "v"), table(spark, [("x", "1")], "v", "row_number")
    row = only(compare_tables(a, b, "x"))
    assert not row.match and row.equivalent and row.summary == "Match"


def test_empty_side(spark):
    a, b = table(spark, [("1", "x")], "row_number", "v"), table(spark, [], "row_number", "v")
    assert only(compare_tables(a, b, "x")).summary == "Row count: Primary=1, Replicated=0"
    assert only(compare_tables(b, b, "x")).match


def test_issues(spark):
    cols = ("row_number", "description", "issue_id")
    a = table(spark, [("1", "Hello_World", "7"), ("2", "b", "8"), ("2", "a", "9"), ("x", "q", "1")], *cols)
    b = table(spark, [("1", "hello world", "70"), ("2", "a", "80"), ("3", "c", "5")], *cols)
    diff = compare_tables(a, b, "9-issues-potentials.psv")
    row = only(diff)
    assert row.summary == (
        "Row count: Primary=4, Replicated=3; Row_numbers in primary but NOT in replicated: 1; "
        "Row_numbers in replicated but NOT in primary: 1"
    )
    assert row.n_duplicate_keys == 1 and row.n_records_with_diffs == 0


def test_differences_that_vanish_are_equivalent(spark):
    a = table(spark, [("1", "Hello_World")], "row_number", "description")
    b = table(spark, [("1", "hello world")], "row_number", "description")
    row = only(compare_tables(a, b, "9-issues-potentials.psv"))
    assert not row.match and row.equivalent and row.summary == "Match"


def test_eligibility(spark):
    cols = ("id", "state", "created_at")
    a = table(spark, [("1", "A", "2024-01-02"), ("02", "b", "2024-01-03"), ("n/x", "c", "2024-01-04")], *cols)
    b = table(spark, [("1.0", "a", "2024-01-02"), ("2", "B ", "2024-01-03"), ("9", "z", "2020-01-01")], *cols)
    diff = compare_tables(a, b, "8b-eligibilities.psv", rules=CompareRules(global_ignore=("id", "created_at")))
    row = only(diff)
    assert row.has_old_data and row.n_replicated_only == 1 and row.n_primary_only == 0
    assert row.n_records_with_diffs == 0
    assert "OLD DATA" in row.summary
    assert [r.key for r in diff.key_presence.collect()] == ["9"]


def test_activities(spark):
    cols = ("row_number", "action", "object_changes", "first_name")
    r, e, d = "execute_potential_resolution", "execute_employer_setting", "execute_dependent_setting"
    dependent = '{"is_dependent": true}'
    a = table(spark, [("1", r, "", "Ann"), ("1", e, "", "Ann"), ("2", r, dependent, "Bob"), ("2", e, dependent, "Bob"), ("2", d, dependent, "Bob")], *cols)
    b = table(spark, [("1", r, "", "Ann"), ("1", e, "", "Ann"), ("2", r, dependent, "Bob"), ("2", e, dependent, "Bob"), ("2", "other", dependent, "Bo")], *cols)
    diff = compare_tables(a, b, "5a-activities-potential.psv", rules=CompareRules(global_ignore=("object_changes",)))
    assert only(diff).summary == (
        "Missing actions in replicated: 1; Unexpected actions in replicated: 1; Row numbers with action mismatches: 1"
    )
    assert {(s.group_key, s["item"], s.kind, s.is_flagged, s.info["first_name"]) for s in diff.set_diffs.collect()} == {
        ("2", d, "missing", True, "Bob"), ("2", "other", "unexpected", True, "Bob"),
    }


def _run(spark):
    cols = ("emp_id", "row_number", "v")
    same = table(spark, [("150", "1", "x"), ("289", "1", "x")], *cols)
    other = table(spark, [("150", "1", "x"), ("289", "1", "y")], *cols)
    no_action = table(spark, [("150", "1")], "emp_id", "row_number")
    return {
        "10-b.psv": (same, same),
        "2-a.psv": (same, other),
        "5a-activities-potential.psv": (no_action, no_action),
        "skip.psv": (same, other),
    }


def test_run_goes_on_after_an_error(spark):
    diff = compare_run(spark, _run(spark), CompareRules(excluded=("SKIP.psv",)))
    rows = {(r.emp_id, r.dataset): r for r in diff.results.collect()}
    assert set(rows) == {("150", "10-b.psv"), ("289", "10-b.psv"), ("150", "2-a.psv"), ("289", "2-a.psv"), (None, "5a-activities-potential.psv")}
    assert rows["289", "2-a.psv"].status == "DIFFERENCES"
    assert rows[None, "5a-activities-potential.psv"].status == "ERROR"
    assert "no column action" in rows[None, "5a-activities-potential.psv"].summary


def test_run_written_by_dataset(spark, tmp_path):
    tables = {k: v for k, v in _run(spark).items() if k in ("10-b.psv", "2-a.psv")}
    late = tables["2-a.psv"][0].selectExpr("emp_id", "row_number", "raise_error('bad row') AS v")
    status = write_datasets(spark, {**tables, "3-c.psv": (late, tables["2-a.psv"][1])}, str(tmp_path))
    assert status["10-b.psv"] == "ok" and status["3-c.psv"].startswith("error")
    results = spark.read.parquet(f"{tmp_path}/results")
    assert {(r.dataset, r.status) for r in results.collect()} == {
        ("10-b.psv", "IDENTICAL"), ("2-a.psv", "IDENTICAL"), ("2-a.psv", "DIFFERENCES"), ("3-c.psv", "ERROR"),
    }


def test_roll_up(spark):
    results = compare_run(spark, {k: v for k, v in _run(spark).items() if k[0] in "12"}).results
    rows = {r.emp_id: r for r in rollup.executive_summary(results).collect()}
    assert (rows["150"].success_rate, rows["150"].parity_status) == (100.0, "PERFECT")
    assert (rows["289"].success_rate, rows["289"].parity_status) == (50.0, "NEEDS REVIEW")
    assert rows[None].is_total and rows[None].files_compared == 4 and rows[None].success_rate == 75.0
    review = rollup.issues_for_review(results).collect()
    assert [(r.emp_id, r.dataset, r.review_priority, r.severity) for r in review] == [("289", "2-a.psv", "LOW", 3)]
    status = {r.emp_id: r.success for r in rollup.run_status(results).collect()}
    assert status == {"150": True, "289": True}


def test_report_round_trip(spark):
    diff = compare_run(spark, {k: v for k, v in _run(spark).items() if k[0] in "12"})
    lines = report.report_lines(diff, generated_at="2024-01-01 00:00:00")
    mine = [r.text for r in lines.where("emp_id = '289'").orderBy("line_no").collect()]
    assert mine[9:13] == [
        "SUMMARY:",
        "-" * 40,
        "DIFF       2-a.psv                                  - Matching records with data differences: 1",
        "MATCH      10-b.psv                                 - Perfect match",
    ]
    assert "     - v: 1 records (rows: 1)" in mine and "       1 differing values" in mine
    texts = report.report_texts(lines).withColumnRenamed("emp_id", "report_file")
    parsed = {(r.report_file, r.file_name): r for r in report.parse_reports(texts).collect()}
    assert parsed["150", "2-a.psv"].status == "IDENTICAL"
    other = parsed["289", "2-a.psv"]
    assert (other.status, other.difference_count, other.primary_rows, other.replicated_rows) == ("DIFFERENCES", 1, 1, 1)


def test_parser_of_odd_texts(spark):
    texts = spark.createDataFrame(
        [("empty", ""), ("none", "no block"), ("open", "SUMMARY:\n---\nDIFF  1-a.psv - Row count: Primary=5, Replicated=2")],
        "report_file string, content string",
    )
    (row,) = report.parse_reports(texts).collect()
    assert (row.report_file, row.primary_only_rows, row.difference_count) == ("open", 3, 4)
    totals = {r.report_file: r.files_compared for r in report.report_totals(texts).collect()}
    assert totals == {"empty": 0, "none": 0, "open": 1}
