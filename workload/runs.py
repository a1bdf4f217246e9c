"""Queries of whole comparisons, reports and roll-ups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyframe.functions import labels
from tallyframe.plans import report, reporting, rollup
from tallyframe.plans.batch import Run, run_isolated
from tallyframe.plans.compare import Diff, compare_run, compare_tables
from tallyframe.plans.rules import GENERIC, CompareRules
from tallyframe.session import scratch_path
from workload.data import RULES_INI, RUN, ctes, pair, run_sql
from workload.registry import query
from workload.results_sql import ACTIVITIES, ELIGIBILITY, ISSUES, PARTS, RUN_RESULTS, USERS

RESULT = [
    "emp_id", "dataset", "match", "equivalent", "status", "primary_rows", "replicated_rows", "n_primary_only",
    "n_replicated_only", "n_records_with_diffs", "difference_count", "has_old_data", "summary",
]
RULES = CompareRules.from_ini(RULES_INI)
_WRITTEN: dict[tuple[str, str], str] = {}


def _compared(spark, sf, dataset, rules=RULES, spec=None) -> Diff:
    return compare_tables(*pair(spark, sf, dataset), dataset, spec, rules, by=["emp_id"])


@query(USERS)
def compare_generic(spark, sf):
    return _compared(spark, sf, "11-users.psv").results.select(*RESULT)


@query(f"SELECT emp_id, 'emp_id,row_number,full_name,gender,nation' AS columns_compared FROM ({USERS})")
def columns_compared(spark, sf):
    """Which columns of a dataset its rules leave to compare."""
    return _compared(spark, sf, "11-users.psv").results.select("emp_id", "columns_compared")


@query(ISSUES)
def compare_issues(spark, sf):
    return _compared(spark, sf, "9-issues-potentials.psv").results.select(*RESULT)


@query(ELIGIBILITY)
def compare_eligibility(spark, sf):
    return _compared(spark, sf, "8b-eligibilities.psv").results.select(*RESULT)


@query(ACTIVITIES)
def compare_activities(spark, sf):
    return _compared(spark, sf, "5a-activities-potential.psv").results.select(*RESULT)


@query(PARTS)
def compare_whole_rows(spark, sf):
    return _compared(spark, sf, "15-potentials.psv").results.select(*RESULT)


@query(
    f"""WITH {ctes('15-potentials.psv')},
a AS (SELECT emp_id, count(*) AS n FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM r) GROUP BY emp_id),
b AS (SELECT emp_id, count(*) AS n FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM p) GROUP BY emp_id)
SELECT emp_id, coalesce(a.n, 0) AS n_primary_only, coalesce(b.n, 0) AS n_replicated_only
FROM (SELECT DISTINCT emp_id FROM p) LEFT JOIN a USING (emp_id) LEFT JOIN b USING (emp_id)"""
)
def compare_multiset(spark, sf):
    diff = _compared(spark, sf, "15-potentials.psv", spec=GENERIC.with_(full_row="multiset"))
    return diff.results.select("emp_id", "n_primary_only", "n_replicated_only")


@query(USERS)
def compare_with_rules_table(spark, sf):
    """The rules as a table instead of a file."""
    rules = CompareRules.from_frame(RULES.to_frame(spark))
    return _compared(spark, sf, "11-users.psv", rules).results.select(*RESULT)


def _run(spark, sf) -> Diff:
    return compare_run(spark, {name: pair(spark, sf, name) for name in RUN}, RULES)


def _written(spark, sf):
    """The run's frames, committed once per session as a user would, and read back by the run's manifest."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WRITTEN:
        _WRITTEN[key] = run_isolated(spark, {name: pair(spark, sf, name) for name in RUN}, rules=RULES).path
    return Run(spark, _WRITTEN[key]).frame


@query(RUN_RESULTS)
def run_results(spark, sf):
    return _run(spark, sf).results.select(*RESULT)


def _failing(spark, sf):
    """Two sides whose last employer has a cell that cannot be read, which shows only while the job runs."""
    p, r = pair(spark, sf, "15-potentials.psv")
    return p.withColumn("p_size", F.expr("CAST(CASE WHEN emp_id = 5 THEN p_name ELSE p_size END AS INT)")), r


@query(
    f"""SELECT emp_id, dataset, match, status, primary_rows, replicated_rows, summary FROM ({USERS})
UNION ALL SELECT emp_id, dataset, match, status, primary_rows, replicated_rows, summary FROM ({PARTS})
UNION ALL SELECT NULL, x.dataset, false, 'ERROR', NULL, NULL, x.summary FROM (VALUES
 ('16-cells.psv', 'Error: [CAST_INVALID_INPUT]'), ('17-missing.psv', 'Error: [PATH_NOT_FOUND]'),
 ('5a-activities-issues.psv', 'Error: 5a-activities-issues.psv: no column row_number, action')) x(dataset, summary)"""
)
def run_with_failures(spark, sf):
    """A dataset that fails while running, one without its files and one without its key, beside two good ones."""
    tables = {n: pair(spark, sf, n) for n in ("11-users.psv", "15-potentials.psv")}
    tables["16-cells.psv"] = _failing(spark, sf)
    tables["17-missing.psv"] = lambda: (spark.read.parquet(f"{sf}/none.parquet"), tables["11-users.psv"][1])
    tables["5a-activities-issues.psv"] = tables["15-potentials.psv"]
    results = run_isolated(spark, tables, rules=RULES).frame("results")
    kind = F.regexp_extract("summary", r"^Error: \[[A-Z_]+", 0)
    return results.select(
        "emp_id", "dataset", "match", "status", "primary_rows", "replicated_rows",
        F.when(kind != "", F.concat(kind, F.lit("]"))).otherwise(F.col("summary")).alias("summary"),
    )


@query(
    f"""WITH res AS ({RUN_RESULTS}) SELECT emp_id, emp_id IS NULL AS is_total, files_compared, identical, differences,
 success_rate, CASE WHEN emp_id IS NULL THEN NULL WHEN identical = files_compared THEN 'PERFECT'
 WHEN identical * 100 >= files_compared * 90 THEN 'MINOR ISSUES' ELSE 'NEEDS REVIEW' END AS parity_status
FROM (SELECT emp_id, count(*) AS files_compared, count(*) FILTER (WHERE match) AS identical,
 count(*) FILTER (WHERE NOT match) AS differences,
 round(100.0::DOUBLE * count(*) FILTER (WHERE match) / count(*), 1) AS success_rate FROM res GROUP BY ROLLUP (emp_id))"""
)
def executive_summary(spark, sf):
    return rollup.executive_summary(_written(spark, sf)("results"))


@query(
    f"""WITH res AS ({RUN_RESULTS}) SELECT count(DISTINCT emp_id) AS employers, count(*) AS files_compared,
 count(*) FILTER (WHERE match) AS identical, count(*) FILTER (WHERE NOT match) AS differences,
 round(100.0::DOUBLE * count(*) FILTER (WHERE match) / count(*), 1) AS success_rate FROM res"""
)
def overall_statistics(spark, sf):
    return rollup.overall_statistics(_written(spark, sf)("results"))


_DETAIL = """SELECT CASE WHEN match THEN 'None' WHEN n_primary_only > 0 OR n_replicated_only > 0 THEN 'HIGH'
 WHEN difference_count > 10 THEN 'MEDIUM' ELSE 'LOW' END AS review_priority, emp_id, dataset, status,
 CASE WHEN match THEN 'None' WHEN n_primary_only > 0 OR n_replicated_only > 0 THEN 'Row Count Mismatch'
 WHEN difference_count > 10 THEN 'Multiple Differences' ELSE 'Minor Differences' END AS issue_type,
 difference_count, n_records_with_diffs AS row_differences, n_primary_only, n_replicated_only,
 CASE WHEN match THEN '' ELSE summary END AS notes, '' AS review_comments FROM res"""


@query(f"WITH res AS ({RUN_RESULTS}) {_DETAIL}")
def detailed_analysis(spark, sf):
    return rollup.detailed_analysis(_written(spark, sf)("results"))


@query(
    f"""WITH res AS ({RUN_RESULTS}), det AS ({_DETAIL}) SELECT *, CASE review_priority WHEN 'HIGH' THEN 1
 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS severity FROM det WHERE status <> 'IDENTICAL'"""
)
def issues_for_review(spark, sf):
    return rollup.issues_for_review(_written(spark, sf)("results"))


@query(
    f"""WITH res AS ({RUN_RESULTS}) SELECT emp_id, true AS success, count(*) AS n_datasets,
 count(*) FILTER (WHERE NOT match) AS n_different FROM res GROUP BY emp_id"""
)
def run_status(spark, sf):
    return rollup.run_status(_written(spark, sf)("results")).drop("message")


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed
FROM (SELECT user_id, bool_and(event_type <> 'error' OR value > 5) AS ok FROM events GROUP BY user_id)"""
)
def batch_outcome(spark, sf):
    status = run_sql(
        spark, sf,
        """SELECT user_id AS emp_id, bool_and(event_type <> 'error' OR value > 5) AS success
        FROM events GROUP BY user_id""",
    )
    return rollup.batch_outcome(status)


# --- reports --------------------------------------------------------------------------------
@query(
    f"""WITH res AS ({RUN_RESULTS}) SELECT emp_id, printf('%-10s %-40s - %s', CASE WHEN match THEN 'MATCH' ELSE 'DIFF' END,
 dataset, summary) AS "text", row_number() OVER (PARTITION BY emp_id ORDER BY
 CAST(regexp_extract(dataset, '^[0-9]+') AS INT), regexp_extract(dataset, '^[0-9]+([a-z]?)', 1), dataset) AS place
FROM res"""
)
def report_summary_block(spark, sf):
    """The summary block of each employer's report, in order."""
    table = _written(spark, sf)
    lines = report.report_lines(Diff(results=table("results")), generated_at="now")
    start = F.min(F.when(F.col("text") == "SUMMARY:", F.col("line_no"))).alias("_start")
    end = F.min(F.when(F.col("text") == "DETAILED RESULTS:", F.col("line_no"))).alias("_end")
    bounds = lines.groupBy("emp_id").agg(start, end)
    inside = lines.join(bounds, "emp_id").where("line_no > _start + 1 AND line_no < _end - 1")
    return inside.select("emp_id", "text", (F.col("line_no") - F.col("_start") - 1).alias("place"))


_USER_CELLS = " UNION ALL ".join(
    f"""SELECT p.emp_id, p.row_number AS key, '{c}' AS col, CASE WHEN {a} <> '' AND {b} = '' THEN 1
 WHEN {a} = '' AND {b} <> '' THEN 2 ELSE 3 END AS cls FROM p JOIN r USING (emp_id, row_number) WHERE {a} <> {b}"""
    for c, a, b in [
        (c, *(f"coalesce({s}.{c}, '')" for s in "pr")) for c in ("full_name", "nation")
    ]
)
_USER_LINES = f"""WITH {ctes('11-users.psv')}, res AS ({USERS}), cells AS ({_USER_CELLS}),
cols AS (SELECT emp_id, col, count(*) AS n, count(*) FILTER (WHERE cls = 1) AS a, count(*) FILTER (WHERE cls = 2) AS b,
 count(*) FILTER (WHERE cls = 3) AS c FROM cells GROUP BY ALL),
keys AS (SELECT emp_id, col, string_agg(key, ', ' ORDER BY key) AS shown, count(*) AS k FROM (SELECT *, row_number() OVER (
 PARTITION BY emp_id, col ORDER BY key) AS i FROM cells) WHERE i <= 10 GROUP BY ALL),
recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY emp_id, side ORDER BY row_number) AS i FROM (
 SELECT p.*, 60 AS side FROM p WHERE (emp_id, row_number) NOT IN (SELECT (emp_id, row_number) FROM r)
 UNION ALL SELECT r.*, 70 FROM r WHERE (emp_id, row_number) NOT IN (SELECT (emp_id, row_number) FROM p))) WHERE i <= 5),
shown AS (SELECT emp_id, side, row_number() OVER (PARTITION BY emp_id, side ORDER BY length(row_number), row_number) AS i,
 '{{"full_name":"' || full_name || '","gender":"' || lower(gender) || '","nation":"' || nation || '"}}' AS rec FROM recs),
diff AS (SELECT * FROM res WHERE NOT match),
lines AS (
 SELECT emp_id, 1 AS part, '' AS o, unnest([
  {{'i': 0, 't': ''}}, {{'i': 1, 't': 'File: 11-users.psv'}}, {{'i': 2, 't': 'Primary rows: ' || primary_rows}},
  {{'i': 3, 't': 'Replicated rows: ' || replicated_rows}}, {{'i': 4, 't': 'Summary: '}}]) AS l FROM diff
 UNION ALL SELECT emp_id, 2, '', unnest(list_transform(range(1, len(string_split(summary, '; ')) + 1),
  lambda i: {{'i': CAST(i AS INT), 't': '  - ' || string_split(summary, '; ')[i]}})) FROM diff
 UNION ALL SELECT DISTINCT emp_id, 50, '', {{'i': 0, 't': '  Columns with differences in matching records:'}} FROM cols
 UNION ALL SELECT emp_id, 51, lpad(CAST(1000000000 - n AS VARCHAR), 12, '0') || col, unnest([
  {{'i': 0, 't': '     - ' || col || ': ' || n || ' records (rows: ' || shown
    || CASE WHEN n > k THEN ', ... (' || (n - k) || ' more)' ELSE '' END || ')'}},
  {{'i': 1, 't': '       ' || concat_ws('; ', CASE WHEN a > 0 THEN a || ' primary has value/replicated empty' END,
    CASE WHEN b > 0 THEN b || ' primary empty/replicated has value' END,
    CASE WHEN c > 0 THEN c || ' differing values' END)}}]) FROM cols JOIN keys USING (emp_id, col)
 UNION ALL SELECT emp_id, 60, '', {{'i': 0, 't': '  ' || n_primary_only || ' records in primary but NOT in replicated'}}
  FROM diff WHERE n_primary_only > 0
 UNION ALL SELECT emp_id, 70, '', {{'i': 0, 't': '  ' || n_replicated_only || ' records in replicated but NOT in primary'}}
  FROM diff WHERE n_replicated_only > 0
 UNION ALL SELECT emp_id, side + 1, '', {{'i': 0, 't': '     Sample (first ' || count(*) || ' records):'}} FROM shown GROUP BY ALL
 UNION ALL SELECT emp_id, side + 2, lpad(CAST(i AS VARCHAR), 6, '0'), {{'i': 0, 't': '       ' || i || '. ' || rec}} FROM shown)
"""
_USER_DETAILS = """SELECT emp_id, l.t AS "text", row_number() OVER (PARTITION BY emp_id ORDER BY part, o, l.i) AS place
FROM lines"""
# The whole report: head and summary before the details, a rule after them.
_USER_REPORT = """SELECT emp_id, l.t AS "text", row_number() OVER (PARTITION BY emp_id ORDER BY part, o, l.i) AS line_no
FROM (SELECT * FROM lines UNION ALL SELECT emp_id, 0, '', unnest([
  {'i': 0, 't': repeat('=', 80)}, {'i': 1, 't': 'COMPARISON REPORT'}, {'i': 2, 't': repeat('=', 80)},
  {'i': 3, 't': 'Generated: now'}, {'i': 4, 't': 'Employer ID: ' || emp_id}, {'i': 5, 't': 'Total files compared: 1'},
  {'i': 6, 't': 'Matching files: ' || CAST(match AS INT)}, {'i': 7, 't': 'Different files: ' || CAST(NOT match AS INT)},
  {'i': 8, 't': ''}, {'i': 9, 't': 'SUMMARY:'}, {'i': 10, 't': repeat('-', 40)},
  {'i': 11, 't': printf('%-10s %-40s - %s', CASE WHEN match THEN 'MATCH' ELSE 'DIFF' END, dataset, summary)},
  {'i': 12, 't': ''}, {'i': 13, 't': 'DETAILED RESULTS:'}, {'i': 14, 't': repeat('-', 40)}]) FROM res
 UNION ALL SELECT emp_id, 999, '', {'i': 0, 't': repeat('=', 80)} FROM res)"""


@query(_USER_LINES + _USER_DETAILS)
def report_details(spark, sf):
    """The detail section of one dataset in each employer's report, in order."""
    lines = report.report_lines(_compared(spark, sf, "11-users.psv"), generated_at="now")
    start = F.min(F.when(F.col("text") == "DETAILED RESULTS:", F.col("line_no"))).alias("_start")
    bounds = lines.groupBy("emp_id").agg(start, F.max("line_no").alias("_end"))
    inside = lines.join(bounds, "emp_id").where("line_no > _start + 1 AND line_no < _end")
    return inside.select("emp_id", "text", (F.col("line_no") - F.col("_start") - 1).alias("place"))


@query(_USER_LINES + _USER_REPORT)
def report_lines(spark, sf):
    """The whole report of each employer, line by line."""
    return report.report_lines(_compared(spark, sf, "11-users.psv"), generated_at="now")


@query()
def report_of_run(spark, sf):
    """Reports of a run with all kinds of datasets."""
    table = _written(spark, sf)
    names = ["results", "column_diffs", "column_samples", "record_samples", "set_diffs"]
    return report.report_lines(Diff(**{n: table(n) for n in names}), generated_at="now")


_READ_BACK = """SELECT CAST(emp_id AS STRING) AS emp_id, dataset, CASE WHEN match THEN 'IDENTICAL' ELSE 'DIFFERENCES' END AS status,
 CASE WHEN NOT match THEN primary_rows END AS primary_rows, CASE WHEN NOT match THEN replicated_rows END AS replicated_rows"""


@query(
    f"""WITH u AS ({USERS}), x AS ({PARTS}) {_READ_BACK}, 'any' AS of_date, emp_id || '_01-03-24_1000_comparison_report.txt' AS report_file FROM x
UNION ALL {_READ_BACK}, 'any', emp_id || '_01-02-24_0930_comparison_report.txt' FROM u WHERE emp_id NOT IN (SELECT emp_id FROM x)
UNION ALL {_READ_BACK}, '01-02-24', emp_id || '_01-02-24_0930_comparison_report.txt' FROM u"""
)
def report_round_trip(spark, sf):
    """Reports of two runs, published under their names, found again by date and read back."""
    path = scratch_path(spark, "published")
    for dataset, at in (("11-users.psv", datetime(2024, 1, 2, 9, 30)), ("15-potentials.psv", datetime(2024, 1, 3, 10, 0))):
        lines = report.report_lines(_compared(spark, sf, dataset), generated_at=str(at))
        reporting.publish_reports(lines.withColumn("emp_id", F.col("emp_id").cast("string")), path, at)
    found = []
    for date in (None, "01-02-24"):
        results = reporting.report_results(reporting.published_reports(spark, path, date))
        found.append(results.withColumn("of_date", F.lit(date or "any")))
    columns = ["emp_id", "dataset", "status", "primary_rows", "replicated_rows", "of_date", "report_file"]
    return found[0].unionByName(found[1]).select(*columns)


# One report per customer, with figures that follow from the row.
_A, _B = "(c_custkey % 50)", "(c_custkey % 47)"
_REPORTS = f"""SELECT c_custkey, CAST(c_custkey AS STRING) || '_01-02-24_0930_comparison_report.txt' AS report_file,
 'HEAD' || chr(10) || 'SUMMARY:' || chr(10) || '-----' || chr(10)
 || 'MATCH      1-files.psv      - Perfect match' || chr(10)
 || 'DIFF       2-rows.csv - Row count: Primary=' || {_A} || ', Replicated=' || {_B} || '; more' || chr(10)
 || 'DIFF       3-cells.psv - Values' || chr(10)
 || 'DIFF       4-none.psv' || chr(10)
 || 'DIFF       5-same.psv - Row count: Primary=1, Replicated=3' || chr(10)
 || chr(10) || 'DETAILED RESULTS:' || chr(10) || '-----' || chr(10)
 || 'File: 2-rows.csv' || chr(10) || 'Primary rows: ' || {_A} || chr(10) || 'Replicated rows: ' || {_B} || chr(10)
 || chr(10) || 'File: 3-cells.psv' || chr(10) || 'Primary rows: 9' || chr(10)
 || '  ' || {_A} || ' Rows with differences' || chr(10) || '  ' || {_B} || ' value differences' || chr(10)
 || chr(10) || 'File: 5-same.psv' || chr(10) || 'No differences found' || chr(10) || '=====' AS content
FROM customer"""

_PARSED = f"""SELECT report_file, file_name, status, difference_count, row_differences, value_differences,
 primary_only_rows, replicated_only_rows, primary_rows, replicated_rows, notes FROM (
 SELECT report_file, '1-files.psv' AS file_name, 'IDENTICAL' AS status, 0::BIGINT AS difference_count,
 0::BIGINT AS row_differences, 0::BIGINT AS value_differences, 0::BIGINT AS primary_only_rows,
 0::BIGINT AS replicated_only_rows, NULL::BIGINT AS primary_rows, NULL::BIGINT AS replicated_rows, '' AS notes FROM t
 UNION ALL SELECT report_file, '2-rows.csv', 'DIFFERENCES', 1 + abs({_A} - {_B}), 0, 0, greatest({_A} - {_B}, 0),
 greatest({_B} - {_A}, 0), {_A}, {_B}, 'Row count: Primary=' || {_A} || ', Replicated=' || {_B} || '; more' FROM t
 UNION ALL SELECT report_file, '3-cells.psv', 'DIFFERENCES', {_A}, {_A}, {_B}, 0, 0, 9, NULL, 'Values' FROM t
 UNION ALL SELECT report_file, '5-same.psv', 'IDENTICAL', 0, 0, 0, 0, 2, NULL, NULL, 'Row count: Primary=1, Replicated=3'
 FROM t)"""


def _report_texts(spark, sf):
    return run_sql(spark, sf, _REPORTS)


@query(f"WITH t AS ({_REPORTS}) {_PARSED}")
def parse_reports(spark, sf):
    return report.parse_reports(_report_texts(spark, sf)).drop("entry_no")


@query(
    f"""WITH t AS ({_REPORTS}), x AS ({_PARSED}) SELECT report_file, count(*) AS files_compared,
 1::BIGINT AS files_identical, 4::BIGINT AS files_with_differences, sum(difference_count)::BIGINT AS total_differences
FROM x GROUP BY report_file"""
)
def report_totals(spark, sf):
    return report.report_totals(_report_texts(spark, sf))


@query(
    f"""WITH t AS ({_REPORTS}), x AS ({_PARSED}), res AS (SELECT regexp_extract(report_file, '^[0-9]+') AS emp_id, *,
 file_name AS dataset, status = 'IDENTICAL' AS match, primary_only_rows AS n_primary_only,
 replicated_only_rows AS n_replicated_only, row_differences AS n_records_with_diffs, notes AS summary FROM x)
SELECT review_priority, emp_id, dataset, issue_type, difference_count FROM ({_DETAIL})"""
)
def imported_reports(spark, sf):
    """Imported report texts feed the same roll-up as comparison results."""
    parsed = report.parse_reports(_report_texts(spark, sf)).withColumn(
        "emp_id", F.regexp_extract("report_file", "^[0-9]+", 0)
    )
    detail = rollup.detailed_analysis(report.results_of_reports(parsed))
    return detail.select("review_priority", "emp_id", "dataset", "issue_type", "difference_count")


_OLD = f"""SELECT c_custkey, 'Comparing: 7-old.psv' || chr(10) || CASE c_custkey % 4 WHEN 0 THEN 'IDENTICAL'
 WHEN 1 THEN 'DIFFERENCES FOUND' || chr(10) || {_A} || ' rows with differences' || chr(10) || {_B}
   || ' rows only in primary' || chr(10) || 'Only in replicated: 3' || chr(10) || {_A} || ' value differences'
 WHEN 2 THEN 'SKIPPED: file not found' ELSE 'nothing known' END AS section FROM customer"""


@query(
    f"""SELECT c_custkey, '7-old.psv' AS file_name, ['IDENTICAL', 'DIFFERENCES', 'SKIPPED', 'UNKNOWN'][c_custkey % 4 + 1]
 AS status, CASE WHEN f THEN {_A} + {_B} + 3 ELSE 0 END AS difference_count,
 CASE WHEN f THEN {_A} ELSE 0 END AS row_differences, CASE WHEN f THEN {_B} ELSE 0 END AS primary_only_rows,
 CASE WHEN f THEN 3::BIGINT ELSE 0 END AS replicated_only_rows, CASE WHEN f THEN {_A} ELSE 0 END AS value_differences,
 CASE WHEN c_custkey % 4 = 2 THEN 'File not found in one or both databases' WHEN f THEN concat_ws('; ',
 CASE WHEN {_B} > 0 THEN {_B} || ' rows only in primary' END, '3 rows only in replicated',
 CASE WHEN {_A} > 10 THEN 'HIGH: ' || {_A} || ' rows with differences' END) ELSE '' END AS notes
FROM (SELECT c_custkey, c_custkey % 4 = 1 AS f FROM customer)"""
)
def old_report_sections(spark, sf):
    return report.parse_old_sections(run_sql(spark, sf, _OLD))


@query(
    f"""SELECT c_custkey, CASE WHEN s = 'IDENTICAL' THEN 'None' WHEN s = 'SKIPPED' THEN 'Check File'
 WHEN a > 0 THEN 'HIGH' WHEN d > 10 THEN 'MEDIUM' ELSE 'LOW' END AS review_priority,
 CASE WHEN s = 'IDENTICAL' THEN 'None' WHEN s = 'SKIPPED' THEN 'File Missing' WHEN a > 0 THEN 'Row Count Mismatch'
 WHEN d > 10 THEN 'Multiple Differences' ELSE 'Minor Differences' END AS issue_type
FROM (SELECT c_custkey, ['IDENTICAL', 'SKIPPED', 'DIFFERENCES'][c_custkey % 3 + 1] AS s,
 c_custkey % 2 AS a, c_custkey % 25 AS d FROM customer)"""
)
def review_classes(spark, sf):
    rows = run_sql(
        spark, sf,
        """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'IDENTICAL' WHEN 1 THEN 'SKIPPED' ELSE 'DIFFERENCES' END AS s,
        c_custkey % 2 AS a, c_custkey % 25 AS d FROM customer""",
    )
    args = (F.col("s"), F.col("a"), F.lit(0), F.col("d"))
    return rows.select(
        "c_custkey",
        labels.review_priority(*args).alias("review_priority"),
        labels.issue_type(*args).alias("issue_type"),
    )


# Report files of three deliveries: some customers come again, with other figures.
_DELIVERED = f"""SELECT c_custkey, d.n AS delivery, CAST(c_custkey AS STRING) || '_01-0' || CAST(d.n AS STRING) || '-24_0930_comparison_report.txt' AS name,
 'SUMMARY:' || chr(10) || '-----' || chr(10) || 'MATCH      1-files.psv - Perfect match' || chr(10)
 || CASE WHEN (c_custkey + d.n) % 3 = 0 THEN 'MATCH' ELSE 'DIFF' END || '       2-rows.csv - Row count: Primary=' || CAST(c_custkey AS STRING)
 || ', Replicated=' || CAST(d.n AS STRING) || chr(10) || chr(10) || 'DETAILED RESULTS:' || chr(10) || '-----' || chr(10) || '=====' AS content
FROM customer, (VALUES (1), (2), (3)) d(n) WHERE c_custkey < 40 AND (d.n = 1 OR c_custkey % (d.n + 1) = 0)"""


@query(
    f"""WITH d AS ({_DELIVERED}), n AS (SELECT * FROM (SELECT *, c_custkey AS emp, row_number() OVER (PARTITION BY c_custkey ORDER BY delivery DESC) AS k FROM d) WHERE k = 1),
r AS (SELECT CAST(emp AS STRING) AS emp_id, unnest([true, (c_custkey + delivery) % 3 = 0]) AS match FROM n)
SELECT emp_id, emp_id IS NULL AS is_total, count(*) AS files_compared, count(*) FILTER (WHERE match) AS identical, count(*) FILTER (WHERE NOT match) AS differences,
 round(100.0::DOUBLE * count(*) FILTER (WHERE match) / count(*), 1) AS success_rate, CASE WHEN emp_id IS NULL THEN NULL
 WHEN count(*) FILTER (WHERE match) = count(*) THEN 'PERFECT' WHEN count(*) FILTER (WHERE match) * 100 >= count(*) * 90 THEN 'MINOR ISSUES' ELSE 'NEEDS REVIEW' END
 AS parity_status FROM r GROUP BY ROLLUP (emp_id)"""
)
def report_roll_up(spark, sf):
    """From report files to the executive table: a stream that reads the files of each delivery once."""
    path = scratch_path(spark, "followed")
    rows = run_sql(spark, sf, _DELIVERED)
    for delivery in range(1, 4):
        # Spark names part files itself, so here the report's name is the folder's; a stream names reports by either.
        mine = rows.where(F.col("delivery") == delivery).select(F.col("name").alias("report"), F.col("content").alias("value"))
        mine.write.mode("append").partitionBy("report").text(f"{path}/files")
        reporting.follow_reports(spark, f"{path}/files", path, f"{path}/checkpoint").awaitTermination()
    return rollup.executive_summary(reporting.current_results(spark, path))
