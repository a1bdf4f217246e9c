"""Queries of sources, sinks and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import ranking
from tallyframe.plans.report import write_report
from tallyframe.plans.rules import GENERIC, apply_rules
from tallyframe.session import few_listing_tasks, scratch_path
from tallyframe.sources import delimited, ids, runs, sql
from workload.data import norm, register, run_sql
from workload.registry import query
from workload.runs import RULES

# --- delimited files ------------------------------------------------------------------------
_TRICKY = """SELECT CAST(o_orderkey AS STRING) AS id,
 CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority || '|x' WHEN 1 THEN 'say "' || o_orderstatus || '"' WHEN 2 THEN 'N/A'
 WHEN 3 THEN NULL WHEN 4 THEN ' two  blanks' ELSE o_orderpriority || ',y' END AS note,
 CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderstatus END AS state FROM orders"""
_TRICKY_READ = f"""SELECT id, CASE WHEN note IS NULL OR note = 'N/A' THEN '' ELSE note END AS note, state FROM ({_TRICKY})"""


@query(_TRICKY_READ)
def delimited_round_trip(spark, sf):
    """Values with separators, quotes and blanks survive the sink and the source."""
    path = scratch_path(spark, "tricky")
    delimited.write_delimited(run_sql(spark, sf, _TRICKY), path)
    sep = delimited.detect_separator(spark, path)
    return delimited.good_rows(delimited.read_delimited(spark, path, sep), sep)


# Raw lines under the header a|b|c: most are well formed, some too long, some too short.
_LINES = """SELECT CASE WHEN p_partkey % 50 = 0 THEN p_partkey || '|' || p_name || '|' || p_type || '|extra'
 WHEN p_partkey % 33 = 0 THEN p_partkey || '|' || p_name ELSE p_partkey || '|' || p_name || '|' || p_type END AS line
FROM part"""


def _raw_lines(spark, sf):
    path = scratch_path(spark, "lines")
    lines = run_sql(spark, sf, _LINES).select(F.col("line").alias("a|b|c"))
    lines.write.options(header=True, sep="\u0001", quote="\u0000").csv(path)
    return delimited.read_delimited(spark, path)


@query(
    """SELECT CAST(p_partkey AS STRING) AS a, p_name AS b, CASE WHEN p_partkey % 33 = 0 THEN '' ELSE p_type END AS c
FROM part WHERE p_partkey % 50 <> 0"""
)
def short_rows_padded(spark, sf):
    return delimited.good_rows(_raw_lines(spark, sf), "|")


@query("SELECT p_partkey || '|' || p_name || '|' || p_type || '|extra' AS _corrupt_record FROM part WHERE p_partkey % 50 = 0")
def too_long_rows(spark, sf):
    return delimited.malformed_rows(_raw_lines(spark, sf), "|")


_HEADERS = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'id|' || lang || ',x' WHEN 1 THEN 'id,' || lang WHEN 2 THEN lang
 WHEN 3 THEN lang ELSE 'a|b|' || lang END AS header,
 CASE doc_id % 5 WHEN 2 THEN source || '.CSV' ELSE source || '.psv' END AS file_name FROM documents"""


@query(
    f"""SELECT doc_id, CASE WHEN contains(header, '|') THEN '|' WHEN contains(header, ',') THEN ','
 WHEN lower(file_name) LIKE '%.csv' THEN ',' ELSE '|' END AS separator,
 len(header) - len(replace(header, '|', '')) AS pipes FROM ({_HEADERS})"""
)
def header_separators(spark, sf):
    docs = run_sql(spark, sf, _HEADERS)
    header = F.col("header")
    return docs.select(
        "doc_id",
        text.header_separator(header, F.col("file_name")).alias("separator"),
        text.char_count(header, "|").cast("bigint").alias("pipes"),
    )


@query(
    """SELECT o_orderpriority AS part, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ',' ELSE '|' END AS separator,
 'id' || CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ',' ELSE '|' END || 'o_orderstatus' AS header
FROM orders GROUP BY o_orderpriority"""
)
def file_headers(spark, sf):
    """Header and separator of every file below a folder, whatever separator each uses."""
    path = scratch_path(spark, "mixed")
    orders = run_sql(spark, sf, "SELECT o_orderpriority, CAST(o_orderkey AS STRING) AS id, o_orderstatus FROM orders")
    with_commas = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    for rows, sep in ((orders.where(with_commas), ","), (orders.where(~with_commas), "|")):
        delimited.write_delimited(rows, path, sep, ["o_orderpriority"], mode="append")
    found = delimited.header_separators(spark, f"{path}/*/*.csv")
    folder = F.regexp_extract("file_path", "o_orderpriority=([^/]+)/", 1)
    part = F.url_decode(F.regexp_replace(folder, r"\+", "%2B"))
    return found.select(part.alias("part"), "separator", "header").distinct()


@query(
    f"""SELECT emp_id, row_number, full_name, {norm('gender')} AS gender FROM (
 SELECT CAST(c_nationkey AS INT) AS emp_id, CAST(c_custkey AS STRING) AS row_number,
 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS full_name, '  ' || c_mktsegment || '_X' AS gender FROM customer)"""
)
def prepared_rows(spark, sf):
    """Rules applied: ignored columns gone, the key kept, NA tokens empty, gender normalised."""
    customers = run_sql(
        spark, sf,
        """SELECT c_nationkey AS emp_id, CAST(c_custkey AS STRING) AS row_number, c_custkey AS ID,
        CASE WHEN c_custkey % 3 = 0 THEN 'None' ELSE c_name END AS full_name, '  ' || c_mktsegment || '_X' AS gender,
        'now' AS created_at FROM customer""",
    )
    return apply_rules(customers, "11-Users.psv", RULES, GENERIC)


# --- SQL ------------------------------------------------------------------------------------
@query(
    """SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key FROM orders
WHERE o_totalprice >= 1000 GROUP BY o_orderpriority"""
)
def sql_source(spark, sf):
    register(spark, sf, "orders")
    return sql.query_source(
        spark,
        """SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_key FROM orders
        WHERE o_totalprice >= :floor GROUP BY o_orderpriority""",
        {"floor": 1000},
    )


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def one_row_lookup(spark, sf):
    events = run_sql(spark, sf, "SELECT event_id, user_id, event_type, ts FROM events")
    return sql.one_row(events, [F.desc("ts"), F.desc("event_id")]).drop("ts")


_LOOKBACK = """SELECT user_id, max(ts) AS latest_at,
 CAST(trunc(epoch(TIMESTAMP '2024-02-01 00:00:00' - max(ts)) / 60) AS BIGINT) AS lookback_minutes FROM events GROUP BY user_id"""


@query(f"SELECT user_id, lookback_minutes FROM ({_LOOKBACK})")
def lookback_minutes(spark, sf):
    events = run_sql(spark, sf, "SELECT user_id, ts FROM events")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return sql.lookbacks(events, ["user_id"], "ts", now).drop("latest_at")


@query(
    f"""SELECT l.user_id AS emp_id, e.event_id, e.event_type FROM ({_LOOKBACK}) l JOIN events e ON e.user_id = l.user_id
AND e.ts >= TIMESTAMP '2024-01-31 23:00:00' - to_minutes(l.lookback_minutes)"""
)
def sql_template(spark, sf):
    """One template for all employers: each sees its own rows within its own lookback."""
    events = run_sql(spark, sf, "SELECT user_id AS emp_id, ts FROM events")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    employers = sql.lookbacks(events, ["emp_id"], "ts", now)
    template = sql.QueryTemplate(
        """SELECT event_id, event_type FROM events WHERE user_id = {{employer_id}}
        AND ts >= TIMESTAMP_NTZ '2024-01-31 23:00:00' - INTERVAL '{{time_interval}}'"""
    )
    register(spark, sf, "events")
    return template.run_for_all(spark, employers)


_EXPORTS = {
    "orders": "SELECT o_custkey % 10 AS emp_id, o_orderkey, o_orderstatus FROM orders",
    "events": "SELECT user_id % 10 AS emp_id, event_id, event_type FROM events",
    "absent": "",
}


@query(
    """SELECT dataset, target, emp_id, count(*) AS n FROM (
 SELECT 'orders' AS dataset, o_custkey % 10 AS emp_id FROM orders UNION ALL SELECT 'events', user_id % 10 FROM events),
 (SELECT unnest(['primary', 'replicated']) AS target) GROUP BY ALL"""
)
def export_datasets(spark, sf):
    """All employers of every dataset in one job each; an absent query is skipped."""
    register(spark, sf, "orders", "events")
    out = scratch_path(spark, "export")
    for target in ("primary", "replicated"):
        sql.export_datasets(spark, _EXPORTS, out, target)
    written = spark.read.option("basePath", out)
    parts = []
    for name in ("orders", "events"):
        rows = written.parquet(f"{out}/dataset={name}").select("dataset", "target", F.col("emp_id").cast("bigint"))
        parts.append(rows.groupBy("dataset", "target", "emp_id").agg(F.count(F.lit(1)).alias("n")))
    return parts[0].unionByName(parts[1])


# --- listings -------------------------------------------------------------------------------
_RUNS = """SELECT CAST(user_id AS STRING) AS emp_id,
 CAST(user_id AS STRING) || ' ' || CAST(CAST(ts AS DATE) AS STRING) AS run_id,
 event_type AS target, 'd' || CAST(event_id % 9 AS STRING) || '.psv' AS dataset, ts AS modified_at FROM events"""


@query(
    f"""SELECT emp_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY emp_id ORDER BY modified_at DESC, run_id DESC)
 AS k FROM ({_RUNS})) WHERE k = 1"""
)
def latest_run(spark, sf):
    return runs.latest_run(run_sql(spark, sf, _RUNS)).select("emp_id", "run_id")


@query(
    f"""SELECT emp_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY emp_id ORDER BY modified_at DESC, run_id DESC)
 AS k FROM ({_RUNS}) WHERE contains(run_id, '2024-01-1')) WHERE k = 1"""
)
def latest_run_of_stamp(spark, sf):
    return runs.latest_run(run_sql(spark, sf, _RUNS), "2024-01-1").select("emp_id", "run_id")


@query(
    f"""SELECT emp_id, run_id, n_targets, CASE WHEN n_targets = 2 THEN a END AS primary_target,
 CASE WHEN n_targets = 2 THEN b END AS replicated_target,
 CASE WHEN n_targets < 2 THEN 'too few targets' WHEN n_targets > 2 THEN 'choose two targets' END AS problem
FROM (SELECT emp_id, run_id, count(DISTINCT target) AS n_targets, min(target) AS a, max(target) AS b FROM ({_RUNS}) GROUP BY ALL)"""
)
def run_sides(spark, sf):
    return runs.run_sides(run_sql(spark, sf, _RUNS))


_PATHS = """SELECT '/base/01-02-2024/' || CAST(user_id AS STRING) || ' 01-02-24 0930/' || event_type || '/d'
 || CAST(event_id AS STRING) || '.psv' AS path, 'd' || CAST(event_id AS STRING) || '.psv' AS file_name, ts AS modified_at FROM events"""


@query(
    """SELECT CAST(user_id AS STRING) AS emp_id, '01-02-2024' AS run_date, CAST(user_id AS STRING) || ' 01-02-24 0930' AS run_id,
 event_type AS target, 'd' || event_id || '.psv' AS dataset FROM events"""
)
def run_listing(spark, sf):
    return runs.list_runs(run_sql(spark, sf, _PATHS)).drop("modified_at", "path")


_NAMES_P = "SELECT DISTINCT source || '-' || lang AS dataset FROM documents WHERE doc_id % 2 = 0"
_NAMES_R = "SELECT DISTINCT source || '-' || lang AS dataset FROM documents WHERE doc_id % 7 <> 3"


@query(
    f"""WITH p AS ({_NAMES_P}), r AS ({_NAMES_R}) SELECT coalesce(p.dataset, r.dataset) AS dataset,
 CASE WHEN p.dataset IS NOT NULL AND r.dataset IS NOT NULL THEN 'both' WHEN p.dataset IS NOT NULL THEN 'primary_only'
 ELSE 'replicated_only' END AS presence, p.dataset IS NOT NULL AND r.dataset IS NOT NULL AS is_compared
FROM p FULL JOIN r ON p.dataset = r.dataset WHERE lower(coalesce(p.dataset, r.dataset)) <> 'src1-en'"""
)
def dataset_pairing(spark, sf):
    p, r = run_sql(spark, sf, _NAMES_P), run_sql(spark, sf, _NAMES_R)
    return runs.pair_datasets(p, r, excluded=["SRC1-EN"])


@query(
    f"""SELECT dataset FROM ({_NAMES_P}) WHERE lower(dataset) NOT IN
 (SELECT lower(source || '-' || lang) FROM documents WHERE source IN ('src1', 'src7'))"""
)
def excluded_datasets(spark, sf):
    p = run_sql(spark, sf, _NAMES_P)
    banned = run_sql(spark, sf, "SELECT upper(source || '-' || lang) AS dataset FROM documents WHERE source IN ('src1', 'src7')")
    return runs.anti_excluded(p, banned)


_FILES = """SELECT CASE WHEN event_id % 10 = 0 THEN 'notes.txt' ELSE CAST(user_id AS STRING) || '_01-' || CAST(1 + event_id % 28 AS STRING)
 || '-24_' || CAST(event_id AS STRING) || '_comparison_report.txt' END AS file_name,
 '/r/' || CAST(event_id AS STRING) AS path, ts AS modified_at FROM events"""


def _newest(where):
    return f"""SELECT emp_id, path FROM (SELECT regexp_extract(file_name, '^([^_]+)_', 1) AS emp_id, path,
 row_number() OVER (PARTITION BY regexp_extract(file_name, '^([^_]+)_', 1) ORDER BY modified_at DESC, file_name DESC) AS k
 FROM ({_FILES}) WHERE file_name LIKE '%\\_comparison\\_report.txt' ESCAPE '\\' {where}) WHERE k = 1"""


@query(_newest(""))
def newest_reports(spark, sf):
    return runs.find_reports(run_sql(spark, sf, _FILES)).select("emp_id", "path")


@query(_newest("AND contains(file_name, '_01-5-24_')"))
def newest_reports_of_date(spark, sf):
    return runs.find_reports(run_sql(spark, sf, _FILES), "01-5-24").select("emp_id", "path")


@query(
    """SELECT CAST(user_id AS STRING) AS emp_id, count(*) AS n FROM events GROUP BY user_id"""
)
def report_files(spark, sf):
    """Reports written as text files, listed, and read back as whole texts."""
    path = scratch_path(spark, "reports")
    lines = run_sql(spark, sf, "SELECT CAST(user_id AS STRING) AS emp_id, event_id AS line_no, event_type AS text FROM events")
    write_report(lines, path)
    with few_listing_tasks(spark):
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    employer = F.regexp_extract(F.col("_metadata.file_path"), "emp_id=([^/]+)/", 1)
    n_lines = text.char_count(F.col("value"), "\n").cast("bigint")
    return files.groupBy(employer.alias("emp_id")).agg(F.sum(n_lines).alias("n"))


# --- ids and targets ------------------------------------------------------------------------
_ID_LINES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '  ' || CAST(user_id AS STRING) || ' ' WHEN 1 THEN '# ' || CAST(user_id AS STRING)
 WHEN 2 THEN '   ' ELSE CAST(user_id AS STRING) END AS value FROM events"""


@query(
    f"""SELECT trim(value) AS emp_id, min(event_id) AS event_id FROM ({_ID_LINES})
WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#') GROUP BY 1"""
)
def id_list(spark, sf):
    listed = ids.id_lines(run_sql(spark, sf, _ID_LINES))
    return ranking.first_occurrences(listed, "emp_id", "event_id")


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_custkey AS STRING) IN
 (SELECT CAST(user_id AS STRING) FROM events WHERE event_id % 4 IN (0, 3))"""
)
def employers_of_list(spark, sf):
    listed = ids.id_lines(run_sql(spark, sf, _ID_LINES)).select("emp_id").distinct()
    orders = run_sql(spark, sf, "SELECT o_orderkey, o_custkey, CAST(o_custkey AS STRING) AS emp_id FROM orders")
    return orders.join(listed, "emp_id", "left_semi").drop("emp_id")


_TARGETS = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' Primary-QA ' WHEN 1 THEN 'rep' WHEN 2 THEN 'PRODUCTION' WHEN 3 THEN 'both'
 WHEN 4 THEN NULL ELSE 'replicated-dev' END AS t FROM documents"""


@query(
    f"""SELECT doc_id, ['primary-qa', 'replicated-qa', 'prod', NULL, NULL, 'replicated-dev'][doc_id % 6 + 1] AS target,
 doc_id % 6 = 1 AS is_deprecated, CASE WHEN doc_id % 6 IN (3, 4) THEN 'unknown target ''' || coalesce(t, '') ||
 '''; valid: primary-dev, primary-qa, prod, production, replicated-dev, replicated-qa' END AS error FROM ({_TARGETS})"""
)
def resolve_targets(spark, sf):
    return run_sql(spark, sf, _TARGETS).select("doc_id", *ids.resolve_target(F.col("t")))
