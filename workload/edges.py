"""Cases that differ only at the edges: null employers, very long ids, old rows, large samples, types."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyframe.operators import equality, ranking
from tallyframe.plans.compare import compare_tables
from tallyframe.plans.rules import CompareRules
from tallyframe.plans.saved import compare_saved, save_side
from tallyframe.session import scratch_path
from tallyframe.sources.published import export_published, no_null_employer, published
from tallyframe.sources.sql import QueryTemplate, export_datasets
from workload.data import RULES_INI, ctes, pair, register, run_sql
from workload.registry import query
from workload.results_sql import ELIGIBILITY

RULES = CompareRules.from_ini(RULES_INI)

_NULL_P = "SELECT nullif(o_custkey % 5, 0) AS emp_id, o_orderkey AS row_number, o_orderstatus AS state FROM orders"
_NULL_R = """SELECT nullif(o_custkey % 5, 0) AS emp_id, o_orderkey AS row_number,
 CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 37 <> 0"""
_BY_EMPLOYER = f"""WITH p AS ({_NULL_P}), r AS ({_NULL_R}) SELECT p.emp_id, count(*) AS primary_rows, count(r.row_number) AS replicated_rows,
 count(*) FILTER (r.row_number IS NULL) AS n_primary_only, count(*) FILTER (p.state <> r.state) AS n_records_with_diffs,
 count(*) FILTER (r.row_number IS NULL OR p.state <> r.state) = 0 AS match
FROM p LEFT JOIN r ON p.row_number = r.row_number GROUP BY p.emp_id"""


def _null_employer(spark, sf, dataset):
    diff = compare_tables(run_sql(spark, sf, _NULL_P), run_sql(spark, sf, _NULL_R), dataset, by=["emp_id"])
    columns = ["primary_rows", "replicated_rows", "n_primary_only", "n_records_with_diffs", "match"]
    return diff.results.select("emp_id", *columns)


@query(_BY_EMPLOYER)
def compare_null_employer(spark, sf):
    """Rows without an employer are compared like those of any employer."""
    return _null_employer(spark, sf, "11-users.psv")


@query(_BY_EMPLOYER)
def issues_null_employer(spark, sf):
    return _null_employer(spark, sf, "9-issues-potentials.psv")


# Ids beyond the whole numbers that a double holds; other spellings of the same number; ids that are none.
_ID = "CAST(9007199254740992 + 2 * o_orderkey"
_IDS_P = f"SELECT CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey || 'd' ELSE {_ID} AS VARCHAR(40)) END AS id, o_comment_ AS note FROM o"
_IDS_R = f"""SELECT CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey || 'd' WHEN o_orderkey % 10 = 0 THEN {_ID} + 1 AS VARCHAR(40))
 WHEN o_orderkey % 10 = 1 THEN ' ' || {_ID} AS VARCHAR(40)) || '.0' ELSE {_ID} AS VARCHAR(40)) END AS id, o_comment_ AS note FROM o"""
_O = "WITH o AS (SELECT o_orderkey, o_orderpriority AS o_comment_ FROM orders)"


@query(
    """WITH t AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 3)
SELECT count(*) FILTER (o_orderkey % 10 = 0) AS n_primary_only, count(*) FILTER (o_orderkey % 10 = 0) AS n_replicated_only,
 0::BIGINT AS n_records_with_diffs, false AS match FROM t"""
)
def numeric_key_edge(spark, sf):
    """Ids are exact: neighbours above 2^53 are different ids, and 12d is none."""
    p, r = (run_sql(spark, sf, f"{_O} {side}") for side in (_IDS_P, _IDS_R))
    diff = compare_tables(p, r, "8b-eligibilities.psv")
    return diff.results.select("n_primary_only", "n_replicated_only", "n_records_with_diffs", "match")


# Numbers that no machine type holds, and other spellings of the same ones; the class of an order follows from its key.
_K = "lpad(CAST(o_orderkey AS VARCHAR(12)), 12, '0')"
_N = f"""SELECT o_orderkey % 10 AS c, o_orderkey % 20 = 17 AS odd, {_K} AS k FROM orders"""
_NUMBERS_P = f"""SELECT CASE c WHEN 0 THEN '1' || k || repeat('7', 28) || '1' WHEN 1 THEN '8' || k || repeat('3', 47)
 WHEN 2 THEN '2' || k || '.000000000001' WHEN 3 THEN '3' || k || 'e3' WHEN 4 THEN '4' || k || 'd' WHEN 5 THEN '  '
 WHEN 6 THEN '-6' || k || '.50' WHEN 8 THEN '-8' || k || '.00000000000000000000000000000000000000000000000000000000001'
 ELSE '9' || k END AS id, 'x' AS note FROM n"""
_NUMBERS_R = f"""SELECT CASE c WHEN 0 THEN '1' || k || repeat('7', 28) || '2' WHEN 1 THEN '+0008' || k || repeat('3', 47) || '.000'
 WHEN 2 THEN '2' || k || '.000000000002' WHEN 3 THEN '3' || k || '000.0' WHEN 4 THEN '4' || k || 'd' WHEN 5 THEN ''
 WHEN 6 THEN '-06' || k || '.5' WHEN 8 THEN '-8' || k || '.00000000000000000000000000000000000000000000000000000000002'
 ELSE '9' || k || '.0E+0' END AS id, CASE WHEN odd THEN 'y' ELSE 'x' END AS note FROM n"""


def _numbers(spark, sf):
    return compare_tables(
        *[run_sql(spark, sf, f"WITH n AS ({_N}) {side}") for side in (_NUMBERS_P, _NUMBERS_R)], "8b-eligibilities.psv"
    )


@query(
    f"""WITH n AS ({_N}) SELECT count(*) AS primary_rows, count(*) AS replicated_rows, count(*) FILTER (c IN (0, 2, 8)) AS n_primary_only,
 count(*) FILTER (c IN (0, 2, 8)) AS n_replicated_only, count(*) FILTER (odd) AS n_records_with_diffs, false AS match FROM n"""
)
def numeric_key_lengths(spark, sf):
    """Ids of 42 and 60 digits, 12 and 59 decimals, exponents, signs and outer zeros match exactly or not at all."""
    columns = ["primary_rows", "replicated_rows", "n_primary_only", "n_replicated_only", "n_records_with_diffs", "match"]
    return _numbers(spark, sf).results.select(*columns)


@query(
    f"""WITH n AS ({_N}), ids AS (
 SELECT presence, key, row_number() OVER (PARTITION BY presence ORDER BY rank, CASE rank WHEN 1 THEN -CAST(k AS BIGINT) ELSE CAST(k AS BIGINT) END) AS position FROM (
  SELECT k, CASE c WHEN 8 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank, s.presence,
   CASE c WHEN 0 THEN '1' || k || repeat('7', 28) || s.last WHEN 2 THEN '2' || k || '.00000000000' || s.last
    ELSE '-8' || k || '.' || repeat('0', 58) || s.last END AS key
  FROM n, (VALUES ('primary_only', '1'), ('replicated_only', '2')) s(presence, last) WHERE c IN (0, 2, 8)))
SELECT presence, position, key FROM ids WHERE position <= 20"""
)
def smallest_one_sided_numbers(spark, sf):
    """The 20 smallest ids that only one side has, by their numbers: negative ones first."""
    return _numbers(spark, sf).one_sided_keys.select("presence", "position", "key")


@query(
    f"""WITH {ctes("9-issues-potentials.psv")},
x AS (SELECT DISTINCT emp_id, row_number AS key, 'primary_only' AS presence FROM p
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.emp_id = p.emp_id AND r.row_number = p.row_number)
 UNION ALL SELECT DISTINCT emp_id, row_number, 'replicated_only' FROM r
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE r.emp_id = p.emp_id AND r.row_number = p.row_number))
SELECT emp_id, presence, key, row_number() OVER (PARTITION BY emp_id, presence ORDER BY CAST(key AS BIGINT)) AS position
FROM x WHERE regexp_full_match(key, '[0-9]+')"""
)
def one_sided_row_numbers(spark, sf):
    """All row numbers of issues that only one side has, numbered in their order; those that are no digits are left out."""
    diff = compare_tables(*pair(spark, sf, "9-issues-potentials.psv"), "9-issues-potentials.psv", by=["emp_id"])
    return diff.one_sided_keys.select("emp_id", "presence", "key", "position")


@query("SELECT CAST(year(o_orderdate) - 95 AS INT) AS y, count(*) AS n FROM orders GROUP BY 1")
def unbounded_lookback(spark, sf):
    """Without a lookback no row is too old."""
    register(spark, sf, "orders")
    template = QueryTemplate(
        """SELECT year(at) AS y, count(*) AS n FROM (SELECT add_months(o_orderdate, -1140) AS at FROM orders)
           WHERE at >= current_timestamp() - INTERVAL '{{time_interval}}' GROUP BY 1"""
    )
    return template.run(spark, 1, None, on_missing="unbounded")


@query(
    """SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS k
 FROM orders) WHERE k <= 1500"""
)
def large_samples(spark, sf):
    """A sample may be larger than what Spark limits inside tasks."""
    orders = run_sql(spark, sf, "SELECT o_orderstatus, o_orderkey FROM orders")
    return ranking.sample_per_group(orders, ["o_orderstatus"], [F.desc("o_orderkey")], 1500)


@query(
    """SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag
 ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 2000"""
)
def first_rows_of_large_groups(spark, sf):
    """The first rows of groups that are far larger: rows behind an estimated bound are not moved."""
    lines = run_sql(spark, sf, "SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber FROM lineitem")
    return ranking.sample_per_group(lines, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"], 2000)


@query("SELECT CAST(o_custkey % 4 AS INT) AS emp_id, count(*) AS n FROM orders WHERE o_custkey % 4 < 3 GROUP BY 1")
def export_by_employer(spark, sf):
    """An export of some employers leaves what earlier ones wrote."""
    register(spark, sf, "orders")
    out = scratch_path(spark, "exports")
    for first, last in ((0, 1), (2, 2)):
        employers = spark.sql(f"SELECT CAST(id AS INT) AS emp_id FROM range({first}, {last + 1})")
        text = {"orders": "SELECT CAST(o_custkey % 4 AS INT) AS emp_id, o_orderkey FROM orders"}
        status = export_datasets(spark, text, out, "primary", employers=employers)
        if status["orders"] != "ok":
            raise RuntimeError(status["orders"])
    return spark.read.parquet(f"{out}/dataset=orders/target=primary").groupBy("emp_id").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS primary_rows, count(*) AS replicated_rows, false AS match FROM orders")
def tables_equal_types(spark, sf):
    """The same values under another type are not the same table."""
    p = run_sql(spark, sf, "SELECT o_orderkey FROM orders")
    return equality.tables_equal(p, p.withColumn("o_orderkey", F.col("o_orderkey").cast("string")))


def _saved(spark, sf, dataset, changed=None):
    """Both sides of a dataset, stored with digests of their ranges."""
    out, (p, r) = scratch_path(spark, "sides"), pair(spark, sf, dataset)
    sides = (p, r if changed is None else changed(p))
    return [save_side(df, f"{out}/{n}", dataset, rules=RULES, by=["emp_id"], bits=4) for n, df in zip("pr", sides)]


_SAVED_COLUMNS = [
    "emp_id", "match", "primary_rows", "replicated_rows", "n_primary_only", "n_replicated_only", "n_records_with_diffs",
    "has_old_data", "summary",
]


@query(f"SELECT {', '.join(_SAVED_COLUMNS)} FROM ({ELIGIBILITY})")
def compare_saved_sides(spark, sf):
    """Stored sides give the results of a comparison in whole, from the ranges that differ."""
    sides = _saved(spark, sf, "8b-eligibilities.psv")
    return compare_saved(spark, *sides, "8b-eligibilities.psv", rules=RULES, by=["emp_id"]).results.select(*_SAVED_COLUMNS)


@query(
    f"""WITH {ctes("9-issues-potentials.psv")}, one AS (SELECT max(CAST(row_number AS BIGINT)) AS k FROM p)
SELECT p.emp_id, count(*) AS primary_rows, count(*) AS replicated_rows, count(DISTINCT CASE WHEN CAST(row_number AS BIGINT) = k THEN k END)
 AS n_records_with_diffs, count(*) FILTER (CAST(row_number AS BIGINT) = k) = 0 AS match FROM p, one GROUP BY p.emp_id"""
)
def compare_saved_one_change(spark, sf):
    """A side of which one row was changed, against the other: all employers but one are told equal by their digests."""
    dataset = "9-issues-potentials.psv"

    def changed(p):
        last = p.agg(F.max(F.col("row_number").cast("bigint")).cast("string").alias("last"))
        marked = p.crossJoin(last).withColumn("severity", F.when(F.col("row_number") == F.col("last"), "9").otherwise(F.col("severity")))
        return marked.drop("last")

    diff = compare_saved(spark, *_saved(spark, sf, dataset, changed), dataset, rules=RULES, by=["emp_id"])
    return diff.results.select("emp_id", "primary_rows", "replicated_rows", "n_records_with_diffs", "match")


@query(
    """SELECT CAST(o_custkey % 4 AS INT) AS emp_id, CASE WHEN o_custkey % 4 = 2 THEN 'third' ELSE 'first' END AS version, count(*) AS n,
 CASE WHEN o_custkey % 4 = 2 THEN '01-03-24 0800' ELSE '01-01-24 0800' END AS run_stamp FROM orders GROUP BY ALL"""
)
def published_exports(spark, sf):
    """An export is seen whole or not at all: the second fails while it writes, the third holds one employer, the fourth fails its audit."""
    register(spark, sf, "orders")
    out, text = scratch_path(spark, "published"), "SELECT CAST(o_custkey % 4 AS INT) AS emp_id, o_orderkey, '{}' AS version FROM orders"
    late = text.format("second") + " WHERE o_orderkey > 0 AND (o_custkey % 4 < 3 OR raise_error('lost'))"
    no_employer = text.format("fourth") + " UNION ALL SELECT NULL, 0, 'fourth'"
    one = spark.sql("SELECT CAST(2 AS INT) AS emp_id")
    found = []
    for day, (query_text, employers, audits) in enumerate(
        [(text.format("first"), None, ()), (late, None, ()), (text.format("third"), one, ()), (no_employer, None, (no_null_employer(),))], 1
    ):
        status = export_published(spark, {"orders": query_text}, out, "primary", datetime(2024, 1, day, 8), "emp_id", employers, audits=audits)
        found.append(status["orders"] == "ok")
    if found != [True, False, True, False]:
        raise RuntimeError(f"unexpected outcome of exports: {found}")
    rows = published(spark, f"{out}/dataset=orders/target=primary", with_run=True)
    return rows.groupBy("emp_id", "version", "run_stamp").agg(F.count("*").alias("n"))
