"""Derived inputs: one SQL text per table side, valid in Spark and in DuckDB unchanged."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as views."""
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def run_sql(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    """Run SQL over the Parquet tables that it names."""
    register(spark, sf_dir, *[t for t in TABLES if re.search(rf"\b{t}\b", text)])
    return spark.sql(text, args=args) if args else spark.sql(text)


def pair(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    p, r = PAIRS[name]
    return run_sql(spark, sf_dir, p), run_sql(spark, sf_dir, r)


def ctes(name: str) -> str:
    """``p`` and ``r`` as common table expressions."""
    p, r = PAIRS[name]
    return f"p AS ({p}), r AS ({r})"


# --- one pair without employers -----------------------------------------------------------
ORDERS_P = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus,
       o_orderpriority, o_totalprice
FROM orders"""
ORDERS_R = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 31 = 0 THEN 'X' WHEN o_orderkey % 37 = 0 THEN '' ELSE o_orderstatus END
         AS o_orderstatus,
       CASE WHEN o_orderkey % 41 = 0 THEN lower(replace(o_orderpriority, '-', '_')) ELSE o_orderpriority END
         AS o_orderpriority,
       o_totalprice
FROM orders WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_orderpriority, o_totalprice
FROM orders WHERE o_orderkey % 101 = 0"""

LINES_P = "SELECT l_returnflag, l_linestatus, l_linenumber, l_orderkey FROM lineitem"
LINES_R = """SELECT l_returnflag, l_linestatus, l_linenumber, l_orderkey
FROM lineitem WHERE l_partkey % 50 <> 0
UNION ALL SELECT l_returnflag, 'Z', l_linenumber, l_orderkey FROM lineitem WHERE l_partkey % 71 = 0"""
SHIFTED_R = """SELECT l_returnflag, CASE WHEN l_orderkey % 500 = 0 THEN 'Z' ELSE l_linestatus END AS l_linestatus,
       l_linenumber, l_orderkey FROM lineitem"""

# The pair (order, line number) is no key of lineitem, so several rows share one.
LINE_KEYS_P = "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey FROM lineitem"
LINE_KEYS_R = """SELECT l_orderkey, l_linenumber,
       CASE WHEN l_partkey % 29 = 0 THEN 'Q' ELSE l_returnflag END AS l_returnflag,
       CASE WHEN l_partkey % 31 = 0 THEN lower(l_linestatus) ELSE l_linestatus END AS l_linestatus,
       l_suppkey
FROM lineitem WHERE l_partkey % 61 <> 0"""

EVENTS_P = """SELECT user_id, CAST(ts AS DATE) AS day, event_type, props, event_id FROM events"""
EVENTS_R = """SELECT user_id, CAST(ts AS DATE) AS day, event_type, props, event_id FROM events
WHERE event_id % 13 <> 0
UNION ALL SELECT user_id, CAST(ts AS DATE) AS day, 'audit' AS event_type, props, event_id FROM events
WHERE event_id % 57 = 0"""

# --- datasets of a run, with employer 0 holding a third of the rows ------------------------
_EMP_NATION = "CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE c_nationkey END"
USERS_P = f"""SELECT {_EMP_NATION} AS emp_id, CAST(c_custkey AS STRING) AS row_number, c_name AS full_name,
       c_mktsegment AS gender, c_custkey AS id, CAST(c_nationkey AS STRING) AS nation FROM customer"""
USERS_R = f"""SELECT {_EMP_NATION} AS emp_id, CAST(c_custkey AS STRING) AS row_number,
       CASE WHEN c_custkey % 19 = 0 AND c_nationkey >= 4 THEN '' ELSE c_name END AS full_name,
       CASE WHEN c_custkey % 17 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS gender,
       c_custkey + 5 AS id, CAST(c_nationkey AS STRING) AS nation
FROM customer WHERE NOT (c_custkey % 23 = 0 AND c_nationkey >= 8)
UNION ALL
SELECT {_EMP_NATION} AS emp_id, CAST(c_custkey + 10000000 AS STRING), c_name, c_mktsegment, c_custkey,
       CAST(c_nationkey AS STRING)
FROM customer WHERE c_custkey % 29 = 0 AND c_nationkey >= 12"""

_EMP_SUPP = "CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE CAST(l_suppkey % 10 AS INT) END"
ISSUES_P = f"""SELECT {_EMP_SUPP} AS emp_id, CAST(l_orderkey * 10 + l_linenumber AS STRING) AS row_number,
       l_returnflag || '_' || l_linestatus AS description, CAST(l_linenumber AS STRING) AS severity,
       CAST(l_partkey AS STRING) AS issue_id FROM lineitem"""
ISSUES_R = f"""SELECT {_EMP_SUPP} AS emp_id, CAST(l_orderkey * 10 + l_linenumber AS STRING) AS row_number,
       CASE WHEN l_orderkey % 13 = 0 THEN lower(l_returnflag) || ' ' || lower(l_linestatus)
            WHEN l_orderkey % 41 = 0 AND l_suppkey % 10 >= 4 THEN 'changed'
            ELSE l_returnflag || '_' || l_linestatus END AS description,
       CAST(l_linenumber AS STRING) AS severity, CAST(l_partkey + 1 AS STRING) AS issue_id
FROM lineitem WHERE NOT (l_partkey % 53 = 0 AND l_suppkey % 10 >= 7)
UNION ALL
SELECT {_EMP_SUPP} AS emp_id, 'x' || CAST(l_orderkey AS STRING), l_returnflag, CAST(l_linenumber AS STRING),
       CAST(l_partkey AS STRING)
FROM lineitem WHERE l_partkey % 97 = 0 AND l_suppkey % 10 >= 8"""

_EMP_CUST = "CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE CAST(o_custkey % 10 AS INT) END"
_ELIG_ID = "CASE WHEN o_orderkey % 1009 = 7 THEN 'n/x' ELSE CAST(o_orderkey AS STRING) END"
ELIG_P = f"""SELECT {_EMP_CUST} AS emp_id, {_ELIG_ID} AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS created_at,
       o_orderpriority AS plan, o_orderstatus AS state FROM orders"""
ELIG_R = f"""SELECT {_EMP_CUST} AS emp_id, {_ELIG_ID} AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS created_at,
       CASE WHEN o_orderkey % 41 = 0 THEN lower(replace(o_orderpriority, '-', '_')) ELSE o_orderpriority END AS plan,
       CASE WHEN o_orderkey % 31 = 0 AND o_custkey % 10 >= 4 THEN '' ELSE o_orderstatus END AS state
FROM orders WHERE NOT (o_orderkey % 67 = 0 AND o_custkey % 10 >= 5)
UNION ALL
SELECT {_EMP_CUST} AS emp_id, CAST(o_orderkey + 100000000 AS STRING),
       CASE WHEN o_custkey % 10 = 7 THEN '1980-01-01' ELSE '2020-01-01' END, o_orderpriority, o_orderstatus
FROM orders WHERE o_orderkey % 101 = 0 AND o_custkey % 10 >= 6"""

_ACT = """CAST(user_id % 7 AS INT) AS emp_id,
       CAST(user_id * 100 + EXTRACT(DAY FROM ts) AS STRING) AS row_number"""
_ACT_REST = """CASE WHEN event_id % 11 = 0 THEN '{"is_dependent": true}' ELSE '{"is_dependent": false}' END
         AS object_changes,
       'F' || CAST(event_id % 5 AS STRING) AS first_name, 'L' || CAST(user_id AS STRING) AS last_name,
       CAST(CAST(ts AS DATE) AS STRING) AS born_on"""
_ACTION = """CASE event_type WHEN 'view' THEN 'execute_potential_resolution'
            WHEN 'click' THEN 'execute_employer_setting' WHEN 'purchase' THEN 'execute_dependent_setting'
            ELSE event_type END"""
ACTIONS_P = f"SELECT {_ACT}, {_ACTION} AS action, {_ACT_REST} FROM events"
ACTIONS_R = f"""SELECT {_ACT}, {_ACTION} AS action, {_ACT_REST} FROM events
WHERE NOT (event_id % 13 = 0 AND user_id % 7 >= 2)
UNION ALL
SELECT {_ACT}, 'extra_action' AS action, {_ACT_REST} FROM events WHERE event_id % 101 = 0 AND user_id % 7 >= 3"""

PARTS_P = """SELECT CAST(p_partkey % 6 AS INT) AS emp_id, p_name, p_brand, p_type, CAST(p_size AS STRING) AS p_size
FROM part"""
PARTS_R = """SELECT CAST(p_partkey % 6 AS INT) AS emp_id, p_name,
       CASE WHEN p_partkey % 50 = 0 AND p_partkey % 6 >= 1 THEN 'Brand#99' ELSE p_brand END AS p_brand,
       p_type, CAST(p_size AS STRING) AS p_size
FROM part WHERE NOT (p_partkey % 37 = 0 AND p_partkey % 6 >= 3)"""

PAIRS = {
    "orders": (ORDERS_P, ORDERS_R),
    "lines": (LINES_P, LINES_R),
    "shifted": (LINES_P, SHIFTED_R),
    "line_keys": (LINE_KEYS_P, LINE_KEYS_R),
    "events": (EVENTS_P, EVENTS_R),
    "11-users.psv": (USERS_P, USERS_R),
    "9-issues-potentials.psv": (ISSUES_P, ISSUES_R),
    "8b-eligibilities.psv": (ELIG_P, ELIG_R),
    "5a-activities-potential.psv": (ACTIONS_P, ACTIONS_R),
    "15-potentials.psv": (PARTS_P, PARTS_R),
}
RUN = [n for n in PAIRS if n.endswith(".psv")]

RULES_INI = """
[global_ignore_columns]
id = true
created_at = true
[file_specific_ignore_columns]
9-issues-potentials.psv = issue_id
5a-activities-potential.psv = object_changes
[exclude_files]
2-Excluded.psv = true
[normalize_columns]
11-users.psv = gender
[comparison_settings]
max_sample_differences = 5
"""

# Normalised text, as DuckDB writes it.
def norm(x: str) -> str:
    return (
        f"trim(translate(trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g')), '_-', '  '))"
    )
