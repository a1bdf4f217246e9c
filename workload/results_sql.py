"""Comparison results of the run's datasets as SQL, written apart from the engine."""

from __future__ import annotations

from workload.data import ctes, norm

_TAIL = """
SELECT emp_id, '{dataset}' AS dataset, match, match OR t = '' AS equivalent,
 CASE WHEN match THEN 'IDENTICAL' ELSE 'DIFFERENCES' END AS status, primary_rows, replicated_rows,
 n_primary_only, n_replicated_only, n_records_with_diffs,
 n_primary_only + n_replicated_only + n_records_with_diffs AS difference_count, has_old_data,
 CASE WHEN match THEN 'Perfect match' WHEN t = '' THEN 'Match' ELSE t END AS summary
FROM (SELECT *, concat_ws('; ', CASE WHEN primary_rows <> replicated_rows
 THEN 'Row count: Primary=' || primary_rows || ', Replicated=' || replicated_rows END, {messages}) AS t FROM c)"""

# Rows per employer and side, and the employers whose rows differ at all.
_COMMON = """
n AS (SELECT emp_id, sum(a)::BIGINT AS primary_rows, sum(b)::BIGINT AS replicated_rows FROM (
 SELECT emp_id, 1 AS a, 0 AS b FROM pp UNION ALL SELECT emp_id, 0, 1 FROM rr) GROUP BY emp_id),
u AS (SELECT DISTINCT emp_id FROM ((SELECT * FROM pp EXCEPT ALL SELECT * FROM rr)
 UNION ALL (SELECT * FROM rr EXCEPT ALL SELECT * FROM pp)))"""


def _msg(label: str, col: str) -> str:
    return f"CASE WHEN {col} > 0 THEN '{label}: ' || {col} END"


def _keyed(dataset, pp, rr, key, cols, normalise, noun, matching, old="", first=True):
    order = ", ".join(cols)
    pick = (
        "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY emp_id, {key} ORDER BY {order}) AS k"
        " FROM {side} WHERE {key} IS NOT NULL) WHERE k = 1"
    )
    differs = " OR ".join(
        f"{norm('f.' + c)} <> {norm('g.' + c)}" if normalise else f"f.{c} IS DISTINCT FROM g.{c}" for c in cols
    )
    has_old = "coalesce(old.is_old, false)" if old else "false"
    messages = [
        _msg(f"{noun} in primary but NOT in replicated", "n_primary_only"),
        _msg(f"{noun} in replicated but NOT in primary", "n_replicated_only"),
    ]
    if old:
        messages.append(
            "CASE WHEN has_old_data THEN 'Extra records contain OLD DATA (created before primary''s time range)' END"
        )
    messages.append(_msg(f"Matching {matching} with data differences", "n_records_with_diffs"))
    return f"""WITH {ctes(dataset)}, pp AS ({pp}), rr AS ({rr}), {_COMMON},
f AS ({pick.format(key=key, order=order, side='pp')}), g AS ({pick.format(key=key, order=order, side='rr')}),
j AS (SELECT coalesce(f.emp_id, g.emp_id) AS emp_id, f.{key} IS NOT NULL AS a, g.{key} IS NOT NULL AS b,
 f.{key} IS NOT NULL AND g.{key} IS NOT NULL AND ({differs}) AS d
 FROM f FULL JOIN g ON f.emp_id = g.emp_id AND f.{key} = g.{key}),
s AS (SELECT emp_id, count(*) FILTER (WHERE a AND NOT b) AS n_primary_only,
 count(*) FILTER (WHERE b AND NOT a) AS n_replicated_only, count(*) FILTER (WHERE d) AS n_records_with_diffs
 FROM j GROUP BY emp_id){old},
c AS (SELECT n.*, s.* EXCLUDE (emp_id), n.emp_id NOT IN (SELECT emp_id FROM u) AS match, {has_old} AS has_old_data
 FROM n JOIN s USING (emp_id) {'LEFT JOIN old USING (emp_id)' if old else ''})
{_TAIL.format(dataset=dataset, messages=', '.join(messages))}"""


def _users_side(side):
    return f"SELECT emp_id, row_number, full_name, {norm('gender')} AS gender, nation FROM {side}"


USERS = _keyed(
    "11-users.psv", _users_side("p"), _users_side("r"), "row_number", ["full_name", "gender", "nation"], False,
    "Records", "records",
)


def _issues_side(side):
    return f"SELECT emp_id, row_number, description, severity FROM {side}"


ISSUES = _keyed(
    "9-issues-potentials.psv", _issues_side("p"), _issues_side("r"), "row_number", ["description", "severity"], True,
    "Row_numbers", "row_numbers",
)


def _elig_side(side):
    return f"SELECT emp_id, TRY_CAST(id AS DOUBLE) AS id, plan, state FROM {side}"


_OLD = """, old AS (SELECT emp_id, x.lo < m.lo AS is_old FROM
 (SELECT emp_id, min(CAST(created_at AS DATE)) AS lo FROM p GROUP BY emp_id) m JOIN
 (SELECT emp_id, min(CAST(created_at AS DATE)) AS lo FROM r WHERE TRY_CAST(id AS DOUBLE) IS NOT NULL
  AND (emp_id, TRY_CAST(id AS DOUBLE)) NOT IN (SELECT (emp_id, TRY_CAST(id AS DOUBLE)) FROM p
  WHERE TRY_CAST(id AS DOUBLE) IS NOT NULL) GROUP BY emp_id) x USING (emp_id))"""
ELIGIBILITY = _keyed(
    "8b-eligibilities.psv", _elig_side("p"), _elig_side("r"), "id", ["plan", "state"], True, "Records", "records", _OLD
)

_E = "['execute_potential_resolution', 'execute_employer_setting']"
ACTIVITIES = f"""WITH {ctes('5a-activities-potential.psv')}, pp AS (SELECT * FROM p), rr AS (SELECT * FROM r), {_COMMON},
f AS (SELECT emp_id, row_number, bool_or(regexp_matches(lower(object_changes), 'is_dependent":\\s*true')) AS dep
 FROM (SELECT * FROM p UNION ALL SELECT * FROM r) GROUP BY ALL),
ps AS (SELECT emp_id, row_number, list(DISTINCT action) AS s FROM p GROUP BY ALL),
rs AS (SELECT emp_id, row_number, list(DISTINCT action) AS s FROM r GROUP BY ALL),
g AS (SELECT f.*, coalesce(ps.s, []) AS ps, coalesce(rs.s, []) AS rs,
 CASE WHEN dep THEN list_append({_E}, 'execute_dependent_setting') ELSE {_E} END AS e
 FROM f LEFT JOIN ps USING (emp_id, row_number) LEFT JOIN rs USING (emp_id, row_number)),
x AS (SELECT emp_id, row_number, len(list_distinct(list_concat(
  list_filter(ps, lambda a: NOT list_contains(rs, a) AND NOT (a = 'execute_dependent_setting' AND NOT dep)),
  CASE WHEN len(rs) > 0 AND NOT list_has_all(ps, e) AND emp_id IN (SELECT emp_id FROM u)
   THEN list_filter(e, lambda a: NOT list_contains(rs, a)) ELSE [] END))) AS m,
  len(list_filter(rs, lambda a: NOT list_contains(ps, a))) AS v FROM g),
s AS (SELECT emp_id, sum(m)::BIGINT AS n_primary_only, sum(v)::BIGINT AS n_replicated_only,
 count(*) FILTER (WHERE m + v > 0) AS n_groups FROM x GROUP BY emp_id),
c AS (SELECT n.*, s.* EXCLUDE (emp_id), CAST(0 AS BIGINT) AS n_records_with_diffs, false AS has_old_data,
 n.emp_id NOT IN (SELECT emp_id FROM u) AS match FROM n JOIN s USING (emp_id))
""" + _TAIL.format(
    dataset="5a-activities-potential.psv",
    messages=", ".join(
        [
            _msg("Missing actions in replicated", "n_primary_only"),
            _msg("Unexpected actions in replicated", "n_replicated_only"),
            _msg("Row numbers with action mismatches", "n_groups"),
        ]
    ),
)

_PART_COLS = ["p_name", "p_brand", "p_type", "p_size"]
_PART_RANK = "SELECT *, row_number() OVER (PARTITION BY emp_id ORDER BY " + ", ".join(_PART_COLS) + ") AS k FROM {s}"
PARTS = f"""WITH {ctes('15-potentials.psv')}, pp AS (SELECT * FROM p), rr AS (SELECT * FROM r), {_COMMON},
pos AS (SELECT a.emp_id, count(*) FILTER (WHERE {' OR '.join(f'a.{c} IS DISTINCT FROM b.{c}' for c in _PART_COLS)}) AS d
 FROM ({_PART_RANK.format(s='pp')}) a JOIN ({_PART_RANK.format(s='rr')}) b USING (emp_id, k) GROUP BY a.emp_id),
po AS (SELECT emp_id, count(*) AS v FROM (SELECT * FROM pp EXCEPT SELECT * FROM rr) GROUP BY emp_id),
ro AS (SELECT emp_id, count(*) AS v FROM (SELECT * FROM rr EXCEPT SELECT * FROM pp) GROUP BY emp_id),
bo AS (SELECT emp_id, count(*) AS v FROM (SELECT * FROM rr INTERSECT SELECT * FROM pp) GROUP BY emp_id),
q AS (SELECT n.*, n.emp_id NOT IN (SELECT emp_id FROM u) AS match, false AS has_old_data,
 primary_rows = replicated_rows AS eq, coalesce(pos.d, 0) AS d, coalesce(po.v, 0) AS a, coalesce(ro.v, 0) AS b,
 CASE WHEN coalesce(bo.v, 0) > 0 THEN greatest(least(primary_rows, replicated_rows) - bo.v, 0) ELSE 0 END AS e
 FROM n LEFT JOIN pos USING (emp_id) LEFT JOIN po USING (emp_id) LEFT JOIN ro USING (emp_id) LEFT JOIN bo USING (emp_id)),
c AS (SELECT emp_id, primary_rows, replicated_rows, match, has_old_data,
 CAST(CASE WHEN eq THEN 0 ELSE a END AS BIGINT) AS n_primary_only,
 CAST(CASE WHEN eq THEN 0 ELSE b END AS BIGINT) AS n_replicated_only,
 CAST(CASE WHEN eq THEN d ELSE e END AS BIGINT) AS n_records_with_diffs, eq FROM q)
""" + _TAIL.format(
    dataset="15-potentials.psv",
    messages=", ".join(
        [
            "CASE WHEN eq AND n_records_with_diffs > 0 THEN 'Rows with data differences: ' || n_records_with_diffs END",
            _msg("Records in primary but NOT in replicated", "n_primary_only"),
            _msg("Records in replicated but NOT in primary", "n_replicated_only"),
            "CASE WHEN NOT eq AND n_records_with_diffs > 0"
            " THEN 'Matching records with data differences: ' || n_records_with_diffs END",
        ]
    ),
)

BY_DATASET = {
    "11-users.psv": USERS,
    "9-issues-potentials.psv": ISSUES,
    "8b-eligibilities.psv": ELIGIBILITY,
    "5a-activities-potential.psv": ACTIVITIES,
    "15-potentials.psv": PARTS,
}
RUN_RESULTS = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in BY_DATASET.values())
