"""Queries of the difference operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import labels, text, values
from tallyframe.operators import cells, equality, groups, keys, positional, ranking, schema
from workload.data import ctes, norm, pair, run_sql
from workload.registry import query

ORDER_COLS = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
LINE_COLS = ["l_returnflag", "l_linestatus", "l_suppkey"]


def _orders(spark, sf):
    return cells.pair_by_key(*pair(spark, sf, "orders"), ["o_orderkey"])


def _cells_sql(name, key, cols, normalise=None, source=None):
    """Cell differences of a pair as SQL: every column on its own, under each other."""
    on = " AND ".join(f"p.{k} = r.{k}" for k in key)
    ks = ", ".join(f"p.{k} AS {k}" for k in key)
    parts = []
    for c in cols:
        a, b = f"CAST(p.{c} AS STRING)", f"CAST(r.{c} AS STRING)"
        ea, eb = (normalise(a), normalise(b)) if normalise else (f"coalesce({a}, '')", f"coalesce({b}, '')")
        differs = f"{ea} <> {eb}" if normalise else f"p.{c} IS DISTINCT FROM r.{c}"
        parts.append(
            f"SELECT {ks}, '{c}' AS \"column\", {a} AS primary_value, {b} AS replicated_value,"
            f" CASE WHEN {ea} <> '' AND {eb} = '' THEN 'primary_only_value'"
            f" WHEN {ea} = '' AND {eb} <> '' THEN 'replicated_only_value' ELSE 'both_differ' END AS diff_class"
            f" FROM p JOIN r ON {on} WHERE {differs}"
        )
    head = f"WITH {source or ctes(name)}, cells AS ({' UNION ALL '.join(parts)}) "
    return head


_COLUMN_COUNTS = """SELECT "column", count(*) AS n_records,
 count(*) FILTER (WHERE diff_class = 'primary_only_value') AS n_primary_only_value,
 count(*) FILTER (WHERE diff_class = 'replicated_only_value') AS n_replicated_only_value,
 count(*) FILTER (WHERE diff_class = 'both_differ') AS n_both_differ
FROM cells GROUP BY "column" """
_TEXT_COLS = ["o_orderstatus", "o_orderpriority"]


@query(_cells_sql("orders", ["o_orderkey"], ORDER_COLS) + _COLUMN_COUNTS)
def keyed_column_diffs(spark, sf):
    return cells.column_diffs(cells.keyed_stats(_orders(spark, sf), ORDER_COLS))


@query(_cells_sql("orders", ["o_orderkey"], _TEXT_COLS, norm) + _COLUMN_COUNTS)
def keyed_column_diffs_normalized(spark, sf):
    stats = cells.keyed_stats(_orders(spark, sf), _TEXT_COLS, normalize=text.normalize_text)
    return cells.column_diffs(stats)


@query(
    _cells_sql("orders", ["o_orderkey"], _TEXT_COLS, lambda x: f"translate(lower(coalesce({x}, '')), '_', '-')")
    + _COLUMN_COUNTS
)
def custom_normalizer(spark, sf):
    """A caller's own normaliser is a function from column to column."""
    stats = cells.keyed_stats(
        _orders(spark, sf),
        _TEXT_COLS,
        normalize=lambda c: F.translate(F.lower(F.coalesce(c, F.lit(""))), "_", "-"),
    )
    return cells.column_diffs(stats)


@query(_cells_sql("orders", ["o_orderkey"], _TEXT_COLS) + "SELECT * FROM cells")
def cell_diffs(spark, sf):
    return cells.cell_diffs(_orders(spark, sf), ["o_orderkey"], _TEXT_COLS)


@query(
    _cells_sql("orders", ["o_orderkey"], ORDER_COLS)
    + """SELECT (SELECT count(*) FROM p) AS primary_rows, (SELECT count(*) FROM r) AS replicated_rows,
 (SELECT count(*) FROM p WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)) AS n_primary_only,
 (SELECT count(*) FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p)) AS n_replicated_only,
 (SELECT count(*) FROM p JOIN r USING (o_orderkey)) AS n_common,
 (SELECT count(DISTINCT o_orderkey) FROM cells) AS n_records_with_diffs"""
)
def records_with_diffs(spark, sf):
    stats = cells.keyed_stats(_orders(spark, sf), ORDER_COLS)
    return stats.select(
        "primary_rows", "replicated_rows", "n_primary_only", "n_replicated_only", "n_common",
        "n_records_with_diffs",
    )


_PRESENCE = """CASE WHEN p.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL THEN 'both'
 WHEN p.o_orderkey IS NOT NULL THEN 'primary_only' ELSE 'replicated_only' END"""


@query(
    f"""WITH {ctes('orders')} SELECT coalesce(p.o_orderkey, r.o_orderkey) AS o_orderkey, {_PRESENCE} AS presence
FROM p FULL JOIN r ON p.o_orderkey = r.o_orderkey"""
)
def key_presence(spark, sf):
    return keys.key_presence(*pair(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "presence")


@query(f"WITH {ctes('orders')} SELECT * FROM p WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)")
def rows_only_in_primary(spark, sf):
    p, r = pair(spark, sf, "orders")
    return keys.rows_without_keys(p, r, ["o_orderkey"])


@query(f"WITH {ctes('orders')} SELECT * FROM r WHERE o_orderkey IN (SELECT o_orderkey FROM p)")
def rows_with_known_keys(spark, sf):
    p, r = pair(spark, sf, "orders")
    return keys.rows_with_keys(r, p, ["o_orderkey"])


_FIRST = """f{s} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_returnflag, l_linestatus, l_suppkey) AS rn FROM {s}0) WHERE rn = 1)"""
_FIRST_SOURCE = (
    ctes("line_keys").replace("p AS (", "p0 AS (", 1).replace(", r AS (", ", r0 AS (", 1)
    + ", " + _FIRST.format(s="p").replace("fp AS", "p AS") + ", " + _FIRST.format(s="r").replace("fr AS", "r AS")
)


@query(
    _cells_sql("line_keys", ["l_orderkey", "l_linenumber"], LINE_COLS, norm, _FIRST_SOURCE) + _COLUMN_COUNTS
)
def first_per_key_diff(spark, sf):
    paired = cells.pair_by_key(
        *pair(spark, sf, "line_keys"), ["l_orderkey", "l_linenumber"], LINE_COLS, dedup="first",
        track_equality=False,
    )
    return cells.column_diffs(cells.keyed_stats(paired, LINE_COLS, normalize=text.normalize_text))


@query(
    "WITH p0 AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey FROM lineitem), "
    + _FIRST.format(s="p")
    + " SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_suppkey FROM fp"
)
def first_row_per_key(spark, sf):
    p, _ = pair(spark, sf, "line_keys")
    return keys.first_per_key(p, ["l_orderkey", "l_linenumber"])


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
)
def duplicate_keys(spark, sf):
    return keys.duplicate_keys(run_sql(spark, sf, "SELECT * FROM lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    f"""WITH {ctes('line_keys')}, u AS (SELECT *, 1 AS a, 0 AS b FROM p UNION ALL SELECT *, 0, 1 FROM r),
k AS (SELECT l_suppkey, l_orderkey, l_linenumber, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL)
SELECT l_suppkey, count(*) FILTER (WHERE a > 1) AS n_duplicate_primary,
 count(*) FILTER (WHERE b > 1) AS n_duplicate_replicated,
 count(*) FILTER (WHERE a > 1 OR b > 1) = 0 AS is_unique FROM k GROUP BY l_suppkey"""
)
def key_uniqueness(spark, sf):
    return keys.key_uniqueness(
        *pair(spark, sf, "line_keys"), ["l_orderkey", "l_linenumber"], by=["l_suppkey"]
    )


@query(
    f"""WITH {ctes('lines')},
a AS (SELECT *, 'primary_only' AS presence FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM r)),
b AS (SELECT *, 'replicated_only' AS presence FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM p))
SELECT l_returnflag, l_linestatus, l_linenumber, l_orderkey, presence, count(*) AS surplus
FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL"""
)
def multiset_diff(spark, sf):
    return equality.multiset_diff(*pair(spark, sf, "lines"))


@query(
    f"""WITH {ctes('lines')}
SELECT *, 'primary_only' AS presence FROM (SELECT * FROM p EXCEPT SELECT * FROM r)
UNION ALL SELECT *, 'replicated_only' AS presence FROM (SELECT * FROM r EXCEPT SELECT * FROM p)"""
)
def distinct_diff(spark, sf):
    return equality.distinct_diff(*pair(spark, sf, "lines"))


@query(
    f"""WITH {ctes('lines')}, n AS (SELECT (SELECT count(*) FROM p) AS primary_rows,
 (SELECT count(*) FROM r) AS replicated_rows,
 (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM r)) AS n_primary_only,
 (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM p)) AS n_replicated_only,
 (SELECT count(*) FROM (SELECT * FROM r INTERSECT SELECT * FROM p)) AS n_both)
SELECT *, CAST(CASE WHEN n_both > 0 THEN greatest(least(primary_rows, replicated_rows) - n_both, 0) ELSE 0 END
 AS BIGINT) AS n_matching_with_diffs FROM n"""
)
def distinct_merge_summary(spark, sf):
    counts = equality.multiset_counts(*pair(spark, sf, "lines"))
    return equality.distinct_merge_summary(counts).drop("n_unbalanced")


def _positions(by=()):
    cols = ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"]
    own = [c for c in cols if c not in by]
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    ranked = ", ".join(
        f"{s}n AS (SELECT *, row_number() OVER ({part}ORDER BY {', '.join(own)}) AS position FROM {s})"
        for s in "pr"
    )
    on = " AND ".join(f"pn.{c} = rn.{c}" for c in [*by, "position"])
    differs = " OR ".join(f"pn.{c} IS DISTINCT FROM rn.{c}" for c in own)
    return f"WITH {ctes('shifted')}, {ranked}, d AS (SELECT pn.*, {', '.join(f'rn.{c} AS r_{c}' for c in own)}," \
           f" ({differs}) AS differs FROM pn JOIN rn ON {on}) "


@query(
    _positions() + """SELECT count(*) AS primary_rows, count(*) AS replicated_rows,
 count(*) FILTER (WHERE differs) AS n_different FROM d"""
)
def positional_diff(spark, sf):
    return positional.positional_summary(positional.positional_runs(*pair(spark, sf, "shifted")))


@query(
    _positions(["l_returnflag"]) + """SELECT l_returnflag, count(*) AS primary_rows, count(*) AS replicated_rows,
 count(*) FILTER (WHERE differs) AS n_different FROM d GROUP BY l_returnflag"""
)
def positional_diff_by_group(spark, sf):
    by = ["l_returnflag"]
    return positional.positional_summary(positional.positional_runs(*pair(spark, sf, "shifted"), by), by)


@query(
    _positions(["l_returnflag"]) + """SELECT l_returnflag, position, l_linestatus AS p_linestatus,
 l_linenumber AS p_linenumber, l_orderkey AS p_orderkey, r_l_linestatus AS r_linestatus,
 r_l_linenumber AS r_linenumber, r_l_orderkey AS r_orderkey FROM (SELECT *, row_number() OVER (
 PARTITION BY l_returnflag ORDER BY position) AS k FROM d WHERE differs) WHERE k <= 5"""
)
def positional_sample_rows(spark, sf):
    by = ["l_returnflag"]
    runs = positional.positional_runs(*pair(spark, sf, "shifted"), by)
    cols = ["linestatus", "linenumber", "orderkey"]
    return positional.positional_samples(runs, 5, by).select(
        *by,
        "position",
        *[F.col(f"primary.l_{c}").alias(f"p_{c}") for c in cols],
        *[F.col(f"replicated.l_{c}").alias(f"r_{c}") for c in cols],
    )


# A few rows are gone, a few are new and a few changed, far from each other: every position behind the first differs.
_ALIGNED_P = "SELECT l_returnflag, l_linestatus, l_linenumber, l_orderkey, l_partkey FROM lineitem"
_ALIGNED_R = """SELECT l_returnflag, l_linestatus, l_linenumber, CASE WHEN l_orderkey % 997 = 5 THEN -l_orderkey ELSE l_orderkey END
 AS l_orderkey, CASE WHEN l_partkey % 89 = 1 THEN l_partkey + 100000 ELSE l_partkey END AS l_partkey FROM lineitem WHERE l_orderkey % 701 <> 3
UNION ALL SELECT l_returnflag, l_linestatus, l_linenumber, l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 1009 = 7
UNION ALL SELECT NULL, 'A', 1, -1, 1"""
_ALIGNED_COLS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey", "l_partkey"]


def _aligned(by):
    """Surplus rows with their gap and place, by windows over all distinct rows."""
    cols = ", ".join(_ALIGNED_COLS)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    order = ", ".join(f"{c} NULLS FIRST" for c in _ALIGNED_COLS)
    return f"""WITH c AS (SELECT {cols}, sum(p) AS p, sum(1 - p) AS r FROM (SELECT *, 1 AS p FROM ({_ALIGNED_P})
 UNION ALL SELECT *, 0 FROM ({_ALIGNED_R})) GROUP BY ALL),
g AS (SELECT *, sum(CASE WHEN least(p, r) > 0 THEN 1 ELSE 0 END) OVER ({part} ORDER BY {order}) AS gap FROM c),
s AS (SELECT {cols}, gap, greatest(p - r, 0) AS a, greatest(r - p, 0) AS b FROM g WHERE p <> r),
gaps AS (SELECT {', '.join([*by, 'gap'])}, sum(a) AS a, sum(b) AS b FROM s GROUP BY ALL) """


def _aligned_rows(spark, sf, by=()):
    p, r = (run_sql(spark, sf, side) for side in (_ALIGNED_P, _ALIGNED_R))
    return positional.aligned_rows(equality.multiset_counts(p, r), by)


@query(
    _aligned([]) + """SELECT sum(least(a, b))::BIGINT AS n_changed, sum(greatest(a - b, 0))::BIGINT AS n_primary_extra,
 sum(greatest(b - a, 0))::BIGINT AS n_replicated_extra FROM gaps"""
)
def aligned_diff(spark, sf):
    """Differences of two sorted sides that an inserted row does not multiply."""
    return positional.aligned_summary(_aligned_rows(spark, sf))


@query(
    _aligned(["l_returnflag"]) + """SELECT l_returnflag, sum(least(a, b))::BIGINT AS n_changed, sum(greatest(a - b, 0))::BIGINT AS n_primary_extra,
 sum(greatest(b - a, 0))::BIGINT AS n_replicated_extra FROM gaps GROUP BY l_returnflag"""
)
def aligned_diff_by_group(spark, sf):
    by = ["l_returnflag"]
    return positional.aligned_summary(_aligned_rows(spark, sf, by), by)


@query(
    _aligned([]) + """, u AS (SELECT *, row_number() OVER (PARTITION BY gap, side ORDER BY l_returnflag NULLS FIRST, l_linestatus, l_linenumber,
  l_orderkey, l_partkey) - 1 AS place FROM (SELECT *, 'p' AS side, unnest(range(a::BIGINT)) AS copy FROM s
  UNION ALL SELECT *, 'r', unnest(range(b::BIGINT)) FROM s)),
 j AS (SELECT gap, place, max(CASE WHEN side = 'p' THEN l_orderkey END) AS p_orderkey, max(CASE WHEN side = 'r' THEN l_orderkey END) AS r_orderkey,
  max(CASE WHEN side = 'p' THEN l_partkey END) AS p_partkey, max(CASE WHEN side = 'r' THEN l_partkey END) AS r_partkey FROM u GROUP BY gap, place)
SELECT gap::BIGINT AS gap, place, p_orderkey, r_orderkey, p_partkey, r_partkey FROM j ORDER BY gap, place LIMIT 50"""
)
def aligned_sample_rows(spark, sf):
    """The first 50 differences, place by place."""
    pairs = positional.aligned_samples(_aligned_rows(spark, sf), 50)
    cells_of = [F.col(f"{side}.l_{c}").alias(f"{side[0]}_{c}") for c in ("orderkey", "partkey") for side in ("primary", "replicated")]
    return pairs.select("gap", "place", *cells_of)


_EQUAL = """SELECT l_returnflag, l_linestatus, l_linenumber, l_orderkey FROM lineitem
WHERE l_returnflag <> 'R' UNION ALL SELECT l_returnflag, 'Z', l_linenumber, l_orderkey
FROM lineitem WHERE l_returnflag = 'R'"""


@query(
    f"""WITH p AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_orderkey FROM lineitem), r AS ({_EQUAL}),
d AS ((SELECT * FROM p EXCEPT ALL SELECT * FROM r) UNION ALL (SELECT * FROM r EXCEPT ALL SELECT * FROM p))
SELECT l_returnflag, (SELECT count(*) FROM p WHERE p.l_returnflag = g.l_returnflag) AS primary_rows,
 (SELECT count(*) FROM r WHERE r.l_returnflag = g.l_returnflag) AS replicated_rows,
 l_returnflag NOT IN (SELECT l_returnflag FROM d) AS match FROM (SELECT DISTINCT l_returnflag FROM p) g"""
)
def tables_equal(spark, sf):
    p, _ = pair(spark, sf, "lines")
    return equality.tables_equal(p, run_sql(spark, sf, _EQUAL), ["l_returnflag"])


@query(
    f"""WITH p AS (SELECT l_returnflag, l_linestatus, l_linenumber, l_orderkey FROM lineitem), r AS ({_EQUAL})
SELECT l_returnflag, count(*) AS n_rows, l_returnflag <> 'R' AS is_same FROM p GROUP BY l_returnflag"""
)
def table_digests(spark, sf):
    by = ["l_returnflag"]
    p, _ = pair(spark, sf, "lines")
    a = equality.table_digest(p, by)
    b = equality.table_digest(run_sql(spark, sf, _EQUAL), by)
    parts = ["n_rows", "digest_hi", "digest_mid", "digest_lo"]
    same = F.struct(*[F.col(f"a.{c}") for c in parts]).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in parts]))
    return a.alias("a").join(b.alias("b"), by).select(*by, "a.n_rows", same.alias("is_same"))


@query(
    f"""WITH {ctes('lines')} SELECT l_returnflag, sum(a)::BIGINT AS primary_rows, sum(b)::BIGINT AS replicated_rows,
 CASE WHEN sum(a) <> sum(b) THEN 'Row count: Primary=' || sum(a) || ', Replicated=' || sum(b) ELSE '' END AS message
FROM (SELECT l_returnflag, 1 AS a, 0 AS b FROM p UNION ALL SELECT l_returnflag, 0, 1 FROM r) GROUP BY l_returnflag"""
)
def row_counts(spark, sf):
    totals = equality.row_counts(*pair(spark, sf, "lines"), by=["l_returnflag"])
    different = F.col("primary_rows") != F.col("replicated_rows")
    message = F.format_string("Row count: Primary=%d, Replicated=%d", "primary_rows", "replicated_rows")
    return totals.withColumn("message", F.when(different, message).otherwise(""))


# --- numeric keys and old data --------------------------------------------------------------
_CUST_P = "SELECT substr(c_name, 10) AS id, c_mktsegment, c_acctbal FROM customer"
_CUST_R = """SELECT CASE WHEN c_custkey % 83 = 0 THEN 'n/x' ELSE CAST(c_custkey AS STRING) END AS id,
 CASE WHEN c_custkey % 17 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer
 WHERE c_custkey % 59 <> 0"""


@query(
    f"""WITH p AS (SELECT TRY_CAST(id AS DOUBLE) AS id, c_mktsegment FROM ({_CUST_P})),
r AS (SELECT TRY_CAST(id AS DOUBLE) AS id, c_mktsegment FROM ({_CUST_R})),
c AS (SELECT id FROM p JOIN r USING (id) WHERE p.c_mktsegment <> r.c_mktsegment)
SELECT (SELECT count(*) FROM p) AS primary_rows, (SELECT count(*) FROM r) AS replicated_rows,
 (SELECT count(*) FROM p ANTI JOIN r USING (id)) AS n_primary_only,
 (SELECT count(*) FROM r ANTI JOIN p USING (id) WHERE id IS NOT NULL) AS n_replicated_only,
 (SELECT count(*) FROM c) AS n_records_with_diffs"""
)
def numeric_key_diff(spark, sf):
    p, r = (
        run_sql(spark, sf, q).select(values.try_number(F.col("id")).alias("id"), "c_mktsegment")
        for q in (_CUST_P, _CUST_R)
    )
    stats = cells.keyed_stats(cells.pair_by_key(p, r, ["id"], dedup="first"), ["c_mktsegment"])
    return stats.select(
        "primary_rows", "replicated_rows", "n_primary_only", "n_replicated_only", "n_records_with_diffs"
    )


_OLD_P = "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders"
_OLD_R = """SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 9 <> 0
UNION ALL SELECT o_orderkey + 100000000, o_orderstatus,
 CASE WHEN o_orderpriority = '1-URGENT' THEN CAST('1980-01-01 00:00:00' AS TIMESTAMP) ELSE o_orderdate END,
 o_orderpriority FROM orders WHERE o_orderkey % 11 = 0"""


@query(
    f"""WITH p AS ({_OLD_P}), r AS ({_OLD_R}), x AS (SELECT o_orderpriority, min(o_orderdate) AS lo FROM r
 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p) GROUP BY 1),
m AS (SELECT o_orderpriority, min(o_orderdate) AS lo FROM p GROUP BY 1)
SELECT o_orderpriority, coalesce(x.lo < m.lo, false) AS has_old_data FROM m LEFT JOIN x USING (o_orderpriority)"""
)
def old_data_flag(spark, sf):
    p, r = (
        run_sql(spark, sf, q).withColumn("seen_at", values.try_time(F.col("o_orderdate"))) for q in (_OLD_P, _OLD_R)
    )
    by = ["o_orderpriority"]
    paired = cells.pair_by_key(p, r, [*by, "o_orderkey"], ["o_orderstatus"], "first", "seen_at", False)
    stats = cells.keyed_stats(paired, [], by)
    return stats.select(*by, cells.old_data(stats).alias("has_old_data"))


# --- groups ---------------------------------------------------------------------------------
GROUP = ["user_id", "day"]
_EXPECT = {"expected": ["view", "click"], "expected_if_flagged": ["purchase"], "optional_unless_flagged": ["purchase"]}


def _is_flagged():
    return F.get_json_object("props", "$.k").cast("int") >= 50


_SETS = f"""WITH {ctes('events')},
f AS (SELECT user_id, day, bool_or(CAST(json_extract_string(props, '$.k') AS INT) >= 50) AS is_flagged
 FROM (SELECT * FROM p UNION ALL SELECT * FROM r) GROUP BY ALL),
ps AS (SELECT user_id, day, list(DISTINCT event_type) AS s FROM p GROUP BY ALL),
rs AS (SELECT user_id, day, list(DISTINCT event_type) AS s FROM r GROUP BY ALL),
g AS (SELECT f.*, coalesce(ps.s, []) AS ps, coalesce(rs.s, []) AS rs,
 CASE WHEN is_flagged THEN ['view', 'click', 'purchase'] ELSE ['view', 'click'] END AS e
 FROM f LEFT JOIN ps USING (user_id, day) LEFT JOIN rs USING (user_id, day)),
x AS (SELECT user_id, day, is_flagged, unnest(list_distinct(list_concat(
  list_filter(ps, lambda a: NOT list_contains(rs, a) AND NOT (a = 'purchase' AND NOT is_flagged)),
  CASE WHEN len(rs) > 0 AND NOT list_has_all(ps, e) THEN list_filter(e, lambda a: NOT list_contains(rs, a)) ELSE [] END
 ))) AS item, 'missing' AS kind FROM g
 UNION ALL SELECT user_id, day, is_flagged, unnest(list_filter(rs, lambda a: NOT list_contains(ps, a))), 'unexpected' FROM g) """


def _set_diff(spark, sf, **more):
    return groups.group_set_diff(
        *pair(spark, sf, "events"), GROUP, "event_type", flag=_is_flagged, **_EXPECT, **more
    )


@query(_SETS + "SELECT user_id, day, item, kind, is_flagged FROM x")
def group_set_diff(spark, sf):
    return _set_diff(spark, sf)


@query(
    _SETS + """, fp AS (SELECT user_id, day, arg_min(event_id, (event_type, props, event_id)) AS a FROM p GROUP BY ALL),
fr AS (SELECT user_id, day, arg_min(event_id, (event_type, props, event_id)) AS b FROM r GROUP BY ALL)
SELECT user_id, day, item, kind, is_flagged, CASE WHEN kind = 'missing' THEN coalesce(a, b) ELSE b END AS info_event_id
FROM x LEFT JOIN fp USING (user_id, day) LEFT JOIN fr USING (user_id, day)"""
)
def group_set_info(spark, sf):
    return _set_diff(spark, sf, info_cols=["event_id"])


@query(
    _SETS + """SELECT is_flagged, count(*) FILTER (WHERE kind = 'missing') AS n_missing,
 count(*) FILTER (WHERE kind = 'unexpected') AS n_unexpected, count(DISTINCT (user_id, day)) AS n_groups
FROM x GROUP BY is_flagged"""
)
def group_set_totals(spark, sf):
    return groups.group_set_totals(_set_diff(spark, sf), GROUP, by=["is_flagged"])


_ONE_SIDE = """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, props, event_id FROM events),
f AS (SELECT user_id, day, bool_or(CAST(json_extract_string(props, '$.k') AS INT) >= 50) AS is_flagged,
 list(DISTINCT event_type) AS s FROM p GROUP BY ALL)
SELECT user_id, day, unnest(list_filter(CASE WHEN is_flagged THEN ['view', 'click', 'purchase'] ELSE ['view', 'click'] END,
 lambda a: NOT list_contains(s, a))) AS item, 'missing' AS kind, is_flagged FROM f"""


@query(_ONE_SIDE)
def expected_items_of_equal_tables(spark, sf):
    """With ``always_check_expected`` even two equal tables report lacking expected items."""
    p, _ = pair(spark, sf, "events")
    return groups.group_set_diff(
        p, p, GROUP, "event_type", flag=_is_flagged, always_check_expected=True, **_EXPECT
    )


@query(
    """SELECT user_id, day, arg_min(event_type, (event_type, props, event_id)) AS event_type,
 arg_min(event_id, (event_type, props, event_id)) AS event_id
FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type, props, event_id FROM events) GROUP BY ALL"""
)
def first_row_info(spark, sf):
    p, _ = pair(spark, sf, "events")
    return groups.first_row_info(p, GROUP, ["event_type", "event_id", "absent"])


@query(
    _SETS + """SELECT is_flagged, kind, user_id, day, item FROM (SELECT *, row_number() OVER (
 PARTITION BY is_flagged, kind ORDER BY user_id, day, item) AS k FROM x) WHERE k <= 10"""
)
def first_missing_items(spark, sf):
    return ranking.sample_per_group(
        _set_diff(spark, sf), ["is_flagged", "kind"], ["user_id", "day", "item"], 10
    ).select("is_flagged", "kind", "user_id", "day", "item")


# --- samples and top lists ------------------------------------------------------------------
@query(
    _cells_sql("orders", ["o_orderkey"], _TEXT_COLS)
    + """SELECT "column", o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey)
 AS k FROM cells) WHERE k <= 10"""
)
def differing_key_samples(spark, sf):
    found = cells.cell_diffs(_orders(spark, sf), ["o_orderkey"], _TEXT_COLS)
    return cells.key_samples(found, ["o_orderkey"], 10)


@query(
    f"""WITH {ctes('orders')}, x AS (SELECT o_orderkey, o_custkey, 'primary_only' AS presence FROM p
 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r) UNION ALL SELECT o_orderkey, o_custkey, 'replicated_only' FROM r
 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p))
SELECT o_orderkey, presence, '{{"o_custkey":' || o_custkey || '}}' AS record FROM (SELECT *, row_number() OVER (
 PARTITION BY presence ORDER BY o_orderkey) AS k FROM x) WHERE k <= 5"""
)
def one_sided_records(spark, sf):
    paired = cells.pair_by_key(*pair(spark, sf, "orders"), ["o_orderkey"], ["o_custkey"])
    return cells.one_sided_samples(paired, ["o_orderkey"], 5)


@query(
    f"""WITH {ctes('orders')}, x AS (SELECT o_orderkey, 'primary_only' AS presence FROM p
 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r) UNION ALL SELECT o_orderkey, 'replicated_only' FROM r
 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p))
SELECT o_orderkey, presence FROM (SELECT *, row_number() OVER (PARTITION BY presence ORDER BY o_orderkey) AS k FROM x)
WHERE k <= 20"""
)
def smallest_one_sided_keys(spark, sf):
    found = cells.pair_presence(_orders(spark, sf), ["o_orderkey"])
    return ranking.sample_per_group(found, ["presence"], ["o_orderkey"], 20)


@query(
    _cells_sql("orders", ["o_orderkey"], ORDER_COLS)
    + """SELECT "column", count(*) AS n_records FROM cells GROUP BY "column" ORDER BY n_records DESC, "column\""""
)
def columns_by_differences(spark, sf):
    stats = cells.keyed_stats(_orders(spark, sf), ORDER_COLS)
    return cells.column_diffs(stats).select("column", "n_records").orderBy(F.desc("n_records"), "column")


# --- schemas --------------------------------------------------------------------------------
@query(
    """SELECT "column", presence, n FROM (
 SELECT 'c_custkey' AS "column", 'primary_only' AS presence, (SELECT count(c_custkey) FROM customer) AS n
 UNION ALL SELECT 'name', 'both', (SELECT count(c_name) FROM customer)
 UNION ALL SELECT 'nation', 'both', (SELECT count(c_nationkey) FROM customer)
 UNION ALL SELECT 'c_mktsegment', 'primary_only', (SELECT count(c_mktsegment) FROM customer)
 UNION ALL SELECT 's_suppkey', 'replicated_only', (SELECT count(s_suppkey) FROM supplier))"""
)
def schema_diff(spark, sf):
    p = run_sql(spark, sf, "SELECT c_custkey, c_name AS name, c_nationkey AS nation, c_mktsegment FROM customer")
    r = run_sql(spark, sf, "SELECT s_suppkey, s_name AS name, s_nationkey AS nation FROM supplier")
    return schema.schema_diff(p, r).select(
        "column", "presence", F.coalesce("primary_values", "replicated_values").alias("n")
    )


@query("SELECT c_name, c_acctbal FROM customer")
def ignored_columns(spark, sf):
    """Ignored names match in any case; protected ones stay."""
    customers = run_sql(spark, sf, "SELECT * FROM customer")
    return schema.drop_ignored(
        customers, ["C_CUSTKEY", "c_nationkey", "c_mktsegment", "c_name", "absent"], protected=["c_name"]
    )


@query("SELECT c_nationkey, c_mktsegment FROM customer")
def compared_column_list(spark, sf):
    p = run_sql(spark, sf, "SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer")
    r = run_sql(spark, sf, "SELECT c_mktsegment, c_custkey, c_nationkey, c_name FROM customer")
    return p.select(*schema.compared_columns(p, r, keys=["c_custkey"], exclude=["c_name"]))


# --- latest rows ----------------------------------------------------------------------------
@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
 ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"""
)
def latest_per_group(spark, sf):
    events = run_sql(spark, sf, "SELECT user_id, event_id, event_type, ts FROM events")
    return ranking.latest_per_group(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    """WITH o AS (SELECT o_custkey, max(o_orderkey) AS l_orderkey FROM orders GROUP BY o_custkey),
l AS (SELECT * FROM (SELECT l_orderkey, l_partkey, l_shipdate, row_number() OVER (PARTITION BY l_orderkey
 ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS k FROM lineitem) WHERE k = 1)
SELECT o_custkey, l_orderkey, l_partkey FROM o LEFT JOIN l USING (l_orderkey)"""
)
def earliest_of_latest(spark, sf):
    """For each customer's newest order (by id) the line that shipped first."""
    orders = run_sql(spark, sf, "SELECT o_orderkey, o_custkey FROM orders")
    lines = run_sql(
        spark, sf, "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate FROM lineitem"
    )
    return ranking.child_of_latest(
        orders, lines, ["o_custkey"], "o_orderkey", ["o_orderkey"], "l_orderkey",
        ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"],
    ).select("o_custkey", "l_orderkey", "l_partkey")


# --- scalar rules ---------------------------------------------------------------------------
@query(f"SELECT doc_id, md5({norm('text')}) AS h FROM documents")
def normalize_documents(spark, sf):
    docs = run_sql(spark, sf, "SELECT doc_id, text FROM documents")
    return docs.select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("h"))


_NONE_TEXT = """CASE WHEN p_partkey % 3 = 0 THEN 'None ' || p_name || ' none-' || p_brand
 WHEN p_partkey % 3 = 1 THEN p_name || '_None' ELSE p_type || '  NONE  ' || p_brand END"""


@query(
    f"""SELECT p_partkey, {norm('x')} AS kept, {norm("regexp_replace(lower(x), '\\bnone\\b', '', 'g')")} AS dropped
FROM (SELECT p_partkey, {_NONE_TEXT} AS x FROM part)"""
)
def none_string_normalize(spark, sf):
    parts = run_sql(spark, sf, f"SELECT p_partkey, {_NONE_TEXT} AS x FROM part")
    return parts.select(
        "p_partkey",
        text.normalize_text(F.col("x")).alias("kept"),
        text.normalize_without_none(F.col("x")).alias("dropped"),
    )


_TOKENS = ", ".join(f"'{t}'" for t in text.NA_TOKENS)
_HOLED = "CASE o_orderkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN NULL WHEN 2 THEN 'nan' WHEN 3 THEN 'na' ELSE o_orderstatus END"


@query(
    f"""SELECT o_orderkey, CASE WHEN x IS NULL OR x IN ({_TOKENS}) THEN '' ELSE x END AS x
FROM (SELECT o_orderkey, {_HOLED} AS x FROM orders)"""
)
def na_tokens(spark, sf):
    orders = run_sql(spark, sf, f"SELECT o_orderkey, {_HOLED} AS x FROM orders")
    return orders.select("o_orderkey", text.na_to_empty(F.col("x")).alias("x"))


_RAW_KEY = "CASE WHEN o_orderkey % 7 = 0 THEN 'k' || o_orderkey ELSE CAST(o_orderkey AS STRING) END"


@query(
    f"""SELECT o_orderkey, regexp_full_match(x, '[0-9]+') AS is_digits, coalesce(TRY_CAST(x AS DOUBLE), 0) AS n
FROM (SELECT o_orderkey, {_RAW_KEY} AS x FROM orders)"""
)
def digit_keys(spark, sf):
    orders = run_sql(spark, sf, f"SELECT o_orderkey, {_RAW_KEY} AS x FROM orders")
    x = F.col("x")
    return orders.select("o_orderkey", text.is_digits(x).alias("is_digits"), text.digits_or_zero(x).alias("n"))


_RAW_DAY = "CASE WHEN o_orderkey % 7 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"


@query(
    f"""SELECT o_orderkey, CAST(TRY_CAST(x AS TIMESTAMP) AS DATE) AS seen_on,
 coalesce(TRY_CAST(x AS DATE) = DATE '1997-01-15', false) AS is_day FROM (SELECT o_orderkey, {_RAW_DAY} AS x FROM orders)"""
)
def text_to_time(spark, sf):
    orders = run_sql(spark, sf, f"SELECT o_orderkey, {_RAW_DAY} AS x FROM orders")
    at = values.try_time(F.col("x"))
    day = F.to_date(F.lit("1997-01-15"))
    return orders.select(
        "o_orderkey", F.to_date(at).alias("seen_on"), values.created_on(at, day).alias("is_day")
    )


@query(
    """SELECT event_id, CAST(trunc(epoch(TIMESTAMP '2024-02-01 00:00:00' - ts) / 60) AS BIGINT) AS minutes,
 strftime(ts, '%m-%d-%y %H%M') AS stamp, user_id || ' ' || strftime(ts, '%m-%d-%y %H%M') AS run_name FROM events"""
)
def run_times(spark, sf):
    events = run_sql(spark, sf, "SELECT event_id, user_id, ts FROM events")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return events.select(
        "event_id",
        values.minutes_between(F.col("ts"), now).alias("minutes"),
        values.run_stamp(F.col("ts")).alias("stamp"),
        values.run_name(F.col("user_id"), F.col("ts")).alias("run_name"),
    )


_FLAG_TEXT = """CASE event_id % 4 WHEN 0 THEN '{"Is_Dependent":  TRUE}' WHEN 1 THEN '{"is_dependent":true, "a": 1}'
 WHEN 2 THEN NULL ELSE props END"""


@query(
    f"""SELECT event_id, coalesce(regexp_matches(lower(x), 'is_dependent":\\s*true'), false) AS is_dependent
FROM (SELECT event_id, {_FLAG_TEXT} AS x FROM events)"""
)
def json_flag(spark, sf):
    events = run_sql(spark, sf, f"SELECT event_id, {_FLAG_TEXT} AS x FROM events")
    return events.select("event_id", text.json_flag(F.col("x"), "is_dependent").alias("is_dependent"))


_WITH_PASSWORD = "replace(url, '://', CASE WHEN page_id % 3 = 0 THEN '://alice:p@ss' || page_id || '@' ELSE '://' END)"


@query(
    f"""SELECT page_id, regexp_replace(x, '://([^:/@]+):([^/\\s]+)@', '://\\1:****@') AS x
FROM (SELECT page_id, {_WITH_PASSWORD} AS x FROM pages)"""
)
def redact_uri(spark, sf):
    pages = run_sql(spark, sf, f"SELECT page_id, {_WITH_PASSWORD} AS x FROM pages")
    return pages.select("page_id", text.redact_uri(F.col("x")).alias("x"))


_NAMED = """CASE doc_id % 9 WHEN 0 THEN '8b-Eligibilities.psv' WHEN 1 THEN '5a-activities-potential.psv'
 WHEN 2 THEN '10-issues-ueps.psv' WHEN 3 THEN '9-issues-potentials.psv' WHEN 4 THEN '6-activities-issues.psv'
 WHEN 5 THEN '4a-' || source || '.csv' WHEN 6 THEN '18b-eligib.psv' WHEN 7 THEN source ELSE '2-' || source END"""


@query(
    f"""SELECT doc_id, x, CASE WHEN n LIKE '8%' AND n LIKE '%eligib%' THEN 'eligibility'
 WHEN n LIKE '%5a-activities%' OR n LIKE '%activities-potential%' THEN 'activities'
 WHEN n LIKE '%issues%' AND (n LIKE '%potentials%' OR n LIKE '%uep%') THEN 'issues' ELSE 'generic' END AS kind,
 coalesce(TRY_CAST(regexp_extract(n, '^(\\d+)([a-z]?)', 1) AS INT), 999) AS number,
 regexp_extract(n, '^(\\d+)([a-z]?)', 2) AS letter
FROM (SELECT doc_id, x, lower(x) AS n FROM (SELECT doc_id, {_NAMED} AS x FROM documents))"""
)
def dataset_names(spark, sf):
    docs = run_sql(spark, sf, f"SELECT doc_id, {_NAMED} AS x FROM documents")
    number, letter, _ = labels.dataset_order(F.col("x"))
    return docs.select(
        "doc_id", "x", labels.dataset_kind(F.col("x")).alias("kind"), number.alias("number"), letter.alias("letter")
    )


@query(
    """SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderkey % 3 > 0 THEN 'missing: ' || (o_orderkey % 3) END,
 CASE WHEN o_orderkey % 5 > 0 THEN 'extra: ' || (o_orderkey % 5) END) AS message FROM orders"""
)
def joined_messages(spark, sf):
    orders = run_sql(spark, sf, "SELECT o_orderkey, o_orderkey % 3 AS a, o_orderkey % 5 AS b FROM orders")
    message = text.join_messages(
        text.counted_message("missing", F.col("a")), text.counted_message("extra", F.col("b"))
    )
    return orders.select("o_orderkey", message.alias("message"))
