"""Physical plans: what is read, moved and joined."""

import re

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import cells, equality, groups, keys, layout, positional, ranking
from workload.catalog import QUERIES
from workload.data import pair, run_sql

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def test_key_presence_reads_only_keys(spark):
    text = plan(keys.key_presence(*pair(spark, SF_DIR, "orders"), ["o_orderkey"]))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)) == {"struct<o_orderkey:bigint>"}
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in text
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1


def test_unique_pairs_shuffle_each_side_once(spark):
    paired = cells.pair_by_key(*pair(spark, SF_DIR, "orders"), ["o_orderkey"], ["o_orderstatus"])
    text = plan(cells.keyed_stats(paired, ["o_orderstatus"]))
    assert text.count("Exchange hashpartitioning") == 2
    assert "o_totalprice" not in text and "o_custkey" not in text


def test_first_row_needs_no_join_and_no_window(spark):
    paired = cells.pair_by_key(*pair(spark, SF_DIR, "line_keys"), ["l_orderkey", "l_linenumber"], dedup="first")
    text = plan(paired)
    assert "Join" not in text and "Window" not in text
    # Every aggregation has a partial step before its shuffle.
    assert text.count("partial_min") == text.count("partial_sum(primary_count") * 2 == 2


def test_one_pass_for_both_directions(spark):
    text = plan(equality.multiset_diff(*pair(spark, SF_DIR, "lines")))
    assert text.count("Exchange") == 1 and "Join" not in text and "partial_sum" in text


def test_digest_moves_no_rows(spark):
    p, _ = pair(spark, SF_DIR, "lines")
    assert "hashpartitioning" not in plan(equality.table_digest(p))


def test_samples_are_cut_before_the_shuffle(spark):
    p, _ = pair(spark, SF_DIR, "lines")
    text = plan(ranking.sample_per_group(p, ["l_returnflag"], ["l_orderkey"], 5))
    assert re.search(r"WindowGroupLimit .*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit .*Partial", text)


def test_positions_are_not_ranked_in_one_task(spark):
    runs = positional.positional_runs(*pair(spark, SF_DIR, "shifted"))
    text = plan(positional.positional_summary(runs))
    # Rows are only ranked inside a range partition; the one window over all is over partition sizes.
    windows = re.findall(r"Window \[[^\n]*", text)
    assert sum("primary_count" in w and "_part" in w for w in windows) == 1
    assert "l_orderkey" not in text  # the stored layout is columnar: counts alone are read


def test_group_pairs_are_computed_once(spark):
    options = dict(flag=F.col("props") == "x", expected=["view"], always_check_expected=True)
    text = final_plan(groups.group_set_diff(*pair(spark, SF_DIR, "events"), ["user_id", "day"], "event_type", **options))
    assert "ReusedExchange" in text and "collect_set" not in text


@pytest.mark.parametrize("name", ["cell_diffs", "group_set_diff", "compare_activities", "compare_issues", "state_completion", "dataset_pairing"])
def test_no_cross_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_template_of_all_employers_is_a_plain_join(spark):
    text = plan(QUERIES["sql_template"](spark, SF_DIR))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_employer_filter_reaches_the_scan(spark):
    text = plan(run_sql(spark, SF_DIR, "SELECT event_id FROM events WHERE user_id = :emp", emp=3))
    assert "EqualTo(user_id,3)" in text


def test_bucketed_sides_pair_without_shuffle(spark, tmp_path):
    sides = []
    for name, df in zip(("side_p", "side_r"), pair(spark, SF_DIR, "orders")):
        layout.save_by_key(df, name, ["o_orderkey"], 4, str(tmp_path / name))
        sides.append(spark.table(name))
    paired = cells.pair_by_key(*sides, ["o_orderkey"])
    assert "Exchange" not in plan(paired)
    assert paired.count() == keys.key_presence(*sides, ["o_orderkey"]).count()
    for name in ("side_p", "side_r"):
        spark.sql(f"DROP TABLE {name}")


def test_exports_are_balanced_by_size(spark):
    df = run_sql(spark, SF_DIR, "SELECT o_custkey % 3 AS emp_id, o_orderkey FROM orders")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(layout.balanced_by(df, "emp_id"))
