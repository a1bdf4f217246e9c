"""Time the core operators on enlarged, skewed copies of the test tables.

usage: scale_check.py SOURCE_DIR FACTOR [OUTPUT_DIR]

The copies go to OUTPUT_DIR (default: a new folder under /tmp) and are reused if they exist.
One key, one employer and one row hold a third of their tables each.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe.functions.text import normalize_text  # noqa: E402
from tallyframe.operators import cells, equality, groups, keys, positional  # noqa: E402
from tallyframe.plans.compare import compare_tables  # noqa: E402
from tallyframe.session import SETTINGS  # noqa: E402

COLS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


def enlarge(spark, source, factor, out):
    copies = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)).cast("array<bigint>")).alias("copy")
    orders = spark.read.parquet(f"{source}/orders.parquet").select("*", copies)
    key = F.col("o_orderkey") + F.col("copy") * 1_000_000_000
    orders.withColumn("o_orderkey", key).drop("copy").write.parquet(f"{out}/orders")
    lines = spark.read.parquet(f"{source}/lineitem.parquet").select("*", copies)
    hot = F.col("l_orderkey") % 3 == 0
    lines = lines.withColumn("l_orderkey", F.when(hot, 0).otherwise(F.col("l_orderkey") + F.col("copy") * 1_000_000_000))
    lines = lines.withColumn("emp_id", F.when(hot, 0).otherwise(F.col("l_suppkey") % 500))
    lines.drop("copy").write.parquet(f"{out}/lineitem")


def main() -> None:
    source, factor = sys.argv[1], int(sys.argv[2])
    out = sys.argv[3] if len(sys.argv) > 3 else tempfile.mkdtemp(prefix="scale-", dir="/tmp")
    builder = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", "32")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not os.path.exists(f"{out}/lineitem/_SUCCESS"):
        enlarge(spark, source, factor, out)

    orders, lines = spark.read.parquet(f"{out}/orders"), spark.read.parquet(f"{out}/lineitem")
    changed_orders = orders.where("o_orderkey % 97 <> 0").withColumn(
        "o_orderstatus", F.expr("CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE o_orderstatus END")
    )
    changed_lines = lines.where("l_partkey % 50 <> 0").withColumn(
        "l_linestatus", F.expr("CASE WHEN l_partkey % 31 = 0 THEN 'Z' ELSE l_linestatus END")
    )
    few = ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"]
    line_keys = ["l_orderkey", "l_linenumber"]
    flag = F.col("l_tax") > 0.07

    def by_key():
        return cells.keyed_stats(cells.pair_by_key(orders, changed_orders, ["o_orderkey"], COLS), COLS)

    def first_per_key():
        paired = cells.pair_by_key(lines, changed_lines, line_keys, ["l_returnflag", "l_linestatus", "l_shipdate"], "first")
        return cells.keyed_stats(paired, ["l_returnflag", "l_linestatus"], normalize=normalize_text)

    def by_employer():
        cols = ["emp_id", *line_keys, "l_returnflag", "l_linestatus", "l_quantity"]
        a, b = (df.select(*cols).withColumnRenamed("l_orderkey", "row_number") for df in (lines, changed_lines))
        return compare_tables(a, b, "rows.psv", by=["emp_id"]).results

    jobs = {
        "keyed_stats": by_key,
        "key_presence": lambda: keys.key_presence(orders, changed_orders, ["o_orderkey"]).groupBy("presence").count(),
        "first_per_key": first_per_key,
        "multiset_diff": lambda: equality.multiset_diff(lines.select(*few), changed_lines.select(*few)),
        "digest": lambda: equality.table_digest(lines),
        "positional": lambda: positional.positional_summary(
            positional.positional_runs(lines.select(*few), changed_lines.select(*few))
        ),
        "group_sets": lambda: groups.group_set_diff(
            lines.select("l_orderkey", "l_partkey", "l_tax"), changed_lines.select("l_orderkey", "l_partkey", "l_tax"),
            ["l_orderkey"], "l_partkey", flag=flag,
        ),
        "compare_by_employer": by_employer,
    }
    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 1)
        print(name, seconds[name], flush=True)
    print(json.dumps({"factor": factor, "orders": orders.count(), "lines": lines.count(), "seconds": seconds}))


if __name__ == "__main__":
    main()
