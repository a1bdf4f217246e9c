"""URL rules as a sort-merge range join, in DataFrame operations only.

A host is written with its labels reversed, so a rule's host and all its subdomains are one interval of
keys, and so are the paths that start with a rule's path. Rules and points are sorted together by key,
dealt over ranges. The rule last passed at a point brings its stack: itself and the rules it is nested
in. What does not contain the point is popped, and the rest are the rules that are active there. Each
range starts with the stack that the ranges before it end with. Two such sweeps are made: one over
hosts, and then one over the paths of the hosts found, so neither the number of rules of a host nor
that of rules in all matters. Equal keys are spread over ranges by a row number.

Odd cases: a null url, or one without ``://``, has an empty host and path. Rules with a null in any column are
left out; of rules with the same host and path but different verdicts, block holds. Only page_id and
url are read, one output row per row. Without rules every verdict is the default.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, and from there to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``a.example.net`` as ``net/example/a/``: a host's key starts with those of the hosts above it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def sweep(points: DataFrame, rules: DataFrame, same: list[str], key: str) -> DataFrame:
    """``points`` with ``active``: the elements of the rules' stacks that contain the point, outermost first.

    ``rules``: the columns of ``same``, ``key`` and ``stack``, an array of structs with ``prefix``. A rule
    contains a point if they are equal in ``same`` and the point's ``key`` starts with the prefix.
    """
    others = [c for c in points.columns if c not in (*same, key)]
    events = rules.select(*same, key, F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_row"), "stack").unionByName(
        points.select("*", F.lit(1).alias("_kind"), F.monotonically_increasing_id().alias("_row")), allowMissingColumns=True
    )
    order = [*same, key, "_kind", "_row"]
    ranged = cut_lineage(events.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ends = ranged.groupBy("_range").agg(
        F.max_by("stack", F.when(F.col("_kind") == 0, F.struct(*same, key))).alias("end")
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_range"), F.last("end", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = ranged.withColumn("last", F.last("stack", ignorenulls=True).over(so_far)).filter("_kind = 1")
    stack = F.coalesce("last", "carried")

    def contains(rule: Column) -> Column:
        return reduce(Column.__and__, [rule[c] == F.col(c) for c in same], F.startswith(F.col(key), rule["prefix"]))

    active = F.filter(stack, contains)  # null before the first rule
    return last.join(ends, "_range").select(*same, key, *others, active.alias("active"))


def _stacks(rules: DataFrame, same: list[str], prefixes: Column, fields: list[str]) -> DataFrame:
    """Each rule with its stack: the rules that have one of its ``prefixes``, itself included, shortest first."""
    parts = rules.select(*same, F.col("prefix").alias("key"), F.explode(prefixes).alias("prefix"))
    found = parts.join(rules, [*same, "prefix"])
    element = F.struct(F.length("prefix").alias("size"), "prefix", *same, *fields)
    return found.groupBy(*same, "key").agg(F.array_sort(F.collect_list(element)).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all subdomains, if the page's path
    starts with the rule's. The longest rule wins; of equally long ones, that with the longer host.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").select(
        "page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("rid")
    )
    parsed = cut_lineage(parsed.withColumn("key", host_key(F.col("host"))), "pages")
    rules = (
        rules.dropna(subset=["host", "path", "verdict"])
        .select(F.translate("host", ascii_uppercase, ascii_lowercase).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )

    hosts = rules.select("host").distinct().select(host_key(F.col("host")).alias("prefix"))
    labels = F.split("prefix", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "/"), F.lit("/"))
    )
    at_host = sweep(parsed.select("rid", "path", "key"), _stacks(hosts, [], above, []), [], "key")

    of_host = rules.select(host_key(F.col("host")).alias("of"), F.col("path").alias("prefix"), "host", "verdict")
    starts = F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda n: F.substring(F.col("prefix"), F.lit(1), n))
    paths = at_host.select("rid", F.explode("active.prefix").alias("of"), F.col("path").alias("key"))
    at_path = sweep(paths, _stacks(of_host, ["of"], starts, ["host", "verdict"]), ["of"], "key")
    inmost = F.element_at("active", -1)
    rank = F.struct(
        (F.length(inmost["host"]) + inmost["size"]).alias("size"),
        F.length(inmost["host"]).alias("of_host"),
        F.concat(inmost["host"], inmost["prefix"]).alias("rule"),
        inmost["verdict"].alias("verdict"),
    )
    best = at_path.filter(F.size("active") > 0).groupBy("rid").agg(F.max(rank).alias("best"))
    return parsed.join(best, "rid", "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
