"""Aligned positions against a walk through both sorted sides."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import equality, positional
from tallyframe.plans.compare import compare_tables
from tallyframe.plans.rules import GENERIC

SCHEMA = "g int, a string, b int"


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def walk(p, r):
    """The differences of two lists of rows: (gap, place, row of p or None, row of r or None)."""
    p, r = Counter(p), Counter(r)
    gap, gaps = 0, {}
    for row in sorted({*p, *r}, key=key):
        gap += min(p[row], r[row]) > 0
        left, right = gaps.setdefault(gap, ([], []))
        left += [row] * (p[row] - r[row])
        right += [row] * (r[row] - p[row])
    out = []
    for gap, (left, right) in gaps.items():
        for place in range(max(len(left), len(right))):
            out.append((gap, place, left[place] if place < len(left) else None, right[place] if place < len(right) else None))
    return out


def groups(seed):
    rng, p, r = random.Random(seed), {}, {}
    row = lambda: (rng.choice("abcd") if rng.random() < 0.95 else None, rng.randrange(30))
    for g in range(40):
        p[g] = [row() for _ in range(rng.randrange(60))]
        r[g] = [x for x in p[g] if rng.random() > rng.choice([0, 0.1, 1])] + [row() for _ in range(rng.choice([0, 0, 1, 5]))]
        p[g] += p[g][:3] * rng.choice([0, 0, 4])
    return p, r


def frame(spark, sides):
    return spark.createDataFrame([(g, *row) for g, rows in sides.items() for row in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walk(spark, seed):
    p, r = groups(seed)
    rows = positional.aligned_rows(equality.multiset_counts(frame(spark, p), frame(spark, r)), ["g"])
    want = {g: d for g in p if (d := walk(p[g], r[g]))}
    summary = {x["g"]: (x["n_changed"], x["n_primary_extra"], x["n_replicated_extra"]) for x in positional.aligned_summary(rows, ["g"]).collect()}
    kinds = lambda d: (sum(a is not None and b is not None for *_, a, b in d), sum(b is None for *_, b in d), sum(a is None for *_, a, b in d))
    assert summary == {g: kinds(d) for g, d in want.items()}
    found = {}
    for x in positional.aligned_samples(rows, 4, ["g"]).collect():
        found.setdefault(x["g"], []).append((x["gap"], x["place"], x["primary"] and tuple(x["primary"]), x["replicated"] and tuple(x["replicated"])))
    assert {g: sorted(d, key=lambda x: x[:2]) for g, d in found.items()} == {g: d[:4] for g, d in want.items()}


def test_one_inserted_row_is_one_difference(spark):
    rows = [(k % 7, f"r{k:04}", k) for k in range(500)]
    p, r = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*rows, (0, "", 0)], SCHEMA)
    aligned = positional.aligned_rows(equality.multiset_counts(p, r))
    assert tuple(positional.aligned_summary(aligned).first()) == (0, 0, 1)
    assert positional.positional_summary(positional.positional_runs(p, r)).first()["n_different"] > 400
    (pair,) = positional.aligned_samples(aligned, 5).collect()
    assert pair["primary"] is None and pair["replicated"]["a"] == ""


def test_equal_and_empty_sides(spark):
    p = spark.createDataFrame([(1, "a", 1), (1, "a", 1)], SCHEMA)
    for left, right in ((p, p), (p.limit(0), p.limit(0))):
        rows = positional.aligned_rows(equality.multiset_counts(left, right))
        assert rows.collect() == [] and tuple(positional.aligned_summary(rows).first()) == (0, 0, 0)
        assert positional.aligned_samples(rows, 3).collect() == []
    rows = positional.aligned_rows(equality.multiset_counts(p, p.limit(0)))
    assert tuple(positional.aligned_summary(rows).first()) == (0, 2, 0)


def test_only_differences_are_ranked(spark):
    """The windows of the plan stand behind the filter of rows that differ."""
    p = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("a"), F.lit(1).alias("b"))
    rows = positional.aligned_rows(equality.multiset_counts(p, p.where("a <> '500'").unionByName(p.where("a = '7'"))))
    assert sorted((x["in_primary"], x["n"], x["row"]["a"]) for x in rows.collect()) == [(False, 1, "7"), (True, 1, "500")]


def test_compare_mode(spark):
    rows = [(k % 2, f"r{k:04}", k) for k in range(60)]
    p = spark.createDataFrame(rows, SCHEMA)
    r = spark.createDataFrame([(0, "", 0), *[(g, a, b + 1000 if a == "r0041" else b) for g, a, b in rows if a != "r0010"]], SCHEMA)
    spec = GENERIC.with_(full_row="aligned")
    for by, want in (((), {None: (1, 1, 1)}), (("g",), {0: (1, 1, 0), 1: (0, 0, 1)})):
        diff = compare_tables(p, r, "15-potentials.psv", spec, by=by)
        got = {x["g"] if by else None: (x["n_primary_only"], x["n_replicated_only"], x["n_records_with_diffs"]) for x in diff.results.collect()}
        assert got == want
        assert {x["presence"] for x in diff.record_samples.collect()} == {"primary_only", "replicated_only"}
    assert compare_tables(p, p, "15-potentials.psv", spec).results.first()["match"]
