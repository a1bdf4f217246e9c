"""Digest trees and comparisons of stored sides."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import digests
from tallyframe.plans.compare import compare_tables
from tallyframe.plans.rules import CompareRules, spec_for
from tallyframe.plans.saved import compare_saved, save_side

COLUMNS = "emp_id int, row_number string, v string"


def made(n=400, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3, None]), str(k), rng.choice("abc")) for k in range(n)]


def stored(spark, rows, path, bits=4, by=("emp_id",)):
    return digests.save_digested(spark.createDataFrame(rows, COLUMNS), str(path), ["row_number"], by, bits)


@pytest.mark.parametrize("bits", [0, 5])
def test_equal_sides_move_no_row(spark, tmp_path, monkeypatch, bits):
    rows = made()
    a = stored(spark, rows, tmp_path / "a", bits)
    b = stored(spark, random.Random(2).sample(rows, len(rows)), tmp_path / "b", bits)
    assert a.root() == b.root() and a.root()[0] == len(rows)
    assert digests.unequal_ranges(a, b) is None
    changed = digests.changed_rows(a, b)
    assert changed.primary.collect() == changed.replicated.collect() == []
    assert "FileScan" not in changed.primary._jdf.queryExecution().executedPlan().toString()
    assert sum(r["n_rows"] for r in changed.equal.collect()) == len(rows)
    monkeypatch.setattr(digests.DigestTree, "level", None)  # the roots alone decide
    assert digests.unequal_ranges(a, b) is None


def test_a_changed_row_reads_one_range(spark, tmp_path):
    rows = made()
    other = [(e, k, "changed" if k == "77" else v) for e, k, v in rows]
    a, b = stored(spark, rows, tmp_path / "a"), stored(spark, other, tmp_path / "b")
    found = digests.unequal_ranges(a, b).collect()
    assert len(found) == 1
    changed = digests.changed_rows(a, b)
    plan = changed.primary._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan or "PartitionFilters: [(_range" in plan
    employer = next(e for e, k, _ in rows if k == "77")
    assert {r["emp_id"] for r in changed.primary.collect()} == {employer}
    assert changed.primary.count() + sum(r["n_rows"] for r in changed.equal.collect()) == len(rows)


def test_a_changed_row_reads_one_folder(spark, tmp_path):
    rows = made()
    other = [(e, k, "changed" if k == "77" else v) for e, k, v in rows]
    a, b = (stored(spark, x, tmp_path / n, by=()) for n, x in (("a", rows), ("b", other)))
    (found,) = digests.unequal_ranges(a, b).collect()
    files = {r[0] for r in digests.changed_rows(a, b).primary.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"_range={found['_node']}/" in f for f in files)


def test_digests_tell_copies_types_and_layouts(spark, tmp_path):
    rows = made(50)
    a, twice = stored(spark, rows, tmp_path / "a"), stored(spark, [*rows, rows[0]], tmp_path / "twice")
    swapped = stored(spark, [*rows[1:], rows[1]], tmp_path / "swapped")
    assert a.root() != twice.root() and a.root() != swapped.root()
    assert len(digests.unequal_ranges(a, twice).collect()) == 1
    with pytest.raises(ValueError, match="not stored alike"):
        digests.unequal_ranges(a, stored(spark, rows, tmp_path / "bits", 3))
    typed = spark.createDataFrame(rows, COLUMNS).withColumn("v", F.lit(1))
    with pytest.raises(ValueError, match="not stored alike"):
        digests.unequal_ranges(a, digests.save_digested(typed, str(tmp_path / "typed"), ["row_number"], ["emp_id"], 4))
    with pytest.raises(ValueError):
        digests.save_digested(typed, str(tmp_path / "none"), ["no"], bits=2)
    again = digests.open_digested(spark, str(tmp_path / "a"))
    assert again.root() == a.root() and digests.unequal_ranges(a, again) is None


def test_empty_sides(spark, tmp_path):
    a, b = stored(spark, [], tmp_path / "a"), stored(spark, made(20), tmp_path / "b")
    assert a.root() is None and digests.unequal_ranges(a, a) is None
    changed = digests.changed_rows(a, b)
    assert changed.primary.count() == 0 and changed.replicated.count() == 20


def sides(seed):
    rng = random.Random(seed)
    p = made(300, seed)
    r = [(e, k, rng.choice("xyz") if rng.random() < 0.02 and e != 2 else v) for e, k, v in p if rng.random() > 0.01 or e == 2]
    return p, r + [(3, f"new{k}", "a") for k in range(3)]


def same_results(spark, tmp_path, dataset, p, r, rules=None, by=("emp_id",), schema=COLUMNS):
    frames = [spark.createDataFrame(x, schema) for x in (p, r)]
    trees = [save_side(f, str(tmp_path / n), dataset, rules=rules, by=by, bits=2) for f, n in zip(frames, "pr", strict=True)]
    want, got = compare_tables(*frames, dataset, rules=rules, by=by), compare_saved(spark, *trees, dataset, rules=rules, by=by)
    assert want.names() == got.names()
    for name in want.names():
        a, b = getattr(want, name), getattr(got, name)
        assert a.columns == b.columns
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name


def test_stored_sides_compare_like_whole_ones(spark, tmp_path):
    same_results(spark, tmp_path, "11-users.psv", *sides(3))


def test_issues_with_repeated_keys(spark, tmp_path):
    p, r = sides(4)
    same_results(spark, tmp_path, "9-issues-potentials.psv", [*p, *p[:20], (1, None, "z")], [*r, *r[:5], (1, None, "z")])


def test_eligibilities_with_old_rows(spark, tmp_path):
    schema = "emp_id int, id string, created_at string, plan string"
    p = [(k % 3, f"{k}.0" if k % 5 else f"x{k}", "2020-01-01" if k % 7 else None, "a") for k in range(200)]
    r = [(e, f"0{i}" if k % 4 else i, t, "b" if k == 100 else v) for k, (e, i, t, v) in enumerate(p)] + [(1, "1000", "1990-01-01", "a")]
    rules = CompareRules.from_ini("[global_ignore_columns]\ncreated_at = true")
    same_results(spark, tmp_path, "8b-eligibilities.psv", p, r, rules, schema=schema)


def test_repeated_keys_of_generic_datasets(spark, tmp_path):
    """Employer 2 has a repeated key and differs: it compares by whole rows, as the others do not."""
    p, r = sides(5)
    frames = [spark.createDataFrame(x, COLUMNS) for x in ([*p, (2, "0", "a"), (2, "0", "b")], [*r, (2, "0", "a"), (2, "0", "c")])]
    trees = [save_side(f, str(tmp_path / n), "11-users.psv", by=["emp_id"], bits=2) for f, n in zip(frames, "pr", strict=True)]
    columns = ["emp_id", "match", "primary_rows", "replicated_rows", "difference_count", "summary"]
    want = compare_tables(*frames, "11-users.psv", by=["emp_id"]).results.select(*columns)
    got = compare_saved(spark, *trees, "11-users.psv", by=["emp_id"]).results.select(*columns)
    assert sorted(map(repr, want.collect())) == sorted(map(repr, got.collect()))


def test_without_employers_and_without_key(spark, tmp_path):
    same_results(spark, tmp_path, "11-users.psv", *sides(6), by=())
    with pytest.raises(ValueError, match="key per row"):
        save_side(spark.createDataFrame([], "a int"), str(tmp_path / "x"), "11-users.psv")
    assert spec_for("11-users.psv").mode == "generic"
