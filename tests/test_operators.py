"""Operators on small inputs, several of them against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.text import normalize_text
from tallyframe.operators import cells, equality, groups, keys, positional, ranking, schema


def frame(spark, rows, schema_text):
    return spark.createDataFrame(rows, schema_text)


def kv(spark, rows):
    return frame(spark, rows, "k string, v string")


def stats_of(spark, left, right, **more):
    paired = cells.pair_by_key(kv(spark, left), kv(spark, right), ["k"], dedup=more.pop("dedup", None))
    return cells.keyed_stats(paired, ["v"], **more).first()


@pytest.mark.parametrize("dedup", [None, "first"])
@pytest.mark.parametrize(
    "left, right, empty_is_null, expected",
    [
        ("v", "", False, (1, 0, 0)),
        ("", "v", False, (0, 1, 0)),
        ("v", "w", False, (0, 0, 1)),
        ("v", "v", False, (0, 0, 0)),
        (None, None, False, (0, 0, 0)),
        ("", None, True, (0, 0, 0)),
        ("", None, False, (0, 0, 1)),
        ("v", None, False, (1, 0, 0)),
    ],
)
def test_diff_classes(spark, dedup, left, right, empty_is_null, expected):
    row = stats_of(spark, [("a", left)], [("a", right)], null_is_empty=empty_is_null, dedup=dedup)
    (col,) = row.column_stats
    assert (col.n_primary_only_value, col.n_replicated_only_value, col.n_both_differ) == expected
    assert row.n_records_with_diffs == int(sum(expected) > 0)


def test_normaliser_hides_case(spark):
    assert stats_of(spark, [("a", "Hello")], [("a", "hello")]).n_records_with_diffs == 1
    assert stats_of(spark, [("a", "Hello")], [("a", "hello")], normalize=normalize_text).n_records_with_diffs == 0


@pytest.mark.parametrize("dedup", [None, "first"])
def test_one_sided_keys(spark, dedup):
    row = stats_of(spark, [(k, "x") for k in "123"], [(k, "x") for k in "234"], dedup=dedup)
    assert (row.n_primary_only, row.n_replicated_only, row.n_common, row.n_unequal) == (1, 1, 2, 2)


def test_first_row_per_key(spark):
    left, right = [("1", "x"), ("1", "b")], [("1", "b")]
    row = stats_of(spark, left, right, dedup="first")
    assert row.n_records_with_diffs == 0
    assert row.n_duplicate_primary == 1 and row.n_unequal == 1
    assert keys.first_per_key(kv(spark, left), ["k"]).collect() == [("1", "b")]


def test_rows_without_key_count_but_match_nothing(spark):
    same = stats_of(spark, [(None, "a"), ("1", "a")], [(None, "a"), ("1", "a")], dedup="first")
    assert (same.primary_rows, same.n_common, same.n_unequal) == (2, 1, 0)
    other = stats_of(spark, [(None, "a")], [(None, "b")], dedup="first")
    assert (other.n_common, other.n_primary_only, other.n_unequal) == (0, 0, 1)


def test_old_data(spark):
    rows = lambda data: frame(spark, data, "k string, v string, t timestamp_ntz")
    from datetime import datetime as dt

    primary = rows([("1", "a", dt(2024, 1, 5))])
    for extra, old in ((dt(2023, 1, 1), True), (dt(2024, 2, 1), False), (None, False)):
        paired = cells.pair_by_key(
            primary, rows([("1", "a", dt(2020, 1, 1)), ("2", "a", extra)]), ["k"], ["v"], "first", ts_col="t"
        )
        stats = cells.keyed_stats(paired, ["v"])
        assert stats.select(cells.old_data(stats)).first()[0] is old


def test_duplicate_keys_are_listed(spark):
    assert keys.duplicate_keys(kv(spark, [("1", "a"), ("1", "b"), ("2", "a")]), ["k"]).collect() == [("1", 2)]


def test_multiset_and_distinct(spark):
    left, right = kv(spark, [(c, "") for c in "aab"]), kv(spark, [(c, "") for c in "ac"])
    found = {(r.k, r.presence, r.surplus) for r in equality.multiset_diff(left, right).collect()}
    assert found == {("a", "primary_only", 1), ("b", "primary_only", 1), ("c", "replicated_only", 1)}
    assert {(r.k, r.presence) for r in equality.distinct_diff(left, right).collect()} == {
        ("b", "primary_only"), ("c", "replicated_only"),
    }
    row = equality.distinct_merge_summary(equality.multiset_counts(left, right)).first()
    assert (row.n_primary_only, row.n_replicated_only, row.n_both, row.n_matching_with_diffs) == (1, 1, 1, 1)


def test_digest_ignores_order_but_not_copies(spark):
    a = kv(spark, [("1", "x"), ("2", "y"), ("2", "y")])
    assert not equality.digests_differ(a, kv(spark, [("2", "y"), ("1", "x"), ("2", "y")]))
    assert equality.digests_differ(a, kv(spark, [("1", "x"), ("1", "x"), ("2", "y")]))
    assert equality.digests_differ(a, a.select("v", "k"))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("by", [(), ("g",)])
def test_positional_against_brute_force(spark, seed, by):
    rng = random.Random(seed)
    make = lambda n: [(rng.choice("ab"), rng.choice("pq" if seed % 2 else "pqrstuvw"), rng.randint(0, 9)) for _ in range(n)]
    left = make(120)
    if seed % 3 == 0:
        left += [("a", "p", 0)] * 200  # one row holds most of the table
    right = [r if rng.random() > 0.1 else (r[0], "z", r[2]) for r in left]
    if seed % 2:
        right += make(3)
    cols = "g string, s string, n int"
    runs = positional.positional_runs(frame(spark, left, cols), frame(spark, right, cols), by)

    expected, first = {}, {}
    for g in ("a", "b") if by else (None,):
        p = sorted(r for r in left if g in (None, r[0]))
        q = sorted(r for r in right if g in (None, r[0]))
        at = lambda side, i: side[i] if i < len(side) else None
        different = [i for i in range(max(len(p), len(q))) if at(p, i) != at(q, i)]
        expected[g] = (len(p), len(q), len(different))
        first[g] = [(i + 1, at(p, i), at(q, i)) for i in different[:5]]
    got = {
        (r.g if by else None): (r.primary_rows, r.replicated_rows, r.n_different)
        for r in positional.positional_summary(runs, by).collect()
    }
    assert got == expected
    shown = defaultdict(list)
    for r in sorted(positional.positional_samples(runs, 5, by).collect(), key=lambda r: r.position):
        g = r.g if by else None
        whole = lambda s: None if s is None else ((g, *s) if by else tuple(s))
        shown[g].append((r.position, whole(r.primary), whole(r.replicated)))
    assert {g: shown[g] for g in first} == first


R, E, D, Z = "execute_potential_resolution", "execute_employer_setting", "execute_dependent_setting", "Z"


def set_diff(spark, left, right, flag=False, **more):
    cols = "g string, item string, f boolean, name string"
    rows = lambda items: frame(spark, [("1", i, flag, f"n-{i}") for i in items], cols)
    options = dict(
        flag=F.col("f"), expected=[R, E], expected_if_flagged=[D], optional_unless_flagged=[D]
    )
    found = groups.group_set_diff(rows(left), rows(right), ["g"], "item", **{**options, **more})
    return {(r["item"], r.kind) for r in found.collect()}


def test_group_sets(spark):
    assert set_diff(spark, [R, E, D], [R, E]) == set()
    assert set_diff(spark, [R, E, D], [R, E], flag=True) == {(D, "missing")}
    assert set_diff(spark, [R], [R, R]) == {(E, "missing")}
    assert set_diff(spark, [R, E], []) == {(R, "missing"), (E, "missing")}
    assert set_diff(spark, [R, E], [R, E, Z]) == {(Z, "unexpected")}
    assert set_diff(spark, [], [R]) == {(R, "unexpected"), (E, "missing")}


def test_group_sets_of_equal_tables(spark):
    assert set_diff(spark, [R], [R]) == set()
    assert set_diff(spark, [R], [R], always_check_expected=True) == {(E, "missing")}


def test_group_info_comes_from_the_first_row(spark):
    cols = "g string, item string, f boolean, name string"
    left = frame(spark, [("1", R, False, "b"), ("1", R, False, "a"), ("1", E, False, "c")], cols)
    right = frame(spark, [("1", Z, False, "z")], cols)
    found = groups.group_set_diff(left, right, ["g"], "item", info_cols=["name"])
    assert {(r["item"], r.info_name) for r in found.collect()} == {(R, "c"), (E, "c"), (Z, "z")}


@pytest.mark.parametrize("seed", range(3))
def test_group_sets_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [R, E, D, "x", "y"]
    # A third of all rows belongs to group 0.
    make = lambda: [(str(0 if rng.random() < 0.33 else rng.randint(1, 30)), rng.choice(items), rng.random() < 0.1, "n") for _ in range(150)]
    left, right = make(), make()
    cols = "g string, item string, f boolean, name string"
    found = groups.group_set_diff(
        frame(spark, left, cols), frame(spark, right, cols), ["g"], "item", flag=F.col("f"),
        expected=[R, E], expected_if_flagged=[D], optional_unless_flagged=[D],
    )
    expected = set()
    for g in {r[0] for r in left + right}:
        p, q = {r[1] for r in left if r[0] == g}, {r[1] for r in right if r[0] == g}
        flagged = any(r[2] for r in left + right if r[0] == g)
        want = {R, E} | ({D} if flagged else set())
        missing = {i for i in p - q if i != D or flagged}
        if q and not p >= want:
            missing |= want - q
        expected |= {(g, i, "missing", flagged) for i in missing} | {(g, i, "unexpected", flagged) for i in q - p}
    got = [(r.g, r["item"], r.kind, r.is_flagged) for r in found.collect()]
    assert Counter(got) == Counter(expected)


def test_samples_are_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    assert ranking.sample_per_group(df, ["g"], ["v"], 3).count() == 6
    with pytest.raises(ValueError):
        ranking.sample_per_group(df, ["g"], ["v"], 0)
    many = spark.range(8000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    assert sorted(r.v for r in ranking.sample_per_group(many, ["g"], ["v"], 1500).collect()) == list(range(3000))


@pytest.mark.parametrize("bound", [ranking.BOUND, 20])  # the second one is far too near, so all groups are widened
def test_large_samples_by_bounds(spark, monkeypatch, bound):
    monkeypatch.setattr(ranking, "BOUND", bound)
    rows = [(None if k % 3 == 0 else k % 3, None if k % 50 == 0 else f"{k * 7919 % 4001:05d}", k) for k in range(20000)]
    rows += [(9, "x", 1)] * 3 + [(8, "tie", 5)] * 4000
    df = spark.createDataFrame(rows, "g long, t string, v long")
    want = Counter()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want.update(mine[:1200])
    assert Counter(map(tuple, ranking.sample_per_group(df, ["g"], ["t", "v"], 1200).collect())) == want
    empty = ranking.sample_per_group(df.filter("v < 0"), ["g"], ["t", "v"], 1200)
    assert empty.columns == df.columns and empty.collect() == []


def test_bounds_leave_few_rows(spark):
    df = spark.range(200000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("v"))
    near = ranking._within_bounds(df, ["g"], ["v"], 2000)
    assert 2 * 2000 <= near.count() < 2 * 3500


def test_child_of_latest(spark):
    parents = frame(spark, [(1, 10, 5), (1, 11, 4), (2, 20, 1)], "e int, id int, t int")
    children = frame(spark, [(11, "late", 9), (11, "early", 1), (10, "no", 0)], "parent int, s string, t int")
    args = (parents, children, ["e"], "id")
    by_id = {r.e: r.s for r in ranking.child_of_latest(*args, ["id"], "parent", ["t"]).collect()}
    assert by_id == {1: "early", 2: None}
    latest = {r.e: r.s for r in ranking.child_of_latest(*args, ["id"], "parent", ["t"], "latest").collect()}
    assert latest[1] == "late"
    by_time = {r.e: r.s for r in ranking.child_of_latest(*args, ["t"], "parent", ["t"]).collect()}
    assert by_time[1] == "no"


def test_schema_operators(spark):
    a, b = frame(spark, [(1, "x")], "id int, Name string"), frame(spark, [(1, 2)], "id int, other int")
    assert schema.one_sided_columns(a, b) == (["Name"], ["other"])
    assert schema.drop_ignored(a, ["NAME", "ID"], protected=["id"]).columns == ["id"]
    found = {r["column"]: r.presence for r in schema.schema_diff(a, b).collect()}
    assert found == {"id": "both", "Name": "primary_only", "other": "replicated_only"}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_positions_over_short_stretches(spark, monkeypatch, by):
    """Sums that go over many stretches of a partition, as no window may hold a whole partition."""
    monkeypatch.setattr(positional, "STRETCH", 2)
    p = [("ab"[i % 2], i // 3) for i in range(90)]
    r = [(g, v) for g, v in p if v % 7] + [("b", 1000)] * 3
    sides = [spark.createDataFrame(x, "g string, v int") for x in (p, r)]
    runs = positional.positional_runs(*sides, by)
    sums = runs._jdf.queryExecution().optimizedPlan().toString()
    assert "shiftright(_id#" in sums.lower() and ", 2)" in sums
    for key in "ab" if by else [None]:
        a, b = (sorted((g, v) for g, v in x if key in (None, g)) for x in (p, r))
        found = runs.where(F.col("g") == key) if key else runs
        for x, s in ((a, "p"), (b, "r")):
            filled = {(row.g, row.v): range(row[f"{s}_start"], row[f"{s}_end"]) for row in found.collect()}
            assert x == [t for _, t in sorted((i, t) for t, span in filled.items() for i in span)]


@pytest.mark.parametrize("dedup", [None, "first"])
def test_pairs_without_equal_rows(spark, dedup):
    left = [("a", "x"), ("b", "y"), ("c", None), ("d", "z"), (None, "q")]
    right = [("a", "x"), ("b", "w"), ("c", ""), ("e", "z"), (None, "q")]
    paired = cells.pair_by_key(kv(spark, left), kv(spark, right), ["k"], dedup=dedup)
    short = cells.without_equal_rows(paired, ["k"], ["v"])
    assert cells.keyed_stats(short, ["v"]).collect() == cells.keyed_stats(paired, ["v"]).collect()
    assert {r.k for r in short.where("k IS NOT NULL OR p IS NOT NULL OR r IS NOT NULL").collect()} == set("bcde")
    assert short.where("unequal").exceptAll(paired.where("unequal")).isEmpty()


def test_cells_that_differ_in_text_alone_stay_with_their_pair(spark):
    sides = [spark.createDataFrame([("a", v)], "k string, v double") for v in (0.0, -0.0)]
    paired = cells.pair_by_key(*sides, ["k"])
    short = cells.without_equal_rows(paired, ["k"], ["v"], null_is_empty=True)
    both = [cells.keyed_stats(x, ["v"], null_is_empty=True).first() for x in (paired, short)]
    assert both[0] == both[1] and both[0].n_records_with_diffs == 1


def test_reported_items_are_computed_once(spark, monkeypatch):
    stored, cut = [], groups.cut_lineage
    monkeypatch.setattr(groups, "cut_lineage", lambda df, name: stored.append(name) or cut(df, name))
    sides = [frame(spark, rows, "g string, i string, name string") for rows in ([("a", "x", "n"), ("a", "y", "m")], [("a", "x", "n")])]
    found = groups.group_set_diff(*sides, ["g"], "i", info_cols=["name"])
    assert stored == ["items"]
    assert [(r.g, r.item, r.kind, r.info_name) for r in found.collect()] == [("a", "y", groups.MISSING, "n")]
