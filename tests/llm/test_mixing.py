"""Mixing by Pareto order sampling: targets, the greedy order, odd tables, and unequal weights."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import mixing
from tests.llm.conftest import SF


def docs_of(spark, sizes, source="a"):
    return spark.createDataFrame([(k, " ".join(["w"] * n), source) for k, n in enumerate(sizes)], "doc_id long, text string, source string")


def level_targets(sizes, weights, most=3):
    """Targets by resharing what is above the bounds, source by source."""
    total, capped = sum(sizes), set()
    while True:
        rest = [k for k in range(len(sizes)) if k not in capped]
        share = total - sum(most * sizes[k] for k in capped)
        target = [most * sizes[k] if k in capped else share * weights[k] / sum(weights[j] for j in rest) for k in range(len(sizes))]
        above = {k for k in rest if target[k] > most * sizes[k]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1, 1000, 5, 0, 40, 7], [0, 0], [3], [1, 10_000, 10, 100, 1000, 5, 2, 1]])
def test_targets(spark, sizes):
    weights = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sizes))]
    rows = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights, strict=True)), "k long, source_size long, weight double")
    found = [r["target"] for r in mixing.with_targets(rows).orderBy("k").collect()]
    assert found == pytest.approx(level_targets(sizes, weights))
    assert sum(found) == pytest.approx(sum(sizes))


def test_order_is_walked_one_by_one(spark, monkeypatch):
    """Bins, narrower bins and single rows together take what a walk through the whole order takes."""
    rng = random.Random(1)
    rows = [(k, k % 3, rng.choice([1, 5, 50, 900]), rng.choice([rng.randrange(1 << 62), rng.randrange(1 << 20)])) for k in range(3000)]
    due = {0: 20_000, 1: 77_777, 2: 10}
    monkeypatch.setattr(mixing, "FINE", 20)
    monkeypatch.setattr(mixing, "BINS", 16)
    frame = spark.createDataFrame(rows, "rid long, sid long, size long, key long")
    stretches, singles = mixing._draw(frame, spark.createDataFrame(list(due.items()), "sid long, due long"))
    inside = F.exists("drawn", lambda s: (F.col("key") >= s["low"]) & (F.col("key") < s["high"]) & (F.col("size") <= s["due"]))
    by_stretch = {r["rid"] for r in frame.join(stretches, "sid").filter(inside).collect()}
    by_row = {r["rid"] for r in singles.collect()}
    want = set()
    for rid, sid, size, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if size <= due[sid]:
            due[sid] -= size
            want.add(rid)
    assert by_stretch | by_row == want and not by_stretch & by_row


def test_mix_comes_near_its_targets(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        target, size, taken = own[0]["target"], own[0]["source_size"], sum(r["taken"] for r in own)
        assert size == sum(r["size"] for r in own)
        assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] in (target // size, target // size + 1) for r in own)
        # Whatever was not drawn is longer than what is still due.
        left_out = [r["size"] for r in own if r["size"] and r["copies"] == target // size]
        assert 0 <= target - taken < min(left_out, default=1) + 1
    again = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_certain_copies_and_equal_chances(spark):
    """Ratio 3 * 3/8 ... of equal documents: each has its whole copies, and the rest is drawn in proportion."""
    docs = docs_of(spark, [10] * 4000, "a").union(docs_of(spark, [10] * 4000, "b"))
    rows = mixing.mix(docs, weights=(5, 3)).collect()
    a, b = ([r["copies"] for r in rows if r["source"] == s] for s in "ab")
    assert set(a) == {1, 2} and sum(a) == 5000
    assert set(b) == {0, 1} and sum(b) == 3000


def test_unequal_weights(spark):
    docs = docs_of(spark, [10] * 3000).withColumn("w", F.when(F.col("doc_id") % 3 == 0, 4.0).when(F.col("doc_id") % 3 == 1, 1.0))
    rows = mixing.mix(docs, weights=(1,), document_weight=F.col("w")).collect()
    heavy, light, none = ([r["copies"] for r in rows if r["doc_id"] % 3 == k] for k in range(3))
    # 3000 documents' words over 1000 of weight 4 and 1000 of weight 1: 2.4 and 0.6 copies.
    assert set(heavy) == {2, 3} and abs(sum(heavy) - 2400) < 60
    assert set(light) == {0, 1} and abs(sum(light) - 600) < 60
    assert sum(heavy) + sum(light) == 3000 and not any(none)
    capped = mixing.mix(docs_of(spark, [10] * 100).withColumn("w", F.when(F.col("doc_id") < 10, 50.0).otherwise(1.0)), (1,), document_weight=F.col("w")).collect()
    assert sum(r["copies"] for r in capped) == 100 and all(r["copies"] == 3 for r in capped if r["doc_id"] < 10)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sum(r["target"] for r in rows if r["source"] == "a") > 0
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert mixing.mix(no_docs).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(empty).collect()] == [(0.0, 0), (0.0, 0)]


def test_hot_ties(spark):
    """A thousand rows of one doc_id share their random number and are told apart by their places."""
    docs = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two").alias("text"), F.lit("a").alias("source"))
    other = spark.range(1000, 2000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("b").alias("source"))
    rows = mixing.mix(docs.union(other), weights=(1, 3)).collect()
    assert sum(r["taken"] for r in rows if r["source"] == "a") == 1000


def test_copied(spark):
    docs = docs_of(spark, [10] * 50).withColumn("extra", F.lit("x"))
    mixed = mixing.mix(docs, weights=(1,))
    assert mixing.copied(docs, mixed).count() == 50 and mixing.copied(docs, mixed).columns == docs.columns
