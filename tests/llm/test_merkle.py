"""The Merkle manifest against trees that are built one node after the other."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, place):
    out = []
    for nodes in tree[:-1]:
        first = place - place % 3
        out += [n for k, n in enumerate(nodes[first : first + 3], first) if k != place]
        place //= 3
    return out


def brute(rows):
    """rows: doc_id, source, leaf, claim. Returns doc_id, source, leaf, subroot, root, proof, verified."""
    key = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted([r for r in rows if r[1] == s], key=lambda r: (key(r[0]), bytes.fromhex(r[2]))) for s in sources}
    built = {s: levels([r[2] for r in own]) for s, own in trees.items()}
    top = levels([built[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for place, (doc_id, _, leaf, claim) in enumerate(trees[s]):
            beside = siblings(built[s], place) + siblings(top, at)
            out.append((str(doc_id), str(s), leaf, built[s][-1][0], top[-1][0], h("".join(beside)), claim in (None, leaf)))
    return sorted(out)


def of_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, leaf string, claim string")
    return frame.select("doc_id", "source", F.unhex("leaf").alias("digest"), F.unhex("claim").alias("claim"))


def short(rows):
    return sorted((str(r["doc_id"]), str(r["source"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in rows)


def made(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for s, n in sizes.items():
        rows += [(len(rows) + k, s, h(f"{s}/{k}"), rng.choice([None, h(f"{s}/{k}"), h("other")])) for k in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", range(1, 8))
def test_layout_holds_each_node_once(size):
    every = [a for level in merkle.addresses(size) for a in level]
    assert sorted(every) == list(range(merkle.nodes_of(size)))
    assert merkle.address(size, 0, 0) == 0


def test_layout_splits_at_half_height():
    """Each subtree of the lower half lies in one stretch, and paths cross few of them."""
    levels_ = 6
    by_level = merkle.addresses(levels_)
    for tree in range(27):
        below = [by_level[level][i] for level in range(3) for i in range(tree * 3 ** (2 - level), (tree + 1) * 3 ** (2 - level))]
        assert max(below) - min(below) + 1 == len(below) == merkle.nodes_of(3)


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {None: 1, "b": 2, "a": 3, "c": 4}, {"a": 243, "b": 244, "c": 3000, "é": 730, "": 7}, {f"s{k:04}": 1 + k % 3 for k in range(600)}],
)
def test_against_single_nodes(spark, sizes):
    rows = made(sizes)
    assert short(merkle.verified(merkle.manifest(of_rows(spark, rows))).collect()) == brute(rows)


def test_proofs_fold_to_the_root(spark, tmp_path):
    rows = made({"a": 700, None: 30, "z": 1})
    kept = merkle.manifest(of_rows(spark, rows), str(tmp_path / "kept"))
    again = merkle.open_manifest(spark, str(tmp_path / "kept"))
    assert again.root() == kept.root()
    found = merkle.proofs(again).collect()
    assert len(found) == len(rows)
    for r in found:
        path = [(s["place"], [bytes(x) for x in s["siblings"]]) for s in r["path"]]
        assert merkle.fold(bytes(r["leaf"]), path).hex() == kept.root()
    assert {r["place"] for r in found if r["source"] == "a"} == set(range(700))


def test_odd_documents(spark, odd_docs, no_docs):
    leaves = odd_docs.select("doc_id", "source", merkle.leaf().alias("digest"), F.lit(None).cast("binary").alias("claim"))
    want = [(r["doc_id"], r["source"], plain_leaf([r[c] for c in merkle.FIELDS]), None) for r in odd_docs.collect()]
    assert short(merkle.verified(merkle.manifest(leaves)).collect()) == brute(want)
    none = no_docs.select("doc_id", "source", merkle.leaf().alias("digest"), F.lit(None).cast("binary").alias("claim"))
    empty = merkle.manifest(none)
    assert empty.root() is None and merkle.verified(empty).collect() == [] and merkle.proofs(empty).collect() == []


def test_a_change_is_found(spark):
    rows = [(k, "a", h(str(k)), h("changed") if k == 77 else h(str(k))) for k in range(100)]
    found = merkle.verified(merkle.manifest(of_rows(spark, rows))).collect()
    assert [r["doc_id"] for r in found if not r["verified"]] == [77]
