"""Digest trees: a side stored in ranges of its key's hash, with digests of the ranges in levels above them.

Two sides that are stored alike are compared from the top: equal roots end it after one row, and only children of unequal
nodes are looked at below. What is left are the ranges (of the groups) that differ, and only their folders of rows are read.

A digest is the number of rows and six sums of pieces of two 64-bit row hashes, each taken modulo 2**40, so it does not depend on the
order of rows, adds up over ranges, and cannot overflow at any number of ranges of up to 2**41 rows. Different digests
prove a difference. Equal ones leave a chance of about 2**-122 for tables that were not made to collide; xxHash is no
cryptographic hash, so tables of an adversary need :func:`tallyframe.operators.equality.multiset_diff`.

Ranges come from the key's hash, so that they are about equally large; a key that holds many rows makes its range large, and
its rows are written by many tasks. The tree has up to 2**16 ranges, each with a row of digests per group that it holds.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.tagged import quoted
from tallyframe.session import cut_lineage

RANGE, NODE, LEVEL = "_range", "_node", "_level"
FAN_BITS = 4  # children of a node: 16
MOST_BITS = 16
_PIECES = [f"d{k}" for k in range(6)]
_MODULUS = 1 << 40
_SUMMED = ["n_rows", "n_keys", "n_repeated", *_PIECES]


def _pieces(cols: Sequence[str]) -> list[Column]:
    values = [F.col(quoted(c)) for c in cols]
    out = []
    for h in (F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)):
        out += [F.shiftrightunsigned(h, 42), F.shiftrightunsigned(h, 21).bitwiseAND(F.lit((1 << 21) - 1)), h.bitwiseAND(F.lit((1 << 21) - 1))]
    return [p.alias(n) for p, n in zip(out, _PIECES, strict=True)]


def _sums() -> list[Column]:
    counts = [F.sum(c).alias(c) for c in ("n_rows", "n_keys", "n_repeated")]
    return [*counts, *[F.pmod(F.sum(p), F.lit(_MODULUS)).alias(p) for p in _PIECES], F.min("min_ts").alias("min_ts")]


@dataclass(frozen=True)
class DigestTree:
    """A stored side: ``data`` with its rows in folders by range, ``levels`` of digests, and what it was made of."""

    spark: SparkSession
    path: str
    meta: dict = field(hash=False)

    @property
    def by(self) -> list[str]:
        return self.meta["by"]

    @property
    def top(self) -> int:
        return -(-self.meta["bits"] // FAN_BITS)

    def data(self) -> DataFrame:
        return self.spark.read.schema(self.meta["rows"]).parquet(f"{self.path}/data")

    def level(self, k: int) -> DataFrame:
        """Digests by group and node; level 0 has the ranges, the top one node."""
        return self.spark.read.parquet(f"{self.path}/levels/{LEVEL}={k}")

    def root(self) -> tuple | None:
        """Counts and digest of the whole side; None for an empty one."""
        row = self.spark.read.parquet(f"{self.path}/root").first()
        return tuple(row) if row["n_rows"] else None


def save_digested(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    by: Sequence[str] = (),
    bits: int = 8,
    cols: Sequence[str] | None = None,
    ts_col: str | None = None,
) -> DigestTree:
    """Store ``df`` below ``path`` in 2**bits ranges of its keys, with digests of ``cols`` (all by default).

    One shuffle lays the rows out and one counts the keys. ``by`` columns have digests of their own. With ``ts_col``, the
    earliest time of each range comes along. Rows with a null key count, but not as keys.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"bits is at most {MOST_BITS}")
    keys, by, cols = list(keys), list(by), list(df.columns if cols is None else cols)
    if lost := [c for c in (*keys, *by, *cols) if c not in df.columns]:
        raise ValueError(f"no column {', '.join(lost)}")
    own = F.shiftrightunsigned(F.xxhash64(*[F.col(quoted(k)) for k in keys]), 64 - bits) if bits else F.lit(0)
    ranged = df.withColumn(RANGE, own.cast("int"))
    # By size: a range with most of the rows is split over tasks, small ones share files.
    ranged.hint("rebalance", F.col(RANGE)).write.partitionBy(RANGE).parquet(f"{path}/data")
    spark = df.sparkSession
    meta = {"keys": keys, "by": by, "bits": bits, "cols": cols, "types": [t for c, t in df.dtypes if c in cols], "ts_col": ts_col}
    meta["rows"] = ", ".join(f"{quoted(c)} {t}" for c, t in ranged.dtypes)
    tree = DigestTree(spark, path.rstrip("/"), meta)
    stored = tree.data()

    known = F.lit(True)
    for k in keys:
        known &= F.col(quoted(k)).isNotNull()
    time = (F.col(quoted(ts_col)) if ts_col else F.lit(None).cast("timestamp_ntz")).alias("min_ts")
    group = [*[F.col(quoted(c)).alias(f"_b{i}") for i, c in enumerate(by)], F.col(RANGE).alias(NODE)]
    names = [*[f"_b{i}" for i in range(len(by))], NODE]
    moved = stored.select(*group, *[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)], known.alias("_known"), time, *_pieces(cols))
    per_key = moved.groupBy(*names, *[f"_k{i}" for i in range(len(keys))], "_known").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.pmod(F.sum(p), F.lit(_MODULUS)).alias(p) for p in _PIECES], F.min("min_ts").alias("min_ts")
    )
    counted = per_key.withColumns(
        {"n_keys": F.col("_known").cast("long"), "n_repeated": (F.col("_known") & (F.col("n_rows") > 1)).cast("long")}
    )
    level = counted.groupBy(*names).agg(*_sums())
    for k in range(tree.top + 1):
        level.write.parquet(f"{path}/levels/{LEVEL}={k}")
        level = spark.read.parquet(f"{path}/levels/{LEVEL}={k}")
        if k < tree.top:
            parents = level.withColumn(NODE, F.shiftright(NODE, FAN_BITS))
            level = parents.groupBy(*names).agg(*_sums())
    whole = level.agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(_sums()[:-1], _SUMMED, strict=True)])
    whole.coalesce(1).write.parquet(f"{path}/root")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")
    return tree


def open_digested(spark: SparkSession, path: str) -> DigestTree:
    """A side that :func:`save_digested` has stored; its last step writes what is read here first."""
    return DigestTree(spark, path.rstrip("/"), json.loads(spark.read.parquet(f"{path}/meta").first()["meta"]))


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out &= F.col(x).eqNullSafe(F.col(y))
    return out


def unequal_ranges(primary: DigestTree, replicated: DigestTree) -> DataFrame | None:
    """The groups (``_b0`` …) and ranges (``_node``) whose rows differ, stored; None if the sides are equal.

    Reads the roots, and below them the digests of unequal nodes' children; no rows of the sides.
    """
    if primary.meta != replicated.meta:
        raise ValueError("the sides are not stored alike: keys, groups, columns, types and ranges must be the same")
    if primary.root() == replicated.root():
        return None
    names = [*[f"_b{i}" for i in range(len(primary.by))], NODE]
    open_ = None
    for k in range(primary.top, -1, -1):
        sides = []
        for tree in (primary, replicated):
            level = tree.level(k)
            if open_ is not None:
                parents = open_.select(*[F.col(n).alias(f"_p{i}") for i, n in enumerate(names)])
                child = level.withColumn("_up", F.shiftright(NODE, FAN_BITS))
                level = child.join(parents, _same([*names[:-1], "_up"], [f"_p{i}" for i in range(len(names))]), "left_semi").drop("_up")
            sides.append(level)
        right = sides[1].select(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)], *[F.col(c).alias(f"_r{c}") for c in _SUMMED])
        joined = sides[0].join(right, _same(names, [f"_r{i}" for i in range(len(names))]), "full")
        differs = F.lit(False)
        for c in _SUMMED:
            differs |= ~F.col(c).eqNullSafe(F.col(f"_r{c}"))
        one = F.col(_SUMMED[0]).isNotNull()
        found = joined.where(differs).select(*[F.when(one, F.col(n)).otherwise(F.col(f"_r{i}")).alias(n) for i, n in enumerate(names)])
        open_ = cut_lineage(found, "unequal")
    return open_


@dataclass(frozen=True)
class Changed:
    """The rows in unequal ranges of both sides, and totals by group of what is equal and was not read."""

    primary: DataFrame
    replicated: DataFrame
    equal: DataFrame


def changed_rows(primary: DigestTree, replicated: DigestTree) -> Changed:
    """The rows that can differ: those of unequal ranges, from the folders of these ranges alone.

    ``equal`` has the ``by`` columns, n_rows, n_keys, n_repeated and min_ts (of the primary) of all other ranges.
    """
    by, names = primary.by, [*[f"_b{i}" for i in range(len(primary.by))], NODE]
    open_ = unequal_ranges(primary, replicated)
    leaves, ranges = primary.level(0), []
    if open_ is not None:
        ranges = sorted(r[NODE] for r in open_.select(NODE).distinct().collect())  # 2**MOST_BITS at most
        found = open_.select(*[F.col(n).alias(f"_o{i}") for i, n in enumerate(names)])
        leaves = leaves.join(found, _same(names, [f"_o{i}" for i in range(len(names))]), "left_anti")
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "n_keys", "n_repeated")] + [F.min("min_ts").alias("min_ts")]
    groups = [F.col(f"_b{i}").alias(c) for i, c in enumerate(by)]
    equal = leaves.groupBy(*groups).agg(*totals) if by else leaves.agg(*totals)

    def rows(tree: DigestTree) -> DataFrame:
        data = tree.data().where(F.col(RANGE).isin(ranges)) if ranges else tree.data().limit(0)
        if by and ranges:
            same = _same([*map(quoted, by), RANGE], [f"_o{i}" for i in range(len(names))])
            data = data.join(found, same, "left_semi")
        return data.drop(RANGE)

    return Changed(rows(primary), rows(replicated), cut_lineage(equal, "equal"))
