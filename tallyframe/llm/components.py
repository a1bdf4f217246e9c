"""Connected components by contraction: a few joins over ever fewer edges, each round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage


def _undirected(edges: DataFrame, a, b) -> DataFrame:
    return edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b; integers); nodes are connected iff their labels are equal.

    In each round every node moves to its first neighbour and edges follow. "First" is by value in
    even rounds, which folds stars at once, and by a hash in odd ones, which shortens chains by a
    share; so rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    edges = cut_lineage(_undirected(edges, F.col("a"), F.col("b")), "edges")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        if len(moves) % 2 == 0:
            first = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        else:
            rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("h"), c.alias("v"))
            first = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
            first = first.select("a", F.least("m", rank(F.col("a")))["v"].alias("b"))
        move = cut_lineage(first.select(F.col("a").alias("node"), F.col("b").alias("label")), "moves")
        moves.append(move)
        at_a = move.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
        at_b = move.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
        moved = edges.join(at_a, "a").join(at_b, "b")
        edges = cut_lineage(_undirected(moved, F.col("label_a"), F.col("label_b")), "edges")
    if not moves:
        return spark.createDataFrame([], "node bigint, label bigint")
    labels = moves[-1]
    for move in reversed(moves[:-1]):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("later"))
        labels = cut_lineage(
            move.join(later, "label", "left").select("node", F.coalesce("later", "label").alias("label")), "labels"
        )
    return labels
