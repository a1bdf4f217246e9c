"""Merkle manifest of a dataset, in blocks of van Emde Boas layout.

A row is a leaf: the digest of its fields. Each source is a tree of its leaves by doc_id, in which every three
consecutive nodes have a parent, and the sources' roots form a tree of their own, whose root stands for the dataset.

A tree is cut into aligned blocks of BLOCK_LEVELS levels above 243 leaves. A block is stored as one array of digests in
van Emde Boas order: the tree is split at half its height, first comes the upper part and then each lower part, all laid out
in the same way. So a path from leaf to root stays within few stretches, whatever a cache line holds. Where a node lies
follows from its level and place alone, both for building a block and for taking siblings from it. The roots of the
blocks are the leaves of the next band of blocks, until a tree has one block. Sibling paths go down the other way: a block
hands to each of its leaves what lies beside the path above it, so that a document needs only its own block and one path.

Leaves are numbered by a sort by range with sums over partitions, and blocks are built where they are hashed to, so a
source with most of the rows is spread over all tasks. A task holds one block at a time, and a few finished ones.

Odd cases: a null field is ``-``, an empty text ``0:``. Null sources come first and are one source; null doc_ids come
first within their source. Rows that share a doc_id are leaves of their own, in the order of their digests. An empty
table has no rows and no root. Only doc_id, source, lang, n_chars and text are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import map_batches, numbered
from tallyframe.session import cut_lineage, scratch_path

FANOUT = 3
BLOCK_LEVELS = 5  # above a block's leaves
TOGETHER = 64  # finished blocks that a task hands on at once
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<place: int, siblings: array<binary>>>"


# -- layout ---------------------------------------------------------------------------------------
def nodes_of(levels: int) -> int:
    """Nodes of a complete tree of that many levels of nodes."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, place: int) -> int:
    """Where the node number ``place`` of the level ``depth`` below the root lies in van Emde Boas order."""
    at = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth -= upper
        tree, place = divmod(place, FANOUT**depth)
        at += nodes_of(upper) + tree * nodes_of(levels - upper)
        levels -= upper
    return at


@lru_cache(maxsize=16)
def addresses(levels: int) -> list[list[int]]:
    """Addresses by level, from the leaves (0) to the root, and place."""
    return [[address(levels, depth, i) for i in range(FANOUT**depth)] for depth in reversed(range(levels))]


def height_of(n: int, most: int = BLOCK_LEVELS) -> int:
    """Levels above the leaves of a block in a tree (or band) of ``n`` leaves."""
    height = 0
    while height < most and FANOUT**height < n:
        height += 1
    return height


def parent(children: list[bytes]) -> bytes:
    return sha256("".join([c.hex() for c in children]).encode()).digest()


def build(digests: list[bytes], height: int) -> bytes:
    """The nodes of a block in van Emde Boas order; places beyond the last leaf's path are zero."""
    where, out = addresses(height + 1), bytearray(32 * nodes_of(height + 1))
    for level in range(height + 1):
        for i, digest in enumerate(digests):
            at = 32 * where[level][i]
            out[at : at + 32] = digest
        if level < height:
            digests = [parent(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)]
    return bytes(out)


def path_in(nodes: bytes, height: int, count: int, place: int) -> list[tuple[int, list[bytes]]]:
    """From leaf to root, of each run of siblings the place of the path's node and the others, left to right."""
    where, out = addresses(height + 1), []
    for level in range(height):
        first = place - place % FANOUT
        others = [i for i in range(first, min(first + FANOUT, count)) if i != place]
        out.append((place - first, [nodes[32 * where[level][i] : 32 * where[level][i] + 32] for i in others]))
        place, count = place // FANOUT, -(-count // FANOUT)
    return out


def fold(leaf: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that follows from a leaf and what lies beside its path."""
    for place, siblings in path:
        leaf = parent([*siblings[:place], leaf, *siblings[place:]])
    return leaf


# -- leaves ---------------------------------------------------------------------------------------
def leaf(text: Column | None = None) -> Column:
    """The digest (binary) of a row's fields, or of what they are with another ``text``."""
    def framed(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    values = [F.col(c) if c != "text" or text is None else text for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*map(framed, values)), 256))


# -- blocks ---------------------------------------------------------------------------------------
BLOCK = "block bigint, n bigint, root binary, nodes binary, items array<struct<{item}>>"


def _band(rows: DataFrame, item: str, path: str) -> DataFrame:
    """The blocks, stored at ``path``, of ``rows`` (source, place, n, digest, item: a struct or null)."""
    size = FANOUT**BLOCK_LEVELS

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, digests, items, of = [], None, [], [], 0

        def close() -> None:
            if key is not None:
                height = height_of(of)
                nodes = build(digests, height)
                root = 32 * addresses(height + 1)[height][0]
                done.append((*key, of, nodes[root : root + 32], nodes, items))

        def flush() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [()] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kind.types, strict=True)], kind.names)

        kind = None
        for batch in batches:
            if kind is None:
                kind = pa.schema(
                    [
                        ("source", pa.string()),
                        ("block", pa.int64()),
                        ("n", pa.int64()),
                        ("root", pa.binary()),
                        ("nodes", pa.binary()),
                        ("items", pa.list_(batch.schema.field("item").type)),
                    ]
                )
            columns = (batch.column(c).to_pylist() for c in ("source", "block", "n", "digest", "item"))
            for source, block, n, digest, value in zip(*columns, strict=True):
                if (source, block) != key:
                    close()
                    key, digests, items, of = (source, block), [], [], n
                digests.append(digest)
                items.append(value)
            if len(done) >= TOGETHER:
                yield flush()
                done = []
        close()
        if done:
            yield flush()

    block = F.floor(F.col("place") / size).cast("long").alias("block")
    dealt = rows.select("source", block, "place", "n", "digest", "item").repartition("source", "block")
    dealt = dealt.sortWithinPartitions("source", "block", "place").drop("place")
    schema = "source string, " + BLOCK.format(item=item)
    map_batches(dealt, make, schema).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _bands(rows: DataFrame, item: str, path: str) -> list[DataFrame]:
    """All bands of the trees of ``rows``, the lowest first; the last block of each tree has its root."""
    size, bands = FANOUT**BLOCK_LEVELS, []
    while True:
        bands.append(_band(rows, item, f"{path}/band={len(bands)}"))
        more = bands[-1].filter(F.col("n") > size)
        if more.isEmpty():
            return bands
        rows = more.select(
            "source",
            F.col("block").alias("place"),
            F.ceil(F.col("n") / size).cast("long").alias("n"),
            F.col("root").alias("digest"),
            F.lit(None).cast(f"struct<{item}>").alias("item"),
        )


@dataclass(frozen=True)
class Manifest:
    """Stored blocks: the bands of the documents' trees and those of the tree of sources, the lowest first.

    A block has source, block (its number in its band), n (leaves of its tree in this band), root, nodes (van Emde Boas
    order) and items: of the lowest band doc_id and claim, of the sources' lowest band the source.
    """

    path: str
    documents: list[DataFrame]
    sources: list[DataFrame]

    def root(self) -> str | None:
        """The digest that stands for the dataset, in hex; None for an empty one."""
        top = self.sources[-1].select("root").first()
        return top and bytes(top["root"]).hex()


def manifest(rows: DataFrame, path: str | None = None) -> Manifest:
    """The manifest of ``rows`` (doc_id, source, digest and claim), stored below ``path``.

    ``claim`` is the digest that another copy of the row has, which ``verified`` tests; null: the same.
    """
    path = path or scratch_path(rows.sparkSession, "manifest")
    item = f"doc_id: {rows.schema['doc_id'].dataType.simpleString()}, claim: binary"
    tied = rows.select("source", "doc_id", "digest", "claim", F.monotonically_increasing_id().alias("rid"))
    leaves = numbered(tied, ["source", "doc_id", "digest", "rid"], ["source"], "place", "n")
    documents = _bands(leaves.select("source", "place", "n", "digest", F.struct("doc_id", "claim").alias("item")), item, f"{path}/documents")
    size = FANOUT**BLOCK_LEVELS
    subroots = [b.filter(F.col("n") <= size).select("source", F.col("root").alias("digest")) for b in documents]
    every = subroots[0]
    for more in subroots[1:]:
        every = every.union(more)
    ordered = numbered(every, ["source"], [], "place", "n")
    nodes = ordered.select(F.lit(None).cast("string").alias("source"), "place", "n", "digest", F.struct("source").alias("item"))
    return Manifest(path, documents, _bands(nodes, "source: string", f"{path}/sources"))


def open_manifest(spark: SparkSession, path: str) -> Manifest:
    """A manifest that ``manifest`` has stored at ``path``."""

    def bands(kind: str) -> list[DataFrame]:
        last = spark.read.parquet(f"{path}/{kind}").agg(F.max("band")).first()[0] or 0
        return [spark.read.parquet(f"{path}/{kind}/band={k}") for k in range(last + 1)]

    return Manifest(path, bands("documents"), bands("sources"))


# -- paths ----------------------------------------------------------------------------------------
_STEP = pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.binary()))])
_STEPS, _TEXT, _INT, _BIN = pa.list_(_STEP), pa.string(), pa.int64(), pa.binary()


def _steps(path: list[tuple[int, list[bytes]]]) -> list[dict]:
    return [{"place": place, "siblings": siblings} for place, siblings in path]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each block: source, block, height, nodes, addresses of the leaves, items, path above, subroot, root of all."""
    names = ("source", "block", "n", "nodes", "items", "path", "subroot", "top")
    for at in range(batch.num_rows):
        source, block, n, nodes, items, path, subroot, top = (batch.column(c)[at].as_py() for c in names)
        height = height_of(n)
        above = [(step["place"], step["siblings"]) for step in path or []]
        yield source, block, height, nodes, addresses(height + 1)[0], items, above, subroot, top


def _below(blocks: DataFrame, of_sources: bool) -> DataFrame:
    """Of each leaf of ``blocks`` (with path, subroot and top): source, block (its place), path to the top, subroot, top.

    The leaves of the lowest ``blocks`` of sources are the sources' roots.
    """
    names, kinds = ["source", "block", "path", "subroot", "top"], [_TEXT, _INT, _STEPS, _BIN, _BIN]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, block, height, nodes, where, items, above, subroot, top in _opened(batch):
                rows = []
                for place, own in enumerate(items):
                    path = _steps(path_in(nodes, height, len(items), place) + above)
                    if of_sources:
                        rows.append((own["source"], 0, path, nodes[32 * where[place] : 32 * where[place] + 32], top))
                    else:
                        rows.append((source, block * FANOUT**BLOCK_LEVELS + place, path, subroot, top))
                yield _batch(rows, names, kinds)

    return map_batches(blocks, go, f"source string, block bigint, path {PATH}, subroot binary, top binary")


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``blocks`` with the path above each of them; ``above`` has a row per block."""
    named = above.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "path", "subroot", "top")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    return blocks.join(named, same).drop("_source", "_block")


def _placed(found: Manifest) -> DataFrame:
    """The lowest blocks of documents with the path above each."""
    top = found.sources[-1]
    blocks = top.withColumns({"path": F.lit(None).cast(PATH), "subroot": F.lit(None).cast("binary"), "top": F.col("root")})
    for lower in reversed(found.sources[:-1]):
        blocks = _with_paths(lower, cut_lineage(_below(blocks, False), "paths"))
    above = cut_lineage(_below(blocks, True), "paths")  # a row per source
    single, upper = F.col("n") <= FANOUT**BLOCK_LEVELS, None
    for band in reversed(found.documents):
        placed = _with_paths(band.filter(single), above)  # trees that have one block in this band end in it
        if upper is not None:
            placed = placed.unionByName(_with_paths(band.filter(~single), upper))
        if band is not found.documents[0]:
            upper = cut_lineage(_below(placed, False), "paths")
    return placed


def _documents(found: Manifest, columns: list[tuple[str, str, pa.DataType]], row_of) -> DataFrame:
    """A row per document: doc_id, source and ``columns``, which ``row_of`` makes of leaf, path and its block."""
    doc_id = found.documents[0].schema["items"].dataType.elementType["doc_id"].dataType
    names = ["doc_id", "source", *[c for c, _, _ in columns]]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field("items").type.value_type.field("doc_id").type, _TEXT, *[k for _, _, k in columns]]
            for source, block, height, nodes, where, items, above, subroot, top in _opened(batch):
                rows = []
                for place, item in enumerate(items):
                    leaf = nodes[32 * where[place] : 32 * where[place] + 32]
                    path = path_in(nodes, height, len(items), place) + above
                    number = block * FANOUT**BLOCK_LEVELS + place
                    rows.append((item["doc_id"], source, *row_of(leaf, path, number, item["claim"], subroot, top)))
                yield _batch(rows, names, kinds)

    schema = ", ".join([f"doc_id {doc_id.simpleString()}, source string", *[f"{c} {t}" for c, t, _ in columns]])
    return map_batches(_placed(found), go, schema)


def proofs(found: Manifest) -> DataFrame:
    """One row per document: doc_id, source, place (in its source), leaf, path, subroot, root; digests are binary.

    ``path``: from the leaf to the root, the node's place in its run of siblings and the others' digests.
    """
    columns = [("place", "bigint", _INT), ("leaf", "binary", _BIN), ("path", PATH, _STEPS), ("subroot", "binary", _BIN), ("root", "binary", _BIN)]
    return _documents(found, columns, lambda leaf, path, number, _, subroot, top: (number, leaf, _steps(path), subroot, top))


def verified(found: Manifest) -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified; digests in hex.

    ``proof_sha256`` is the digest of all siblings. ``folded_root`` follows from the claim and the manifest's siblings.
    """

    def row(leaf: bytes, path: list, _: int, claim: bytes | None, subroot: bytes, top: bytes) -> tuple:
        proof = parent([s for _, siblings in path for s in siblings])
        folded = fold(claim or leaf, path)
        return *(d.hex() for d in (leaf, subroot, top, proof, folded)), folded == top

    digests = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    return _documents(found, [*((c, "string", _TEXT) for c in digests), ("verified", "boolean", pa.bool_())], row)
