"""SimHash near-duplicates, with candidates from pigeonring chains.

A fingerprint of 64 bits is a ring of four segments. If two fingerprints differ in at most three
bits, some segment starts a chain whose cumulative differences stay within the proportional budgets
3/4, 6/4 and 9/4: the first segment is equal, the second differs in at most one bit and both together
with the third in at most two. So one half of the second segment and one third of the third are equal
as well. Start, half and third give 24 keys of 29 to 30 bits; each pair of at most three different
bits shares one of them. Pairs of a key are tested along the chain before their full distance is taken.

Equal fingerprints are one node. A key's nodes meet in one task if they are few; a larger group is
dealt in chunks over cells, one for each pair of chunks. A task emits a spanning forest of the links
that it finds, never all pairs. Components come from contracting these edges.

``drop_near_duplicates`` has a similarity that goes far beyond three bits. Its first links are those that chains find,
verified by the exact similarity; an exact set-similarity join over hashed windows, with prefix, length and positional
filters, then finds the pairs that are still apart.

Odd cases: null, empty and white-space-only texts have the fingerprint zero and are linked like any
other. Rows that share a doc_id are rows of their own. Only doc_id and text are read by
``near_duplicates``; ``drop_near_duplicates`` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import CHUNK, dealt_in_cells, free_prefix, group_ends, in_slices, map_batches, of_planes, planes, rows_in_bitmap, whole_groups, without
from tallyframe.llm.components import components
from tallyframe.session import cut_lineage

SEGMENT = 0xFFFF
HALVES = ((0, 8), (8, 8))
THIRDS = ((0, 5), (5, 5), (10, 6))
_SUM_ROWS = 1 << 15
FREQUENT = 50_000  # windows whose rank is known; all others count as rare
SAMPLED = 1  # all texts are read for the ranks, whatever this says; only a test names it
SLOT_BITS = 28  # of a window's hash, by which windows are counted first
BUCKET_BITS = 10
WINDOWS_AT_ONCE = 1 << 20  # that are counted together
KEPT = 256  # slots of a bucket whose windows are counted one by one


def window_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's windows, in order; a text of fewer words is one window, one without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.empty(0, np.uint64)
    whole = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    else:
        spans = [(0, len(whole))]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], 42) for a, b in spans], np.uint64)


def fingerprint(text: str | None, words: int = 3, count: int = 1) -> list[int]:
    """``count`` fingerprints of a text, unsigned. The first one has the bits of XXH64 with seed 42."""
    return _fingerprint_of(window_hashes(text, words), count)


def _fingerprint_of(hashes: np.ndarray, count: int = 1) -> list[int]:
    """The fingerprints of a text from the hashes of its windows, repeats included."""
    if not len(hashes):
        return [0] * count
    out = []
    for k in range(count):
        mixed = hashes if k == 0 else _mixed(hashes, k)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(mixed), _SUM_ROWS):
            part = mixed[at : at + _SUM_ROWS].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(mixed)).tobytes(), "big"))
    return out


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """Another 64-bit hash made of ``x`` (the finaliser of splitmix64 with an offset)."""
    x = x + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_fingerprints(docs: DataFrame, names: list[str], words: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with columns of these names: a fingerprint each, as signed 64-bit integers."""
    count = len(names)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words, count) for t in batch.column(text).to_pylist()]
            made = np.array(found, np.uint64).reshape(-1, count).view(np.int64)
            columns = [*batch.columns, *[pa.array(made[:, k]) for k in range(count)]]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return map_batches(docs, add, schema)


def _bits(f, shift: int, width: int):
    """``width`` bits of a fingerprint from ``shift``, counted from the lowest."""
    return F.shiftrightunsigned(f, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def chain_keys(fingerprints: list[str]):
    """An array of all chain keys: fingerprint, start, half and third, with the bits that must be equal."""
    keys, code = [], 0
    for f in fingerprints:
        for start in range(4):
            a, b, c = (16 * ((start + i) % 4) for i in range(3))
            for half, half_bits in HALVES:
                for third, third_bits in THIRDS:
                    bits = F.shiftleft(_bits(F.col(f), a, 16), 14)
                    bits = bits.bitwiseOR(F.shiftleft(_bits(F.col(f), b + half, half_bits), 6))
                    bits = bits.bitwiseOR(_bits(F.col(f), c + third, third_bits))
                    keys.append(bits.bitwiseOR(F.lit(code << 30).cast("long")))
                    code += 1
    return F.array(*keys)


def _linked(x: np.ndarray, y: np.ndarray, key: np.ndarray, budget: int, limit: int) -> np.ndarray:
    """Which pairs of fingerprint rows stay within the chain's budgets and then within ``limit`` in all."""
    code = (key >> 30) // 6
    which, start = code // 4, code % 4
    rows = np.arange(len(x))
    differ = x[rows, which] ^ y[rows, which]
    alive, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for step in range(1, 4):
        shift = (16 * ((start + step - 1) % 4)).astype(np.uint64)
        total += np.bitwise_count((differ >> shift) & np.uint64(SEGMENT))
        alive &= 4 * total <= step * budget
    kept = np.flatnonzero(alive)
    alive[kept] = np.bitwise_count(x[kept] ^ y[kept]).sum(1, dtype=np.int64) <= limit
    return alive


def _labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the rows ``i`` and ``j``; a label is the first row of its set."""
    while True:
        a, b = label[i], label[j]
        if not (open_ := a != b).any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (jumped := label[label] != label).any():
            label = np.where(jumped, label[label], label)


def _forest(key: np.ndarray, cell: np.ndarray, node: np.ndarray, f: np.ndarray, budget: int, limit: int) -> tuple:
    """Edges of a spanning forest of the links inside each (key, cell); rows come sorted by these."""
    n, end = len(key), group_ends([key, cell])
    label, lag = np.arange(n), 1
    rows = np.flatnonzero(np.arange(n) + 1 < end)
    while len(rows):
        open_ = rows[label[rows] != label[rows + lag]]
        if len(open_):
            hit = open_[_linked(f[open_], f[open_ + lag], key[open_], budget, limit)]
            if len(hit):
                label = _labels(label, hit, hit + lag)
        lag += 1
        rows = rows[rows + lag < end[rows]]
    moved = np.flatnonzero(label != np.arange(n))
    return node[moved], node[label[moved]]


def links(nodes: DataFrame, fingerprints: list[str], budget: int = 3, limit: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between ``node`` ids whose components are those of all links.

    All links of at most three bits in one of the ``fingerprints`` are found, if ``budget`` and ``limit``
    allow them. ``budget``: of the chain, in bits of one fingerprint. ``limit``: over all fingerprints.
    """
    keyed = nodes.select("node", *fingerprints, F.explode(chain_keys(fingerprints)).alias("key"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell, node, *f in whole_groups(batches, ["key", "cell"], ["node", *fingerprints]):
            a, b = _forest(key, cell, node, np.stack(f, 1).view(np.uint64), budget, limit)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_batches(dealt_in_cells(keyed, "key", "node", chunk), compare, "a bigint, b bigint")


def _grouped(prints: DataFrame, names: list[str], budget: int, limit: int) -> DataFrame:
    """``names``, and of the component: the row that stays (keep_doc, keep_rid)."""
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    nodes = cut_lineage(prints.groupBy(*names).agg(F.min("rid").alias("node"), F.min(order).alias("first")), "nodes")
    labels = components(links(nodes, names, budget, limit))
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = cut_lineage(labelled.select(*names, "label", "first"), "labelled")
    firsts = labelled.groupBy("label").agg(F.min("first").alias("keep"))
    groups = labelled.join(cut_lineage(firsts, "firsts"), "label")
    keep = (F.col("keep.doc_id").alias("keep_doc"), F.col("keep.rid").alias("keep_rid"))
    return cut_lineage(groups.select(*names, *keep), "groups")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept.

    Fingerprints link if they differ in at most three bits; component_id is the smallest doc_id that
    links reach, and the row that has it is kept.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")
    prints = cut_lineage(with_fingerprints(rows, ["_f0"], words).drop("text"), "prints")
    groups = _grouped(prints, ["_f0"], 3, 3)
    return prints.join(groups, "_f0").select(
        "doc_id",
        F.lpad(F.lower(F.hex("_f0")), 16, "0").alias("fingerprint"),
        F.col("keep_doc").alias("component_id"),
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
    )


# -- near-duplicates by exact similarity of window sets -------------------------------------------
def _frequent_windows(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that several texts have, sorted, and their ranks from 1 for the least frequent; at most FREQUENT.

    They are counted over all texts, since a window that one text in a thousand has makes as many pairs as that is of all
    texts, squared. Most windows occur once. So all are counted by a part of their hash first, and one by one then only those
    of the most frequent slots, unless a window of another slot could be among the FREQUENT: then all are. Any order of
    windows is correct as long as all texts use the same; this one only makes the join fast.
    """
    slots, left = _frequent_slots(docs.select("text"), words)
    top = _counted_windows(docs.select("text"), words, slots)
    if left > 1 and (len(top) < FREQUENT or top[-1]["n"] < left):
        top = _counted_windows(docs.select("text"), words, None)
    known = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], (len(top) - np.arange(len(top)))[order]


def _windows_together(batches: Iterator[pa.RecordBatch], words: int, part) -> Iterator[np.ndarray]:
    """``part`` of the windows of the texts in ``batches``, sorted, once for each text that has them, WINDOWS_AT_ONCE or somewhat more at a time."""
    held, size = [], 0
    for batch in in_slices(batches):
        windows = np.concatenate([np.unique(window_hashes(t, words)) for t in batch.column(0).to_pylist()])
        windows.sort()
        held.append(part(windows))
        size += len(held[-1])
        if size >= WINDOWS_AT_ONCE:
            together, held, size = np.concatenate(held), [], 0
            together.sort()
            yield together
    if size:
        yield np.sort(np.concatenate(held))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values of ``x`` starts, and its length."""
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return starts, np.diff(np.append(starts, len(x)))


def _slots(windows: np.ndarray, bits: int) -> np.ndarray:
    return (windows >> np.uint64(64 - bits)).astype(np.uint32)


def _frequent_slots(texts: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """Of each bucket the KEPT slots that most windows of ``texts`` fall in, sorted, and how many fall in one that is left out at most.

    A slot is the first SLOT_BITS of a window's hash. Slots with their counts travel by buckets, many in a row.
    """
    bits, width = SLOT_BITS, SLOT_BITS - BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot in _windows_together(batches, words, lambda w: _slots(w, bits)):
            starts, n = _runs(slot)
            slot, n = slot[starts], n.astype(np.uint32)
            bucket, within = (slot >> np.uint32(width)).astype(np.int32), slot & np.uint32((1 << width) - 1)
            first, size = _runs(bucket)
            steps = np.diff(within, prepend=within[:1])
            steps[first] = within[first]
            packed = [pa.array([planes(x[i : i + k]) for i, k in zip(first, size, strict=True)], pa.binary()) for x in (steps, n)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *packed], ["bucket", "steps", "n"])

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groupby(((b, k) for b in batches for k in range(b.num_rows)), lambda x: x[0].column(0)[x[1]].as_py()):
            counts = np.zeros(1 << width, np.int64)
            for b, k in rows:
                counts[np.cumsum(of_planes(b.column(1)[k].as_py(), np.uint32))] += of_planes(b.column(2)[k].as_py(), np.uint32)
            kept = min(KEPT, len(counts) - 1)
            order = np.argpartition(-counts, kept)
            some = order[:kept][counts[order[:kept]] > 1].astype(np.uint32) + np.uint32(bucket << width)
            yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()], pa.binary()), pa.array([counts[order[kept]]])], ["slots", "rest"])

    packed = map_batches(texts, count, "bucket int, steps binary, n binary")
    packed = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = map_batches(packed, most, "slots binary, rest bigint").collect()
    slots = np.frombuffer(b"".join(bytes(r["slots"]) for r in found), np.uint32)
    return np.sort(slots), max((r["rest"] for r in found), default=0)


def _counted_windows(texts: DataFrame, words: int, slots: np.ndarray | None) -> list[Row]:
    """The FREQUENT most frequent windows (key, n) that several ``texts`` have, of those in ``slots`` if it is given."""

    bits = SLOT_BITS

    def counted(windows: np.ndarray) -> np.ndarray:
        if slots is None:
            return windows
        slot = _slots(windows, bits)
        return windows[slots[np.minimum(np.searchsorted(slots, slot), len(slots) - 1)] == slot]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for windows in _windows_together(batches, words, counted):
            starts, n = _runs(windows)
            yield pa.RecordBatch.from_arrays([pa.array(windows[starts].view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    if slots is not None and not len(slots):
        return []
    counts = map_batches(texts, count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    return counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()


def window_parity(windows: np.ndarray) -> bytes:
    """Bits of the parity of a set of windows, as many as it has windows, rounded up to a power of two.

    Windows go by their low bits, so a longer parity folds into a shorter one.
    """
    size = max(64, 1 << (len(windows) - 1).bit_length()) if len(windows) else 64
    odd = np.bincount((windows & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of windows that one of two sets has alone, from their parities."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _with_prefixes(docs: DataFrame, names: list[str], words: int, similarity: float) -> DataFrame:
    """``docs`` with columns of these names: a 128-bit hash of the set of windows, its size, its prefix and its parity, and the fingerprint."""
    known, ranks = _frequent_windows(docs, words)
    kinds = [T.LongType(), T.LongType(), T.IntegerType(), T.ArrayType(T.LongType()), T.BinaryType(), T.LongType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])

    def prefix(windows: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(windows), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, windows), len(known) - 1)
            rank = np.where(known[at] == windows, ranks[at], 0)
        n = len(windows)
        return windows[np.lexsort((windows, rank))[: n - math.ceil(similarity * n - 1e-9) + 1]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            hashes = [window_hashes(t, words) for t in batch.column("text").to_pylist()]
            prints = np.array([_fingerprint_of(h)[0] for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            keys = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), ">i8").reshape(-1, 2).astype(np.int64)
            prefixes = [prefix(s) for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in prefixes], dtype=np.int64))).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *prefixes]).view(np.int64)
            made = [
                pa.array(keys[:, 0]),
                pa.array(keys[:, 1]),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array([window_parity(s) for s in sets], pa.binary()),
                pa.array(prints),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return map_batches(docs, add, schema)


def _candidates(rows: DataFrame, similarity: float, every: bool) -> DataFrame:
    """Pairs (a, b) of nodes that share a key and may be similar, from rows key, node, at (n and place), label.

    Nodes of one label make no pair. Without ``every``, of each key and cell only pairs that span its candidates.
    """
    share = similarity / (1 + similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cell, node, at, label in whole_groups(batches, ["key", "cell"], ["node", "at", "label"]):
            count, end = len(key), group_ends([key, cell])
            n, rest, found = at >> 32, (at >> 32) - (at & 0xFFFFFFFF), []
            joined, lag, rows = np.arange(count), 1, np.flatnonzero(np.arange(count) + 1 < end)
            while len(rows):
                late = rows + lag
                good = np.minimum(rest[rows], rest[late]) >= np.ceil(share * (n[rows] + n[late]) - 1e-9)
                good &= label[rows] != label[late]
                if not every:
                    good &= joined[rows] != joined[late]
                hit = rows[good]
                if len(hit):
                    found.append((node[hit], node[hit + lag]))
                    if not every:
                        joined = _labels(joined, hit, hit + lag)
                lag += 1
                rows = rows[rows + lag < end[rows]]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return map_batches(dealt_in_cells(rows, "key", "node"), compare, "a bigint, b bigint").distinct()


def _close(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` that may be similar by the parities in ``texts`` (node, n, parity), a bit a window each; stored.

    A bound that holds for all, so no similar pair is lost; what it leaves has its whole sets fetched.
    """
    share = similarity / (1 + similarity)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            n = batch.column("n").to_numpy()
            most = n - 2 * np.ceil(share * n - 1e-9)
            sides = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            good = np.array([least_difference(x, y) for x, y in sides], np.int64) <= most
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    texts = rows_in_bitmap(texts.select("node", "n", "parity"), "node", ends)  # most are in no pair
    sides = [texts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(w)) for c, w in (("a", "x"), ("b", "y"))]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "x", "y")
    return cut_lineage(map_batches(joined, check, "a bigint, b bigint"), "close")


def _similar(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` whose sets of windows are similar, taken from ``texts`` (node, n, parity, text) again; stored."""
    pairs = _close(texts, pairs, similarity)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [np.unique(window_hashes(t, words)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "windows"])

    likely = rows_in_bitmap(texts, "node", needed)
    sets = cut_lineage(map_batches(likely.select("node", "text"), read, "node bigint, windows binary"), "sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sides = [sets.select(F.col("node").alias(c), F.col("windows").alias(w)) for c, w in (("a", "x"), ("b", "y"))]
    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y")
    return cut_lineage(map_batches(joined, check, "a bigint, b bigint"), "similar")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of their node, which is the node itself where it has none; stored."""
    rows = rows.select("key", "node", "at").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return cut_lineage(rows.select("key", "node", "at", "label"), "labelled")


def _similarity_edges(rows: DataFrame, prints: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of nodes that are similar, from ``rows`` (key, node, at).

    First come the links that chains find among the fingerprints in ``prints`` (node, _f0), verified. The rest follows by
    shared windows: each key's candidates of different labels are spanned, which keeps large families linear, and then, of
    the keys whose nodes are not yet connected, come all pairs that are neither tested nor connected.
    """
    near = links(prints, ["_f0"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tested = cut_lineage(near.distinct(), "chained")
    linked = _similar(texts, tested, words, similarity)
    shared = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    rows = cut_lineage(rows.join(shared, "key", "left_semi"), "shared")
    found = _candidates(_labelled(rows, components(linked)), similarity, False)
    pairs = cut_lineage(found.join(tested, ["a", "b"], "left_anti"), "pairs")
    edges = linked.union(_similar(texts, pairs, words, similarity))
    labelled = _labelled(rows, components(edges))
    apart = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    rest = _candidates(labelled.join(apart.select("key"), "key", "left_semi"), similarity, True)
    rest = cut_lineage(rest.join(pairs.union(tested), ["a", "b"], "left_anti"), "rest")
    return edges.union(_similar(texts, rest, words, similarity))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id.

    Texts are near-duplicates if their sets of windows of ``words`` words have a Jaccard similarity of
    ``similarity`` or more, or are both empty; links chain. The chains of :func:`near_duplicates` come first, over SimHash
    fingerprints of these windows; what they link is verified. All other such pairs are found, too: they share a window among the
    first n - ceil(similarity n) + 1 of both, by rarity. The parities of the sets, a bit a window, rule out most
    candidates; the others are verified on the whole sets.
    """
    own = free_prefix(docs.columns)
    rid, names = f"{own}rid", [f"{own}{c}" for c in ("k1", "k2", "n", "prefix", "parity", "print")]
    stored = cut_lineage(_with_prefixes(docs.withColumn(rid, F.monotonically_increasing_id()), names, words, similarity), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(rid).alias("rid"))
    keys = [F.col(n).alias(c) for n, c in zip(names[:2], ("k1", "k2"), strict=True)]
    nodes = stored.groupBy(*keys).agg(F.min(rid).alias("node"), F.min(order).alias("first"))
    nodes = cut_lineage(nodes.select("node", "first"), "nodes")
    copies = cut_lineage(stored.select(rid).join(nodes.select(F.col("node").alias(rid)), rid, "left_anti"), "copies")
    firsts = without(stored.select(rid, names[2], names[3], names[5]), rid, copies)
    rows = firsts.select(F.col(rid).alias("node"), F.col(names[2]).cast("long").alias("n"), F.posexplode(names[3]).alias("place", "key"))
    rows = rows.select("key", "node", F.shiftleft("n", 32).bitwiseOR(F.col("place").cast("long")).alias("at"))
    prints = firsts.select(F.col(rid).alias("node"), F.col(names[5]).alias("_f0"))
    texts = stored.select(F.col(rid).alias("node"), F.col(names[2]).alias("n"), F.col(names[4]).alias("parity"), "text")
    labels = components(_similarity_edges(rows, prints, texts, words, similarity))
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    keep = labelled.groupBy("label").agg(F.min("first").alias("first")).select("first.rid")
    dropped = cut_lineage(stored.select(rid).join(keep.select(F.col("rid").alias(rid)), rid, "left_anti"), "dropped")
    return without(stored.select(*docs.columns, rid), rid, dropped).select(*docs.columns)
