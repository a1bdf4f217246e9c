"""Line deduplication by an exact set-similarity join.

A line is the set of its words. A line goes if an earlier line, by doc_id and then position, has a
Jaccard similarity of 0.8 or more with it. Every line that has a word is judged; one of fewer than four words goes by an
equal set only. A caller may have lines of fewer than ``least`` different words stay.

Lines with the same set are one class, which stands where it first occurs. The words of a class are
ordered by rarity: words that are not among the most frequent ones come first. Two similar classes share a
word of their prefixes, the first n - ceil(0.8 n) + 1 words. Classes meet at these words, and the length
filter, the positional filter at the shared word, and the parity of 128 word bits prune the pairs. Then
the words of what is left are fetched, and the Jaccard similarity is verified. A word's classes
meet in cells of bounded size, however frequent it is.

Whether any earlier line matches is all that counts. So a class first offers, for each word and cell, only its
earliest candidate. Classes of which all candidates fail although there were more offer all of them in a
second round. Families of thousands of similar lines thus make one pair per line and word.

Odd cases: null texts have no lines and stay null. Rows that repeat doc_id and text count as one document.
A null doc_id sorts behind all others. Line ends are ``\\n``; words are what white space separates.
``drop_repeated_lines`` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import CHUNK, MAX_HOT, free_prefix, in_slices, map_batches, marked_in_bitmap, of_planes, planes, rows_in_bitmap, without
from tallyframe.session import cut_lineage

SIMILARITY = 0.8
LEAST_WORDS = 1  # the default of ``least``: all lines that have a word
FREQUENT = 50_000  # words whose rank is known; all others count as rare
SHARE = 20_000  # a word is counted where it is at least one in so many
PARITY = ["p0", "p1", "p2", "p3"]  # of 256 word bits
RANK_SLOTS = 1 << 22
LINES_AT_ONCE = 1 << 12  # fewer than 1 << 16
PAIRS_AT_ONCE = 1 << 18
ENTRIES_AT_ONCE = 200_000  # words of prefixes that are dealt out, or compared, together
OFTEN = 4  # a word is counted where that many prefixes of ENTRIES_AT_ONCE share it
KEY_BITS = 1 << 24


# -- words ----------------------------------------------------------------------------------------
def line_sets(text: str | None, least: int = LEAST_WORDS) -> Iterator[tuple[int, set[bytes]]]:
    """Position and set of words of each line that has enough of them."""
    for pos, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        words = set(line.split())
        if len(words) >= least:
            yield pos, words


def frequent_words(docs: DataFrame) -> dict[bytes, int]:
    """The most frequent words, by rank from 1 for the least frequent; at most FREQUENT.

    A batch reports words that make up one in SHARE of it, so it sends a bounded number of counts. Any
    order is correct as long as all use the same; this one only makes the join fast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            words = pc.ascii_split_whitespace(batch.column(0).cast(pa.large_string())).flatten()
            found = words.filter(pc.not_equal(words, "")).value_counts()
            word, n = found.field(0).cast(pa.binary()), found.field(1)
            enough = pc.greater_equal(n, max(2, (pc.sum(n).as_py() or 0) // SHARE))
            yield pa.RecordBatch.from_arrays([word.filter(enough), n.filter(enough)], ["word", "n"])

    counts = map_batches(docs.select("text"), count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return {bytes(r["word"]): len(top) - k for k, r in enumerate(top)}


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def _mixed(x: np.ndarray, odd: int) -> np.ndarray:
    x = x * np.uint64(odd)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: pa.LargeStringArray | pa.LargeBinaryArray) -> list[np.ndarray]:
    """Two 64-bit hashes of each word, eight bytes at a time for all words together."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.concatenate((np.frombuffer(data or b"", np.uint8), np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    start, size = ends[:-1], np.diff(ends)
    seeds = (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)
    hashes = [_mixed(size.astype(np.uint64) + np.uint64(1), odd) for odd in seeds]
    left, at = np.flatnonzero((size > 0) & (size <= 256)), 0
    while len(left):
        rest = size[left] - at
        x = eights[start[left] + at]
        short = np.flatnonzero(rest < 8)
        x[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        for h, odd in zip(hashes, seeds, strict=True):
            h[left] = _mixed(h[left] ^ x, odd)
        left, at = left[rest > 8], at + 8
    for k in np.flatnonzero(size > 256):
        halves = np.frombuffer(xxhash.xxh3_128_digest(data[start[k] : start[k] + size[k]].tobytes()), "<u8")
        hashes[0][k], hashes[1][k] = halves
    return hashes


def _rank_table(ranks: dict[bytes, int]) -> np.ndarray:
    """The rank of each frequent word in the slot of its hash; words that share a slot share the higher rank."""
    slots = np.zeros(RANK_SLOTS, np.uint16)
    words = sorted(ranks, key=ranks.get)
    slots[word_hashes(pa.array(words, pa.large_binary()))[1] % np.uint64(RANK_SLOTS)] = [ranks[w] for w in words]
    return slots


def _sets_of(lines: pa.LargeStringArray, slots: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of the line, both hashes of the word, of the different words of each line, rare words first."""
    words = pc.ascii_split_whitespace(lines)
    of, words = pc.list_parent_indices(words).to_numpy(), words.flatten()
    h1, h2 = word_hashes(words)
    full = np.flatnonzero(pc.binary_length(words).to_numpy() > 0)
    of, h1, h2 = of[full].astype(np.uint64), h1[full], h2[full]
    key = of << np.uint64(48) | slots[h2 % np.uint64(RANK_SLOTS)].astype(np.uint64) << np.uint64(32) | h1 >> np.uint64(32)
    order = np.argsort(key)
    equal = lambda x: x[order[1:]] == x[order[:-1]]
    same = equal(h1) & equal(h2) & equal(key)
    if (equal(key) & ~same).any():  # different words with equal keys may stand in any order
        order = np.lexsort((h2, h1, key))
        same = equal(h1) & equal(h2) & equal(key)
    order = order[np.concatenate(([True], ~same))] if len(order) else order
    return of[order].astype(np.int64), h1[order], h2[order]


def _lines(docs: DataFrame, similarity: float, least: int) -> DataFrame:
    """A row per line: doc_id, hash of the text, pos, class key (k1, k2), n, parity and prefix."""
    ranks = frequent_words(docs)

    def made(of: pa.RecordBatch, lines: pa.LargeStringArray, row: np.ndarray, pos: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
        line, h1, h2 = _sets_of(lines, slots)
        starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
        n = np.diff(np.append(starts, len(line)))
        wanted = np.flatnonzero(n >= least)
        sums = [np.add.reduceat(h, starts)[wanted].view(np.int64) if len(line) else np.empty(0, np.int64) for h in (h1, h2)]
        lane, bit = (h2 >> np.uint64(6)) & np.uint64(3), np.uint64(1) << (h2 & np.uint64(63))
        of_lane = lambda k: np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), starts) if len(line) else np.empty(0, np.uint64)
        parities = [of_lane(np.uint64(k))[wanted].view(np.int64) for k in range(4)]
        length = np.where(n >= least, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
        in_prefix = np.arange(len(line)) - np.repeat(starts, n) < np.repeat(length, n)
        prefix = (h1[in_prefix] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        offsets = np.concatenate(([0], np.cumsum(length[wanted]))).astype(np.int32)
        at = line[starts][wanted]
        columns = [
            *of.take(pa.array(row[at])).columns,
            pa.array(pos[at].astype(np.int32)),
            *(pa.array(x) for x in sums),
            pa.array(n[wanted].astype(np.int32)),
            *(pa.array(x) for x in parities),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_hash", "pos", "k1", "k2", "n", *PARITY, "prefix"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _rank_table(ranks)
        for batch in in_slices(batches):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            split = pc.split_pattern(texts, "\n")
            lines, row = split.flatten(), pc.list_parent_indices(split).to_numpy()
            pos = np.arange(len(row)) - np.searchsorted(row, row)
            for k in range(0, len(lines), LINES_AT_ONCE):
                part = slice(k, k + LINES_AT_ONCE)
                yield made(batch.select(["doc_id", "doc_hash"]), lines[part], row[part], pos[part], slots)
        pa.default_memory_pool().release_unused()

    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_hash bigint, pos int,"
        " k1 bigint, k2 bigint, n int, p0 bigint, p1 bigint, p2 bigint, p3 bigint, prefix array<int>"
    )
    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), "text"), read, schema)


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """``lines``, a stored table, with ``class``, a number in the order of doc_id, doc_hash and pos, one for rows that agree in these.

    Whole doc_ids that no other text has are put into the number as they are, with pos behind them, so that nothing is moved.
    """
    if isinstance(lines.schema["doc_id"].dataType, T.IntegralType):
        texts = lines.groupBy("doc_id").agg(F.min("doc_hash").alias("a"), F.max("doc_hash").alias("b"), F.max("pos").alias("pos"))
        clash = F.max(F.coalesce((F.col("a") != F.col("b")) | F.col("doc_id").isNull(), F.lit(True)))
        r = texts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("pos").alias("pos"), clash.alias("clash")).first()
        bits = (r["pos"] or 0).bit_length()
        if not r["clash"] and (r["high"] or 0) - (r["low"] or 0) < 1 << (62 - bits):
            place = (F.col("doc_id").cast("long") - F.lit(r["low"] or 0).cast("long")) * F.lit(1 << bits) + F.col("pos")
            return lines.withColumn("class", place)
    sort = [F.col("doc_id").isNull(), "doc_id", "doc_hash", "pos"]
    ordered = lines.dropDuplicates(["doc_id", "doc_hash", "pos"]).repartitionByRange(*sort).sortWithinPartitions(*sort)
    return cut_lineage(ordered.withColumn("class", F.monotonically_increasing_id()), "numbered")


# -- candidates -----------------------------------------------------------------------------------
PACKED = {"key": np.uint32, "cell": np.int32, "class": np.int64, "n": np.int32, "place": np.int32, "even": np.uint64, "odd": np.uint64, "asks": np.uint8}


def _entries(rows: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over the words of the prefixes in ``rows`` (class, n, even, odd, asks, prefix), many at a time: a dict of columns."""

    def flat(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        prefix = table.column("prefix").combine_chunks()
        of, key = pc.list_parent_indices(prefix).to_numpy(), prefix.flatten().to_numpy().view(np.uint32)
        whole = {c: table.column(c).to_numpy()[of].astype(PACKED[c]) for c in ("class", "n", "asks")}
        whole |= {c: table.column(c).to_numpy().view(np.uint64)[of] for c in ("even", "odd")}
        return whole | {"key": key, "cell": np.full(len(key), -1, np.int32), "place": (np.arange(len(of)) - np.searchsorted(of, of)).astype(np.int32)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _together(batches):
            yield from function(flat(held))

    return map_batches(rows.select("class", "n", "even", "odd", "asks", "prefix"), read, schema)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """``batches``, as many at a time as have ENTRIES_AT_ONCE words of prefixes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("prefix").flatten())
        if size >= ENTRIES_AT_ONCE:
            yield held
            held, size = [], 0
    if size:
        yield held


def _hot(rows: DataFrame) -> dict[int, int]:
    """The words that many prefixes share, with the number of chunks that each is dealt in; at most MAX_HOT."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _together(batches):
            words = np.concatenate([b.column("prefix").flatten().to_numpy() for b in held]).view(np.uint32)
            key, n = np.unique(words, return_counts=True)
            often = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(key[often].astype(np.int64)), pa.array(n[often])], ["key", "n"])

    counts = map_batches(rows.select("prefix"), count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > CHUNK)
    return {r["key"]: -(-r["n"] // CHUNK) for r in counts.orderBy(F.desc("n"), "key").limit(MAX_HOT).collect()}


def _spread(rows: DataFrame) -> tuple[dict[int, int], int]:
    """How the prefixes of ``rows`` are dealt out, whichever of them ask: the chunks of :func:`_hot` and the number of buckets."""
    total = rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    return _hot(rows), max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // ENTRIES_AT_ONCE))


def _dealt(entries: dict[str, np.ndarray], hot_keys: np.ndarray, chunks: np.ndarray) -> dict[str, np.ndarray]:
    """``entries`` with those of frequent words once for each cell: pairs of chunks, so that each pair of entries of a word meets in a cell."""
    if not len(hot_keys):
        return entries
    at = np.minimum(np.searchsorted(hot_keys, entries["key"]), len(hot_keys) - 1)
    hot = hot_keys[at] == entries["key"]
    own = np.flatnonzero(hot)
    c = chunks[at[own]]
    mine = (_mixed(entries["class"][own].view(np.uint64), 0xC2B2AE3D27D4EB4F) % c.astype(np.uint64)).astype(np.int64)
    copies = np.repeat(np.arange(len(own)), c - 1)
    other = np.arange(len(copies)) - np.searchsorted(copies, copies)
    other += other >= mine[copies]
    cell = np.minimum(mine[copies], other) * c[copies] + np.maximum(mine[copies], other)
    both = {name: np.concatenate((x[~hot], x[own][copies])) for name, x in entries.items()}
    both["cell"][len(hot) - len(own) :] = cell
    return both


def _found(e: dict[str, np.ndarray], similarity: float, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """late, early and more of the entries of a bucket, each pair once.

    The entries of a word are sorted by n, so that each meets only those that are not too long for it. Of two classes the
    shorter one need only be there by its first n - ceil(2 s n / (1 + s)) + 1 words.
    """
    share = similarity / (1 + similarity)
    group = e["key"].astype(np.uint64) << np.uint64(32) | (e["cell"] + 1).astype(np.uint64)
    order = np.lexsort((e["class"], e["n"], group))
    group, of, n, place, even, odd = group[order], *(e[c][order] for c in ("class", "n", "place", "even", "odd"))
    asks, n, place = e["asks"][order] > 0, n.astype(np.int64), place.astype(np.int64)
    count, start = len(group), np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    number = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
    stop = np.searchsorted(number << 40 | n, number << 40 | np.floor(n / similarity + 1e-9).astype(np.int64), "right")
    meets = stop - np.arange(count) - 1
    meets[(place > n - np.ceil(2 * share * n - 1e-9)) | ~np.logical_or.reduceat(asks, start)[number]] = 0
    part, before = ((1 - similarity) / (1 + similarity) * n).astype(np.float32), np.concatenate(([0], np.cumsum(meets)))
    first, hits, found, none, at = np.full(count, np.iinfo(np.int64).max), np.zeros(count, np.int64), [], of[:0], 0
    while at < count:
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS_AT_ONCE, "right")) - 1)
        a = np.repeat(np.arange(at, to), meets[at:to])
        b = a + 1 + np.arange(len(a)) - (before[a] - before[at])
        at = to
        close = np.flatnonzero(np.bitwise_count(even[a] ^ even[b]) <= part[a] + part[b] + np.float32(0.01))
        a, b = a[close], b[close]
        least = np.ceil(share * (n[a] + n[b]) - 1e-9)
        good = np.minimum(n[a] - place[a], n[b] - place[b]) >= least
        good &= np.bitwise_count(even[a] ^ even[b]).astype(np.int64) + np.bitwise_count(odd[a] ^ odd[b]) <= n[a] + n[b] - 2 * least
        a, b = a[good], b[good]
        later = of[a] > of[b]
        late, early = np.where(later, a, b), np.where(later, b, a)
        good = asks[late] & (of[late] != of[early])
        late, early = late[good], early[good]
        if every:
            found.append((of[late], of[early]))
        else:
            np.minimum.at(first, late, of[early])
            np.add.at(hits, late, 1)
    if every:
        late, early = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)
        more = np.zeros(len(late), bool)
    else:
        b = np.flatnonzero(hits)
        late, early, more = of[b], first[b], hits[b] > 1
    order = np.lexsort((~more, early, late))
    late, early, more = late[order], early[order], more[order]
    new = np.flatnonzero(np.concatenate(([True], (late[1:] != late[:-1]) | (early[1:] != early[:-1])))) if len(late) else order
    return late[new], early[new], more[new]


def _candidates(rows: DataFrame, similarity: float, every: bool, keys: np.ndarray | None = None, spread: tuple[dict[int, int], int] | None = None) -> DataFrame:
    """(late, early, more) of rows (class in the order of first occurrence, n, parity (even, odd), asks, prefix).

    Without ``every``, the earliest candidate of each class that asks, and whether its cell has more. Only words whose bits
    are set in ``keys`` count, if it is given. The entries of the prefixes travel by buckets of words, many in a row;
    ``spread`` is what :func:`_spread` gives, if it is known.
    """
    hot, buckets = spread or _spread(rows)
    hot_keys = np.array(sorted(hot), np.uint32)
    chunks = np.array([hot[int(k)] for k in hot_keys], np.int64)

    def deal(entries: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if keys is not None:
            likely = np.flatnonzero(keys[entries["key"] % np.uint32(len(keys))])
            entries = {c: x[likely] for c, x in entries.items()}
            if not len(likely):
                return
        entries = _dealt(entries, hot_keys, chunks)
        both = entries["key"].astype(np.uint64) << np.uint64(32) | (entries["cell"] + 1).astype(np.uint64)
        bucket = (_mixed(both, 0xFF51AFD7ED558CCD) >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        bucket = bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(starts[1:], len(bucket))
        entries = {c: entries[c][order] for c in PACKED}
        columns = [pa.array([planes(x[i:j]) for i, j in zip(starts, ends, strict=True)], pa.binary()) for x in entries.values()]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), *columns], ["bucket", *PACKED])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, of_bucket in groupby(((b, k) for b in batches for k in range(b.num_rows)), lambda x: x[0].column(0)[x[1]].as_py()):
            held = [[of_planes(b.column(c)[k].as_py(), kind) for c, kind in PACKED.items()] for b, k in of_bucket]
            columns = dict(zip(PACKED, (np.concatenate(x) for x in zip(*held, strict=True)), strict=True))
            late, early, more = _found(columns, similarity, every)
            if len(late):
                yield pa.RecordBatch.from_arrays([pa.array(late), pa.array(early), pa.array(more)], ["late", "early", "more"])
        pa.default_memory_pool().release_unused()

    packed = _entries(rows, deal, f"bucket int, {', '.join(f'{c} binary' for c in PACKED)}")
    packed = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = map_batches(packed, compare, "late bigint, early bigint, more boolean")
    return found.groupBy("late", "early").agg(F.max("more").alias("more"))


def _words_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """class and its words, of the classes in ``needed`` (class, doc_id, doc_hash, pos), read again from their documents."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), "text")
    likely = rows_in_bitmap(texts, "doc_hash", needed.select("doc_hash"))
    lines = likely.select("doc_id", "doc_hash", F.posexplode(F.split("text", "\n")).alias("pos", "words"))
    lines = lines.withColumn("place", F.xxhash64("doc_hash", "pos"))
    places = needed.select(F.xxhash64("doc_hash", "pos").alias("place"))
    found = rows_in_bitmap(lines, "place", places).drop("place").alias("found")
    at = needed.select("class", *[F.col(c).alias(f"at_{c}") for c in ("doc_id", "doc_hash", "pos")])
    same = F.col("doc_id").eqNullSafe(F.col("at_doc_id")) & (F.col("doc_hash") == F.col("at_doc_hash")) & (F.col("pos") == F.col("at_pos"))
    return found.join(at, same).select("class", F.col("words").cast("binary").alias("words")).dropDuplicates(["class"])


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, similarity: float, least_words: int) -> DataFrame:
    """``pairs`` with ``match``: whether the similarity of both classes is high enough.

    The parity of all 256 bits, which is a lower bound of the number of different words, comes first.
    """
    ends = pairs.select(F.explode(F.array("late", "early")).alias("class"))
    classes = rows_in_bitmap(classes, "class", ends)  # most are in no pair, and these joins move what is left
    sides = [classes.select(F.col("class").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", *PARITY)]) for s in ("late", "early")]
    both = pairs.join(sides[0], "late").join(sides[1], "early")
    words = F.col("late_n") + F.col("early_n")
    least = F.ceil(similarity / (1 + similarity) * words - 1e-9)
    differ = sum((F.bit_count(F.col(f"late_{c}").bitwiseXOR(F.col(f"early_{c}"))) for c in PARITY), F.lit(0))
    both = cut_lineage(both.select("late", "early", "more", (differ <= words - 2 * least).alias("close")), "close")
    far = both.filter(~F.col("close")).select("late", "early", "more", F.lit(False).alias("match"))
    pairs = both.filter("close").drop("close")
    ids = pairs.select(F.explode(F.array("late", "early")).alias("class")).distinct()
    needed = cut_lineage(classes.join(ids, "class", "left_semi").select("class", "doc_id", "doc_hash", "pos"), "needed")
    words = cut_lineage(_words_of(docs, needed), "words")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            match = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = set(a.split()), set(b.split())
                both = len(a & b)
                match.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            kept = [batch.column(c) for c in ("late", "early", "more")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(match, pa.bool_())], ["late", "early", "more", "match"])

    at_late = words.select(F.col("class").alias("late"), F.col("words").alias("a"))
    at_early = words.select(F.col("class").alias("early"), F.col("words").alias("b"))
    joined = pairs.join(at_late, "late").join(at_early, "early").select("late", "early", "more", "a", "b")
    found = map_batches(joined, check, "late bigint, early bigint, more boolean, match boolean")
    return cut_lineage(found, "verified").union(far)


# -- the operator ---------------------------------------------------------------------------------
def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """The lines that go: doc_id, doc_hash (of the text) and pos; stored."""
    lines = _numbered_lines(cut_lineage(_lines(docs, similarity, least), "lines"))
    # Copies of an earlier line go in any case; the first line of each class stands for it.
    sizes = lines.groupBy("k1", "k2").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first != last")
    sizes = cut_lineage(sizes, "copied")
    copied = rows_in_bitmap(lines.select("k1", "k2", "class"), "k1", sizes.select("k1")).join(sizes, ["k1", "k2"])
    later = cut_lineage(copied.filter("class != first").select("class").distinct(), "later")
    parity = [F.col(x).bitwiseXOR(F.col(y)).alias(c) for x, y, c in (("p0", "p2", "even"), ("p1", "p3", "odd"))]  # folded to 128 bits
    different = lines.filter(F.col("n") > 3) if similarity > 0.751 else lines  # different sets of three words and more are at most 0.75 alike
    rows = cut_lineage(without(different.select("class", "n", *parity, "prefix"), "class", later), "prefixes")
    asking = rows.withColumn("asks", F.lit(True))
    spread = _spread(rows)
    pairs = cut_lineage(_candidates(asking, similarity, False, None, spread), "pairs")
    verified = _verified(docs, pairs, lines, similarity, least)
    by_class = verified.groupBy("late").agg(F.max("match").alias("match"), F.max("more").alias("more"))
    matched = by_class.filter("match").select("late")
    open_ = cut_lineage(by_class.filter("not match and more").select("late"), "open")
    if not open_.isEmpty():
        open_ = open_.select(F.col("late").alias("class"))
        asked = cut_lineage(rows_in_bitmap(asking, "class", open_).join(open_, "class", "left_semi"), "asks")
        asks = marked_in_bitmap(rows, "class", open_, "asks")  # as the bitmap goes, so a few more than those that are open
        again = cut_lineage(_candidates(asks, similarity, True, _key_bits(asked), spread), "pairs")
        again = again.join(open_.withColumnRenamed("class", "late"), "late", "left_semi")
        again = again.join(pairs.select("late", "early"), ["late", "early"], "left_anti")
        matched = matched.union(_verified(docs, again, lines, similarity, least).filter("match").select("late")).distinct()
    gone = cut_lineage(later.union(matched.withColumnRenamed("late", "class")), "gone")
    places = rows_in_bitmap(lines.select("class", "doc_id", "doc_hash", "pos"), "class", gone).join(gone, "class", "left_semi")
    return cut_lineage(places.select("doc_id", "doc_hash", "pos").distinct(), "repeated")


def _key_bits(rows: DataFrame) -> np.ndarray:
    """Of KEY_BITS places which the words of the prefixes in ``rows`` take."""
    place = F.pmod(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(KEY_BITS))
    words = rows.select(F.explode("prefix").alias("key")).select(place.alias("place")).select(
        F.floor(F.col("place") / 64).alias("word"), F.expr("shiftleft(1L, cast(place % 64 AS INT))").alias("bit")
    )
    bits = np.zeros(KEY_BITS // 64, np.int64)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        bits[r["word"]] = r["bits"]
    return np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


def line_report(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (positions from 0, ascending)."""
    removed = _positions(repeated_lines(docs, similarity, least))
    rows = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), F.size(F.split("text", "\n")).alias("n"))
    return _with_positions(rows, removed).select(
        "doc_id",
        F.when(F.col("n") > 0, F.col("n")).otherwise(0).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def _positions(repeated: DataFrame) -> DataFrame:
    """Of each document the positions of its lines that go, as many as it has lines at most; stored."""
    by_document = repeated.groupBy(F.col("doc_id").alias("_of"), F.col("doc_hash").alias("_hash"))
    return cut_lineage(by_document.agg(F.sort_array(F.collect_list("pos")).alias("removed")), "removed")


def _with_positions(rows: DataFrame, removed: DataFrame) -> DataFrame:
    same = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("doc_hash") == F.col("_hash"))
    return rows.join(removed, same, "left").drop("_of", "_hash")


def drop_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, without the rows that lose their last word by it."""
    repeated = repeated_lines(docs, similarity, least)
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("row"), "doc_id", F.xxhash64("text").alias("doc_hash"))
    removed = _positions(repeated)
    marked = marked_in_bitmap(packed, "doc_hash", removed.select(F.col("_hash").alias("doc_hash")), "likely")
    whole = marked.filter("NOT likely").withColumn("removed", F.lit(None).cast("array<int>"))  # these are not moved
    joined = _with_positions(marked.filter("likely"), removed).unionByName(whole)
    joined = joined.select("row.*", F.col("removed").alias(f"{free_prefix(names)}removed"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in in_slices(batches):
            texts, kept = [], []
            for text, removed in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if removed:
                    gone = set(removed)
                    text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone])
                texts.append(text)
                kept.append(not removed or bool(text.strip(" \t\n\v\f\r")))
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(kept, pa.bool_()))

    return map_batches(joined, cut, T.StructType(docs.schema.fields))
