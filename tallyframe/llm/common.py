"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow``, for functions of this package.

    On a cluster the package must be installed on executors or given by ``--py-files``. The workers of a
    local session get it here, so that they need not share the driver's search path.
    """
    context = df.sparkSession.sparkContext
    if re.match(r"local(\[|$)", context.master) and context.applicationId not in _SHIPPED:
        context.addFile(str(Path(__file__).parents[1]), recursive=True)
        _SHIPPED.add(context.applicationId)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that is free goes back to the system: workers go on from stage to stage, and would hold what one of them needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


ROWS_AT_ONCE = 1000


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in slices of at most ROWS_AT_ONCE rows, so that what Python makes of a batch of texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normal_spaces(text: Column) -> Column:
    """``text`` with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """The remainder of a document's id under CRC-32, which splits rows for training and testing."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def free_prefix(columns: list[str]) -> str:
    """A prefix for columns of one's own that no column of ``columns`` has."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def hashed_sample(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """Per value of ``by`` at most ``n`` rows, those of the smallest hashes of ``key``, which tells a group's rows apart.

    Of a larger group about 3n + 200 rows pass a bound on the hash that follows from the group's size, so what a task
    sorts grows neither with the group nor with the number of tasks. That fewer than ``n`` pass is less likely than
    e^-100. The groups must be few: their sizes are broadcast.
    """
    own = free_prefix(rows.columns)
    of, size, rank = f"{own}of", f"{own}size", f"{own}rank"
    sizes = rows.groupBy(F.col(by).alias(of)).agg(F.count("*").alias(size))
    place = F.xxhash64(key) / F.lit(2.0**64) + 0.5
    likely = rows.join(F.broadcast(sizes), F.col(by) == F.col(of)).filter(place * F.col(size) <= 3 * n + 200)
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(key), key))
    return likely.withColumn(rank, first).filter(F.col(rank) <= n).select(*rows.columns)


def hashed_pieces(text: Column, inside: str, length: int, n: int) -> Column:
    """Stretches of characters ``inside`` (a character class) of the whole text, cut at ``length``; beyond ``n`` the distinct ones of the smallest hashes."""
    pieces = F.regexp_extract_all(text, F.lit(f"{inside}{{1,{length}}}"), F.lit(0))

    def some(all_pieces: Column) -> Column:
        ordered = F.array_sort(F.transform(F.array_distinct(all_pieces), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x"))))
        return F.when(F.size(all_pieces) <= n, all_pieces).otherwise(F.transform(F.slice(ordered, 1, n), lambda x: x["x"]))

    return let(pieces, some)


CHUNK = 1024  # rows of one key in a chunk; two chunks are compared in one cell
ROWS_TOGETHER = 200_000
MAX_HOT = 50_000  # keys of which the row counts are broadcast, the most frequent ones


def dealt_in_cells(rows: DataFrame, key: str, item: str, chunk: int = CHUNK) -> DataFrame:
    """``rows`` partitioned and sorted by ``key`` and ``cell``, so that each pair of rows of a key meets in a cell.

    A key of at most ``chunk`` rows has one cell. A larger one is cut into chunks by a hash of
    ``item``, and each pair of chunks is a cell, so no task holds more than two chunks of a group.
    """
    hot = (
        rows.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > chunk)
        .orderBy(F.desc("_n"), key)
        .limit(MAX_HOT)
        .select(key, F.ceil(F.col("_n") / chunk).cast("int").alias("_chunks"))
    )
    own = F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda j: j != own)
    cells = F.transform(others, lambda j: F.least(own, j) * F.col("_chunks") + F.greatest(own, j))
    one = F.array(F.lit(-1))
    return (
        rows.join(F.broadcast(hot), key, "left")
        .select(*rows.columns, F.explode(F.when(F.col("_chunks").isNull(), one).otherwise(cells)).alias("cell"))
        .repartition(key, "cell")
        .sortWithinPartitions(key, "cell", item)
    )


def whole_groups(batches: Iterator, group: list[str], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted Arrow batches as arrays, cut so that no group of equal ``group`` columns is split.

    Batches are put together up to ROWS_TOGETHER rows, since comparing costs by the call as well.
    """
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in (*group, *names)])
        size += batch.num_rows
        if size < ROWS_TOGETHER:
            continue
        now = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = np.logical_and.reduce([c == c[-1] for c in now[: len(group)]])
        split = int(np.argmax(last))
        if split:
            yield [x[:split] for x in now]
        held = [[x[split:] for x in now]]
        size = len(now[0]) - split
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def group_ends(columns: list[np.ndarray]) -> np.ndarray:
    """For each row of sorted columns the row after the last one that is equal in all of them."""
    n = len(columns[0])
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if n > 1 else np.empty(0, bool)
    starts = np.flatnonzero(np.concatenate(([True], new)))
    return np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))


def planes(x: np.ndarray) -> bytes:
    """The bytes of ``x``, first all lowest ones and so on: as most high bytes are equal, this is compressed better."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def of_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


BITMAP_WORDS = 1 << 18  # of 64 bits


def _bits(key: str, needed: DataFrame) -> tuple[dict[str, Column], DataFrame]:
    """The place of a row's ``key`` in a bitmap of bounded size, and the bitmap of all in ``needed``: _word, _bits."""
    bit = F.pmod(F.xxhash64(key), F.lit(64 * BITMAP_WORDS))
    place = {"_word": F.floor(bit / 64).cast("long"), "_mask": F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) AS INT))")}
    return place, needed.select(*[c.alias(n) for n, c in place.items()]).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


def rows_in_bitmap(rows: DataFrame, key: str, needed: DataFrame) -> DataFrame:
    """``rows`` less most of those whose ``key`` is not in ``needed``, by a broadcast bitmap of bounded size, so without a shuffle."""
    place, bitmap = _bits(key, needed)
    likely = rows.withColumns(place).join(F.broadcast(bitmap), "_word")
    return likely.filter(F.col("_bits").bitwiseAND(F.col("_mask")) != 0).select(*rows.columns)


def marked_in_bitmap(rows: DataFrame, key: str, needed: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: false only where ``key`` is not in ``needed``, by the bitmap of :func:`rows_in_bitmap`."""
    place, bitmap = _bits(key, needed)
    marked = rows.withColumns(place).join(F.broadcast(bitmap), "_word", "left")
    return marked.select(*rows.columns, (F.coalesce("_bits", F.lit(0)).bitwiseAND(F.col("_mask")) != 0).alias(name))


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` less those whose ``key`` is in ``gone``, a stored table of that column; only rows that may be in it are moved."""
    packed = rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("key"))
    marked = marked_in_bitmap(packed, "key", gone.select(F.col(key).alias("key")), "likely")
    left = marked.filter("likely").join(gone.select(F.col(key).alias("key")), "key", "left_anti").select(*marked.columns)
    return marked.filter("NOT likely").unionByName(left).select("row.*")


def numbered(rows: DataFrame, by: list[str], per: list[str], place: str, size: str) -> DataFrame:
    """``rows`` with their place (from 0) in the order of ``by`` within each group of ``per``, and the group's size; stored.

    ``by`` starts with the columns of ``per``; nulls come first and equal each other. Rows are sorted by range, so a group
    of any size is spread over partitions; only counts per partition and group are summed up.
    """
    own = free_prefix(rows.columns)
    part, at, first, n, before = (f"{own}{c}" for c in ("part", "at", "first", "n", "before"))
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    stored = cut_lineage(ordered.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "ordered")
    counts = stored.groupBy(*per, part).agg(F.min(at).alias(first), F.count("*").alias(n))
    group = Window.partitionBy(*per)
    earlier = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({before: F.coalesce(F.sum(n).over(earlier), F.lit(0)), size: F.sum(n).over(group)})
    counts = cut_lineage(counts.select(*[F.col(c).alias(f"{own}{c}") for c in per], F.col(part).alias(f"{own}in"), first, before, size), "counts")
    same = F.col(part) == F.col(f"{own}in")
    for c in per:
        same &= F.col(c).eqNullSafe(F.col(f"{own}{c}"))
    placed = stored.join(counts, same).withColumn(place, F.col(before) + F.col(at) - F.col(first))
    return placed.select(*rows.columns, place, size)
