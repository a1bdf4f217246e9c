"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed size. Blocks are sorted, and equal blocks get one integer name.
Then adjacent names are paired, pairs are sorted and named in the same way, and so on until each
document has one name. Names come from contents, never from hashes, so two documents have the same
name at the same level if and only if their texts are equal.

Equal blocks meet by hash partitioning and are sorted there; a name is the place of the first of
them. A block that fills many rows is first dealt over salts and named in each of them; then the one
representative that each salt has is reconciled. So no task sees all rows of a hot block.

Equal blocks have equal hashes, so a block whose hash no other row has is equal to none: it gets a name
of its own, and its content is not moved. A bitmap of hashes rules out, it never decides that blocks are equal.

Odd cases: a null text counts as empty, and all empty texts are equal. Rows that share a doc_id are
rows of their own; of equal texts, one row stays even if all have the same doc_id. A null doc_id
sorts behind all others. Columns other than doc_id and text are not read. An empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import marked_in_bitmap, normal_spaces
from tallyframe.session import cut_lineage

BLOCK_CHARS = 4096
HOT_ROWS = 500  # rows of one value that may meet in a task
ALONE = 1 << 30  # salts over which rows are spread that no other row can equal
MAX_HOT = 50_000  # the most frequent values that are salted; 16 bytes each are broadcast


def contents_of_repeats(hashed: DataFrame, value: list[str], repeats: DataFrame) -> DataFrame:
    """``hashed`` (with ``_hash``) with ``_alone`` where the hash is surely not in ``repeats``; these rows lose their ``value``."""
    marked = marked_in_bitmap(hashed, "_hash", repeats, "_likely")
    kept = [F.when(F.col("_likely"), F.col(c)).alias(c) if c in value else F.col(c) for c in hashed.columns]
    return marked.select(*kept, (~F.col("_likely")).alias("_alone"))


def name_values(rows: DataFrame, value: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` (with ``rid`` and ``pos``) with an integer ``name`` in place of the columns of ``value``.

    Rows get the same name if and only if their values are equal; nulls equal each other. Names are
    stored, so they stay the same whenever the result is read.
    """
    others = [c for c in rows.columns if c not in value]
    hashed = rows.withColumn("_hash", F.xxhash64(*value))
    repeats = cut_lineage(hashed.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1"), "repeats")
    hot = (
        repeats.filter(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"), "_hash")
        .limit(MAX_HOT)
        .select("_hash", F.ceil(F.col("_n") / hot_rows).alias("_salts"))
    )
    by_value = Window.partitionBy(*value, "_salt")
    spread = F.pmod(F.xxhash64("rid", "pos"), F.coalesce("_salts", F.lit(ALONE)))
    local = (
        contents_of_repeats(hashed, value, repeats)
        .join(F.broadcast(hot), "_hash", "left")
        .withColumn("_salt", F.when(F.col("_alone"), -1 - spread).when(F.col("_salts").isNull(), 0).otherwise(spread))
        .drop("_hash")
        .repartition(*value, "_salt")
        .sortWithinPartitions(*value, "_salt")
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_name", F.when(F.col("_alone"), F.col("_place")).otherwise(F.min("_place").over(by_value)))
    )
    stands_for_salt = F.col("_salts").isNotNull() & (F.col("_place") == F.col("_name"))
    local = cut_lineage(
        local.select(
            *others, "_name", stands_for_salt.alias("_stands"), *[F.when(stands_for_salt, F.col(c)).alias(c) for c in value]
        ),
        "names",
    )
    same = Window.partitionBy(*value)
    final = local.filter("_stands").select("_name", F.min("_name").over(same).alias("_final"))
    named = local.drop(*value, "_stands").join(final, "_name", "left")
    return named.select(*others, F.coalesce("_final", "_name").alias("name"))


def document_names(docs: DataFrame, block_chars: int = BLOCK_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: rid, doc_id, text_sha256, and its identity (level, name)."""
    text = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", normal_spaces(F.col("text")).alias("text")
    )
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = text.select(
        "rid",
        "doc_id",
        F.sha2("text", 256).alias("text_sha256"),
        F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(pieces).alias("pieces"),
    )
    rows = cut.select(
        "rid",
        "doc_id",
        "text_sha256",
        F.size("pieces").alias("n"),
        F.posexplode("pieces").alias("pos", "block"),
    ).withColumn("text_sha256", F.when(F.col("pos") == 0, F.col("text_sha256")))
    named = name_values(rows, ["block"], hot_rows)
    longest = named.agg(F.max("n")).first()[0] or 1
    finished, level = [], 0
    while True:
        of_level = named.filter(F.col("n") == 1) if longest > 1 else named
        finished.append(of_level.select("rid", "doc_id", "text_sha256", F.lit(level).alias("level"), "name"))
        if longest == 1:
            return reduce(DataFrame.union, finished)
        even = F.col("pos") % 2 == 0
        pairs = (
            named.filter(F.col("n") > 1)
            .groupBy("rid", F.floor(F.col("pos") / 2).alias("pos"))
            .agg(
                F.max("doc_id").alias("doc_id"),
                F.max("text_sha256").alias("text_sha256"),
                F.ceil(F.max("n") / 2).alias("n"),
                F.max(F.when(even, F.col("name"))).alias("left"),
                F.max(F.when(~even, F.col("name"))).alias("right"),
            )
        )
        named = name_values(pairs, ["left", "right"], hot_rows)
        longest, level = -(-longest // 2), level + 1


def exact_duplicates(docs: DataFrame, block_chars: int = BLOCK_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after each run of white space is replaced by one space. Of equal
    texts, the row with the smallest doc_id stays.
    """
    names = document_names(docs, block_chars, hot_rows)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    groups = (
        names.groupBy("level", "name")
        .agg(F.min(order).alias("keep"), F.count("*").alias("size"))
        .filter(F.col("size") > 1)
        .select("level", "name", "size", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.rid").alias("keep_rid"))
    )
    groups = cut_lineage(groups, "groups")
    alone = F.col("size").isNull()
    return names.join(groups, ["level", "name"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_doc")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "text_sha256",
    )
