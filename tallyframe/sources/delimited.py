"""Delimited files as all-string tables, and the matching sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.text import header_separator, na_to_empty_sql

CORRUPT = "_corrupt_record"
_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def detect_separator(spark: SparkSession, path: str) -> str:
    """Separator of a file or folder of files, from the first header line found."""
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    first = lines.select(
        header_separator(F.col("value"), F.col("_metadata.file_name")).alias("sep")
    ).first()
    if first is not None:
        return first["sep"]
    return "," if path.lower().endswith(".csv") else "|"


def header_separators(spark: SparkSession, path: str) -> DataFrame:
    """Header line and separator of every file under ``path`` (a glob or a folder)."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("_at"),
        "value",
    )
    # Only the block at the start of a file can hold its header; it is one task per file.
    first = lines.where("_at.block = 0").groupBy("file_path", "file_name").agg(
        F.min_by("value", "_at").alias("header")
    )
    return first.withColumn("separator", header_separator(F.col("header"), F.col("file_name")))


def csv_reader(spark: SparkSession, sep: str, multi_line: bool = False) -> DataFrameReader:
    """Reader of text columns under a header; malformed rows are kept."""
    # Without pruning, a row's number of fields is checked whatever columns a query uses.
    return spark.read.options(
        header=True, sep=sep, escape='"', multiLine=multi_line, columnPruning=False, mode="PERMISSIVE", **_KEEP_BLANKS
    )


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = False
) -> DataFrame:
    """All columns as text, header row used, nothing inferred; keeps malformed rows marked.

    The extra column ``_corrupt_record`` holds the raw text of rows whose number of fields is not
    the header's; :func:`good_rows` and :func:`malformed_rows` tell them apart. All files must have the
    same header: another order of columns is an error when it is read, not swapped values.
    """
    sep = sep or detect_separator(spark, path)
    names = csv_reader(spark, sep, multi_line).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    reader = csv_reader(spark, sep, multi_line).schema(schema).option("enforceSchema", False)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def _too_long(n_columns: int, sep: str):
    # Quoted stretches may hold separators: leave them out before counting.
    bare = F.regexp_replace(F.col(CORRUPT), r'"(?:[^"]|"")*"', "")
    return F.size(F.split(bare, "[" + sep + "]", -1)) > n_columns


def _uses(col: str):
    """Always true: Spark refuses a scan of the raw text alone, so one real column takes part."""
    return F.length(F.coalesce(F.col(f"`{col}`"), F.lit(""))) >= 0


def good_rows(df: DataFrame, sep: str) -> DataFrame:
    """Well-formed rows and short rows (missing fields are null) with NA tokens as ``""``.

    A column ``emp_id`` that comes from the path and not from the file may be the last one.
    """
    cols = [c for c in df.columns if c != CORRUPT]
    kept = df.where(F.col(CORRUPT).isNull() | ~_too_long(_fields(df), sep)).where(_uses(cols[0]))
    return canonical(kept.select(*cols))


def _fields(df: DataFrame) -> int:
    """Number of columns in the file: those before the raw text."""
    return df.columns.index(CORRUPT)


def overlong(df: DataFrame, n_columns: int, sep: str) -> DataFrame:
    """Rows with more fields than the header."""
    return df.where(F.col(CORRUPT).isNotNull() & _too_long(n_columns, sep)).where(_uses(df.columns[0]))


def malformed_rows(df: DataFrame, sep: str) -> DataFrame:
    """Raw text of rows with more fields than the header: any of these fails a dataset."""
    return overlong(df, _fields(df), sep).select(CORRUPT)


def canonical(df: DataFrame) -> DataFrame:
    """Text columns of any table with null and NA tokens as ``""``; other types stay."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.selectExpr(
        *[f"{na_to_empty_sql(c)} AS `{c}`" if c in text else f"`{c}`" for c in df.columns]
    )


def write_delimited(
    df: DataFrame, path: str, sep: str = "|", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Delimited sink with a header and proper quoting (values may hold the separator)."""
    writer = df.write.mode(mode).options(
        header=True, sep=sep, escape='"', emptyValue="", nullValue="", partitionOverwriteMode="dynamic", **_KEEP_BLANKS
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
