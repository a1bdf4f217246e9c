"""Text reports: written from result tables, and read back into tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions import labels
from tallyframe.operators.groups import MISSING
from tallyframe.operators.ranking import sample_per_group
from tallyframe.plans.compare import Diff

# Texts and patterns of a report.
SUMMARY_LINE = "%-10s %-40s - %s"
MAX_LISTED = 10
LIKELY_CAUSE = "  LIKELY CAUSE: Time interval filter not applied correctly in replicated query"
SUMMARY_BLOCK = r"(?s)SUMMARY:\s*\n-+\s*\n(.*?)(?:\n\nDETAILED|$)"
SAME_MARKS = ("MATCH", "✅")
DIFF_MARKS = ("DIFF", "❌")
DATASET_NAME = r"([\w\-\.]+\.(?:psv|csv))"
DATASET_WITH_NOTE = r"([\w\-\.]+\.(?:psv|csv))\s*-\s*(.+)"
SIDE_COUNTS = r"Primary=(\d+),\s*Replicated=(\d+)"
FILE_SECTION = r"(?s)File: ([\w\-\.]+)\s*\n(.*?)(?=File: [\w\-\.]+\s*\n|\z)"
PRIMARY_ROWS = r"Primary rows:[^\S\n]*(\d+)"
REPLICATED_ROWS = r"Replicated rows:[^\S\n]*(\d+)"
ROWS_WITH_DIFFERENCES = r"(?i)(\d+)[^\S\n]+rows?[^\S\n]+with[^\S\n]+differences"
VALUE_DIFFERENCES = r"(?i)(\d+)[^\S\n]+value[^\S\n]+differences"
SAME_WORDS = ("IDENTICAL", "No differences found")

_HEAD, _SUMMARY, _DETAIL_HEAD, _DETAIL, _END = range(5)


def summary_line(status: Column, name: Column, summary: Column) -> Column:
    """One padded line of the summary block."""
    return F.format_string(SUMMARY_LINE, status, name, summary)


def _lines(df: DataFrame, emp: str, section: int, dataset: Column | None, part: int, order: Column, text: Column):
    name = dataset if dataset is not None else F.lit("")
    return df.select(
        F.col(emp),
        F.lit(section).alias("section"),
        *[c.alias(f"_d{i}") for i, c in enumerate(labels.dataset_order(name))],
        F.lit(part).alias("part"),
        order.cast("string").alias("_order"),
        F.posexplode(text).alias("_pos", "text"),
    )


def report_lines(diff: Diff, emp_col: str = "emp_id", generated_at: str | None = None) -> DataFrame:
    """Report of each employer as numbered lines.

    The number of lines depends on datasets, columns and sample sizes, not on table sizes.
    """
    e, d = emp_col, F.col("dataset")
    results = diff.results
    totals = results.groupBy(e).agg(F.count("dataset").alias("n"), F.count_if("match").alias("same"))
    rule = F.lit("=" * 80)
    head = F.array(
        rule,
        F.lit("COMPARISON REPORT"),
        rule,
        F.lit(f"Generated: {generated_at}" if generated_at else "Generated:"),
        F.concat(F.lit("Employer ID: "), F.col(e).cast("string")),
        F.concat(F.lit("Total files compared: "), F.col("n").cast("string")),
        F.concat(F.lit("Matching files: "), F.col("same").cast("string")),
        F.concat(F.lit("Different files: "), (F.col("n") - F.col("same")).cast("string")),
        F.lit(""),
        F.lit("SUMMARY:"),
        F.lit("-" * 40),
    )
    parts = [
        _lines(totals, e, _HEAD, None, 0, F.lit(""), head),
        _lines(
            results, e, _SUMMARY, d, 0, F.lit(""),
            F.array(summary_line(F.when(F.col("match"), "MATCH").otherwise("DIFF"), d, F.col("summary"))),
        ),
        _lines(
            totals, e, _DETAIL_HEAD, None, 0, F.lit(""),
            F.array(F.lit(""), F.lit("DETAILED RESULTS:"), F.lit("-" * 40)),
        ),
        _lines(totals, e, _END, None, 0, F.lit(""), F.array(rule)),
    ]
    differing = results.where(~F.col("match"))
    rows = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in ("primary_rows", "replicated_rows")]
    opening = F.concat(
        F.array(
            F.lit(""),
            F.concat(F.lit("File: "), d),
            F.concat(F.lit("Primary rows: "), rows[0]),
            F.concat(F.lit("Replicated rows: "), rows[1]),
            F.lit("Summary: "),
        ),
        F.transform(F.filter(F.split("summary", "; "), lambda s: s != ""), lambda s: F.concat(F.lit("  - "), s)),
    )
    parts.append(_lines(differing, e, _DETAIL, d, 1, F.lit(""), opening))
    parts.append(
        _lines(results.where("has_old_data"), e, _DETAIL, d, 90, F.lit(""), F.array(F.lit(LIKELY_CAUSE)))
    )
    if diff.set_diffs is not None:
        parts += _set_lines(diff, e)
    if diff.column_diffs is not None:
        parts += _column_lines(diff, e)
    if diff.record_samples is not None:
        parts += _record_lines(diff, e)
    all_lines = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy(e).orderBy("section", "_d0", "_d1", "_d2", "part", "_order", "_pos")
    return all_lines.select(e, F.row_number().over(w).alias("line_no"), "text")


def _set_lines(diff: Diff, e: str) -> list[DataFrame]:
    d = F.col("dataset")
    sets = diff.set_diffs
    known = lambda c: F.coalesce(F.try_element_at("info", F.lit(c)), F.lit("?"))
    # Numbers by length and digits, whatever their size; other keys come first.
    digits = F.when(F.col("group_key").rlike("^[0-9]+$"), F.ltrim("group_key", F.lit("0"))).otherwise("")
    number = F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)
    keyed = sets.withColumn("_n", number)
    out = []
    for part, kind, label, verb in (
        (2, MISSING, "actions in primary but NOT in replicated:", "Missing action"),
        (3, "unexpected", "actions in replicated but NOT in primary:", "Unexpected action"),
    ):
        mine = keyed.where(F.col("kind") == kind)
        counts = mine.groupBy(e, "dataset").agg(F.count(F.lit(1)).alias("n"))
        head = F.concat(F.lit("  "), F.col("n").cast("string"), F.lit(f" {label}"))
        out.append(_lines(counts, e, _DETAIL, d, 10 * part, F.lit(""), F.array(head)))
        first = sample_per_group(mine, [e, "dataset"], ["_n", "group_key", "item"], MAX_LISTED)
        text = F.format_string(
            f"     - Row %s (%s %s, %s, %s): {verb} '%s'",
            F.coalesce(F.try_element_at("info", F.lit("row_number")), F.col("group_key")),
            known("first_name"),
            known("last_name"),
            known("born_on"),
            F.when(F.col("is_flagged"), "dependent").otherwise("non-dependent"),
            F.col("item"),
        )
        order = F.concat_ws("|", "_n", "group_key", "item")
        out.append(_lines(first, e, _DETAIL, d, 10 * part + 1, order, F.array(text)))
        more = F.concat(F.lit("     ... and "), (F.col("n") - MAX_LISTED).cast("string"), F.lit(" more"))
        out.append(
            _lines(counts.where(F.col("n") > MAX_LISTED), e, _DETAIL, d, 10 * part + 2, F.lit(""), F.array(more))
        )
    return out


def _column_lines(diff: Diff, e: str) -> list[DataFrame]:
    d = F.col("dataset")
    columns = diff.column_diffs
    heads = columns.select(e, "dataset").distinct()
    out = [
        _lines(heads, e, _DETAIL, d, 50, F.lit(""),
               F.array(F.lit("  Columns with differences in matching records:")))
    ]
    # Samples are bounded per column, so this list is too.
    listed = (
        diff.column_samples.groupBy(e, "dataset", "column")
        .agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("keys"), F.count(F.lit(1)).alias("shown"))
    )
    joined = columns.join(listed, [e, "dataset", "column"], "left")
    more = F.col("n_records") - F.coalesce("shown", F.lit(0))
    line = F.format_string(
        "     - %s: %d records (rows: %s%s)",
        F.col("column"),
        F.col("n_records"),
        F.coalesce("keys", F.lit("")),
        F.when(more > 0, F.format_string(", ... (%d more)", more)).otherwise(""),
    )
    kinds = F.concat_ws(
        "; ",
        *[
            F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {label}")))
            for c, label in (
                ("n_primary_only_value", "primary has value/replicated empty"),
                ("n_replicated_only_value", "primary empty/replicated has value"),
                ("n_both_differ", "differing values"),
            )
        ],
    )
    order = F.concat(
        F.lpad((F.lit(10**17) - F.col("n_records")).cast("string"), 18, "0"), F.col("column")
    )
    out.append(
        _lines(joined, e, _DETAIL, d, 51, order, F.array(line, F.concat(F.lit("       "), kinds)))
    )
    return out


def _record_lines(diff: Diff, e: str) -> list[DataFrame]:
    d = F.col("dataset")
    out = []
    for part, presence, counted, label in (
        (60, labels.PRIMARY_ONLY, "n_primary_only", "records in primary but NOT in replicated"),
        (70, labels.REPLICATED_ONLY, "n_replicated_only", "records in replicated but NOT in primary"),
    ):
        some = diff.results.where((F.col(counted) > 0) & (F.col("kind") != "activities"))
        head = F.concat(F.lit("  "), F.col(counted).cast("string"), F.lit(f" {label}"))
        out.append(_lines(some, e, _DETAIL, d, part, F.lit(""), F.array(head)))
        shown = diff.record_samples.where(F.col("presence") == presence)
        counts = shown.groupBy(e, "dataset").agg(F.count(F.lit(1)).alias("n"))
        sample = F.format_string("     Sample (first %d records):", F.col("n"))
        out.append(_lines(counts, e, _DETAIL, d, part + 1, F.lit(""), F.array(sample)))
        w = Window.partitionBy(e, "dataset").orderBy(F.length("key"), "key", "record")
        ranked = shown.withColumn("_i", F.row_number().over(w))
        text = F.format_string("       %d. %s", F.col("_i"), F.col("record"))
        out.append(
            _lines(ranked, e, _DETAIL, d, part + 2, F.lpad(F.col("_i").cast("string"), 6, "0"), F.array(text))
        )
    return out


def write_report(lines: DataFrame, path: str, emp_col: str = "emp_id") -> None:
    """One text file per employer under ``path/emp_id=…``, lines in order."""
    # A report costs its file, not its bytes, by which AQE would merge partitions that have no number.
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartition(partitions, emp_col).sortWithinPartitions(emp_col, "line_no")
    ordered.select(emp_col, F.col("text").alias("value")).write.mode("overwrite").partitionBy(emp_col).text(path)


def report_texts(lines: DataFrame, emp_col: str = "emp_id") -> DataFrame:
    """Every report as one text, as :func:`parse_reports` reads it."""
    gathered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy(emp_col).agg(
        F.array_join(F.transform(gathered, lambda s: s["text"]), "\n").alias("content")
    )


def _holds(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def summary_entries(reports: DataFrame, key: str = "report_file") -> DataFrame:
    """One row per dataset line of the summary block of each report."""
    block = F.regexp_extract("content", SUMMARY_BLOCK, 1)
    lines = reports.select(key, F.posexplode(F.split(block, "\n")).alias("entry_no", "line"))
    same = _holds(F.col("line"), SAME_MARKS)
    differs = ~same & _holds(F.col("line"), DIFF_MARKS)
    note = F.regexp_extract("line", DATASET_WITH_NOTE, 2)
    named = lines.select(
        key,
        "entry_no",
        same.alias("is_same"),
        # A differing line counts only if it has a note.
        F.when(same, F.regexp_extract("line", DATASET_NAME, 1))
        .when(differs, F.regexp_extract("line", DATASET_WITH_NOTE, 1))
        .alias("file_name"),
        F.when(differs, note).alias("note"),
    ).where("file_name <> ''")
    p, r = (F.regexp_extract("note", SIDE_COUNTS, i).try_cast("bigint") for i in (1, 2))
    zero = F.lit(0).cast("bigint")
    return named.select(
        key,
        "entry_no",
        "file_name",
        F.when(F.col("is_same"), labels.IDENTICAL).otherwise(labels.DIFFERENCES).alias("status"),
        F.coalesce(F.greatest(p - r, zero), zero).alias("primary_only_rows"),
        F.coalesce(F.greatest(r - p, zero), zero).alias("replicated_only_rows"),
        F.coalesce("note", F.lit("")).alias("notes"),
    ).withColumn(
        "difference_count",
        F.when(F.col("status") == labels.IDENTICAL, zero).otherwise(
            1 + F.col("primary_only_rows") + F.col("replicated_only_rows")
        ),
    )


def file_sections(reports: DataFrame, key: str = "report_file") -> DataFrame:
    """The ``File:`` sections of each report, with the figures they state."""
    names = F.regexp_extract_all("content", F.lit(FILE_SECTION), 1)
    bodies = F.regexp_extract_all("content", F.lit(FILE_SECTION), 2)
    found = reports.select(key, F.inline(F.arrays_zip(names.alias("file_name"), bodies.alias("body"))))

    def last(pattern: str) -> Column:
        values = F.regexp_extract_all("body", F.lit(pattern), 1)
        return F.try_element_at(values, F.lit(-1)).try_cast("bigint")

    counted = F.transform(
        F.regexp_extract_all("body", F.lit(ROWS_WITH_DIFFERENCES), 1), lambda v: v.cast("bigint")
    )
    # A section of a name seen twice adds to the same entry, in the order of the text.
    return found.groupBy(key, "file_name").agg(
        F.max(last(PRIMARY_ROWS)).alias("primary_rows"),
        F.max(last(REPLICATED_ROWS)).alias("replicated_rows"),
        F.max(last(ROWS_WITH_DIFFERENCES)).alias("row_differences"),
        F.max(F.try_element_at(counted, F.lit(1))).alias("first_row_differences"),
        F.max(last(VALUE_DIFFERENCES)).alias("value_differences"),
        F.max(_holds(F.col("body"), SAME_WORDS)).alias("says_same"),
    )


def parse_reports(reports: DataFrame, key: str = "report_file") -> DataFrame:
    """One row per report and dataset, from rows ``(report_file, content)``."""
    entries = summary_entries(reports, key)
    first = entries.groupBy(key, "file_name").agg(F.min("entry_no").alias("entry_no"))
    sections = file_sections(reports, key).join(first, [key, "file_name"])
    joined = entries.join(sections, [key, "file_name", "entry_no"], "left")
    same = F.coalesce("says_same", F.lit(False))
    zero = F.lit(0).cast("bigint")
    counted = F.when(
        (F.col("difference_count") == 1) & F.col("first_row_differences").isNotNull(),
        F.col("first_row_differences"),
    ).otherwise(F.col("difference_count"))
    return joined.select(
        key,
        "entry_no",
        "file_name",
        F.when(same, labels.IDENTICAL).otherwise(F.col("status")).alias("status"),
        F.when(same, zero).otherwise(counted).alias("difference_count"),
        F.coalesce("row_differences", zero).alias("row_differences"),
        F.coalesce("value_differences", zero).alias("value_differences"),
        "primary_only_rows",
        "replicated_only_rows",
        "primary_rows",
        "replicated_rows",
        "notes",
    )


def report_totals(reports: DataFrame, key: str = "report_file") -> DataFrame:
    """Per report: datasets, identical, differing (by the summary block), sum of differences."""
    # Here a differing line counts with or without a note, as long as it names a dataset.
    lines = reports.select(key, F.explode(F.split(F.regexp_extract("content", SUMMARY_BLOCK, 1), "\n")).alias("line"))
    same, named = _holds(F.col("line"), SAME_MARKS), F.regexp_extract("line", DATASET_NAME, 1) != ""
    entries = lines.groupBy(key).agg(
        F.count_if(same & named).alias("files_identical"),
        F.count_if(~same & _holds(F.col("line"), DIFF_MARKS) & named).alias("files_with_differences"),
    )
    details = parse_reports(reports, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("files_compared"), F.sum("difference_count").alias("total_differences")
    )
    zero = F.lit(0).cast("bigint")
    counts = ["files_compared", "files_identical", "files_with_differences", "total_differences"]
    joined = reports.select(key).join(entries, key, "left").join(details, key, "left")
    return joined.select(key, *[F.coalesce(c, zero).alias(c) for c in counts])


def results_of_reports(parsed: DataFrame) -> DataFrame:
    """Parsed reports in the shape that the roll-ups take."""
    return parsed.withColumnsRenamed(
        {
            "file_name": "dataset",
            "primary_only_rows": "n_primary_only",
            "replicated_only_rows": "n_replicated_only",
            "row_differences": "n_records_with_diffs",
            "notes": "summary",
        }
    )


# Fixed patterns: older report layouts, read section by section.
OLD_NAME = r"(?:Comparing:|File:).*?([\w-]+\.(?:psv|csv))"
OLD_PRIMARY_ONLY = r"(?im)^(?=.*(?:primary only|only in primary)).*?(\d+)"
OLD_REPLICATED_ONLY = r"(?im)^(?=.*(?:replicated only|only in replicated)).*?(\d+)"
OLD_HIGH_FROM = 10


def parse_old_sections(sections: DataFrame, text: str = "section") -> DataFrame:
    """Figures of stand-alone sections of older reports; other columns are kept."""
    t = F.col(text)
    zero = F.lit(0).cast("bigint")
    same = _holds(t, SAME_WORDS)
    differs = _holds(t, ("DIFFERENCES FOUND", "differences found"))
    skipped = ~same & ~differs & F.contains(t, F.lit("SKIPPED"))

    def figure(pattern: str, total: bool) -> Column:
        values = F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), lambda v: v.cast("bigint"))
        one = F.aggregate(values, zero, lambda a, v: a + v) if total else F.try_element_at(values, F.lit(-1))
        return F.when(skipped, zero).otherwise(F.coalesce(one, zero))

    patterns = {
        "row_differences": ROWS_WITH_DIFFERENCES,
        "primary_only_rows": OLD_PRIMARY_ONLY,
        "replicated_only_rows": OLD_REPLICATED_ONLY,
    }
    total = reduce(lambda a, b: a + b, [figure(p, True) for p in patterns.values()])
    p, r, d = (figure(patterns[c], False) for c in ("primary_only_rows", "replicated_only_rows", "row_differences"))
    notes = F.concat_ws(
        "; ",
        F.when(
            skipped & F.contains(F.lower(t), F.lit("not found")), "File not found in one or both databases"
        ),
        F.when(p > 0, F.concat(p.cast("string"), F.lit(" rows only in primary"))),
        F.when(r > 0, F.concat(r.cast("string"), F.lit(" rows only in replicated"))),
        F.when(d > OLD_HIGH_FROM, F.concat(F.lit("HIGH: "), d.cast("string"), F.lit(" rows with differences"))),
    )
    status = (
        F.when(same, labels.IDENTICAL).when(differs, labels.DIFFERENCES)
        .when(skipped, labels.SKIPPED).otherwise("UNKNOWN")
    )
    return sections.select(
        *[c for c in sections.columns if c != text],
        F.regexp_extract(t, OLD_NAME, 1).alias("file_name"),
        status.alias("status"),
        total.alias("difference_count"),
        *[figure(pat, False).alias(c) for c, pat in patterns.items()],
        figure(VALUE_DIFFERENCES, False).alias("value_differences"),
        notes.alias("notes"),
    )
