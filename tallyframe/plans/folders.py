"""Compare what is on storage: run folders of delimited files, or exported tables."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import labels
from tallyframe.plans.compare import Diff, compare_run, compare_tables, error_result, union_diffs
from tallyframe.plans.rules import CompareRules, DatasetSpec, spec_for
from tallyframe.session import cut_lineage
from tallyframe.sources import delimited, runs

EMP = "emp_id"
_TOO_LONG = "rows with more fields than the header"


def run_files(
    spark: SparkSession,
    base: str,
    employers: DataFrame | None = None,
    stamp: str | None = None,
    sides: tuple[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Files of each employer's newest run with their side, and why other runs are left out.

    ``sides`` names the two targets to compare; without it a run must have exactly two, and the
    first in name order is the primary.
    """
    files = runs.list_files(spark, base).where(~F.col("file_name").rlike(runs.REPORT_NAME))
    listed = runs.list_runs(files)
    if employers is not None:
        listed = listed.join(employers.select(EMP), EMP, "left_semi")
    # The listing is a handful of columns per file; keep it, as it is read several times.
    listed = cut_lineage(listed, "listing")
    newest = runs.latest_run(listed, stamp).select(EMP, "run_id")
    mine = listed.join(newest, [EMP, "run_id"])
    if sides:
        primary, replicated = sides
        chosen = mine.where(F.col("target").isin(primary, replicated))
        return chosen.withColumn("is_primary", F.col("target") == primary), mine.limit(0).select(EMP, "run_id")
    found = runs.run_sides(mine)
    chosen = mine.join(found.where("problem IS NULL"), [EMP, "run_id"]).where(
        "target IN (primary_target, replicated_target)"
    )
    problems = found.where("problem IS NOT NULL").select(EMP, "run_id", "problem")
    return chosen.withColumn("is_primary", F.expr("target = primary_target")), problems


def _read(spark: SparkSession, paths: Sequence[str], header: str, sep: str) -> DataFrame:
    """Files of one header as text, with the employer from the path."""
    schema = T.StructType(
        [T.StructField(n.strip('"'), T.StringType()) for n in header.split(sep)]
        + [T.StructField(delimited.CORRUPT, T.StringType())]
    )
    rows = delimited.csv_reader(spark, sep).schema(schema).option(
        "columnNameOfCorruptRecord", delimited.CORRUPT
    ).csv(list(paths))
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
    employer = F.substring_index(F.url_decode(F.regexp_replace(folder, r"\+", "%2B")), " ", 1)
    return rows.select("*", employer.alias(EMP))


def compare_folders(
    spark: SparkSession,
    base: str,
    rules: CompareRules | None = None,
    employers: DataFrame | None = None,
    stamp: str | None = None,
    sides: tuple[str, str] | None = None,
    specs: Mapping[str, DatasetSpec] | None = None,
    stored: bool = True,
) -> Diff:
    """Compare the newest run of every employer under ``base/{date}/{employer stamp}/{target}/``.

    Datasets on both sides compare unless excluded. All employers whose files have the same
    headers share one comparison. A dataset with overlong rows is an ``ERROR`` for its employer
    only.
    """
    rules = rules or CompareRules()
    chosen, _ = run_files(spark, base, employers, stamp, sides)
    chosen = cut_lineage(chosen.select(EMP, "dataset", "is_primary", "path"), "chosen")
    heads = delimited.header_separators(spark, f"{base.rstrip('/')}/*/*/*").select(
        F.col("file_path").alias("path"), "header", "separator"
    )
    # File names and header lines only: as many rows as there are files, like any file listing.
    groups: dict[tuple, dict[bool, list[str]]] = defaultdict(lambda: {True: [], False: []})
    by_pair: dict[tuple[str, str], dict[bool, tuple[str, str, str]]] = defaultdict(dict)
    headers = {_plain(r["path"]): (r["header"], r["separator"]) for r in heads.collect()}
    for r in chosen.collect():
        header, sep = headers.get(_plain(r["path"]), ("", "|"))
        by_pair[r[EMP], r["dataset"]][r["is_primary"]] = (r["path"], header or "", sep)
    for (_, dataset), two in by_pair.items():
        if len(two) == 2 and not rules.is_excluded(dataset):
            key = (dataset, *two[True][1:], *two[False][1:])
            for side in (True, False):
                groups[key][side].append(two[side][0])

    diffs: list[Diff] = []
    for (dataset, p_header, p_sep, r_header, r_sep), paths in sorted(groups.items()):
        spec = (specs or {}).get(dataset) or spec_for(dataset)
        try:
            raw = [_read(spark, paths[True], p_header, p_sep), _read(spark, paths[False], r_header, r_sep)]
            seps = (p_sep, r_sep)
            broken = _overlong(raw, seps)
            good = [delimited.good_rows(df, sep) for df, sep in zip(raw, seps)]
            if not broken.isEmpty():
                good = [df.join(broken, EMP, "left_anti") for df in good]
                diffs.append(Diff(results=_overlong_results(broken, dataset, spec)))
            diffs.append(compare_tables(*good, dataset, spec, rules, [EMP], stored))
        except Exception as problem:  # one dataset must not stop the others
            text = str(problem).splitlines()[0]
            diffs.append(Diff(results=error_result(spark, dataset, spec.kind, text, f"{EMP} string")))
    if not diffs:
        raise ValueError(f"no datasets to compare under {base}")
    return union_diffs(diffs)


def _plain(path: str) -> str:
    """A path without scheme and escapes, to match listings of different origin."""
    return "/" + unquote(path.split(":", 1)[-1]).lstrip("/")


def _overlong(raw: Iterable[DataFrame], seps: Sequence[str]) -> DataFrame:
    """Employers with overlong rows on either side (stored: a short list of ids)."""
    # The last two columns are the raw text and the employer.
    found = [delimited.overlong(df, len(df.columns) - 2, sep).select(EMP) for df, sep in zip(raw, seps)]
    return cut_lineage(found[0].unionByName(found[1]).distinct(), "overlong")


def _overlong_results(broken: DataFrame, dataset: str, spec: DatasetSpec) -> DataFrame:
    row = error_result(broken.sparkSession, dataset, spec.kind, _TOO_LONG)
    return broken.withColumn("dataset", F.lit(dataset)).join(row, "dataset").select(EMP, *row.columns)


def load_export(spark: SparkSession, out: str, dataset: str, target: str) -> DataFrame:
    """One side of an exported dataset, for all employers; ids are text, as they were written."""
    path = f"{out.rstrip('/')}/dataset={dataset}"
    folders = (EMP, "target", "run_date", "run_ts")
    found = spark.read.option("basePath", path).parquet(path).schema
    # A given schema keeps folder names as they are; inferred, "007" would become 7.
    kept = T.StructType([T.StructField(f.name, T.StringType()) if f.name in folders else f for f in found])
    rows = spark.read.option("basePath", path).schema(kept).parquet(path)
    return rows.where(F.col("target") == target).drop("target", "run_date", "run_ts")


def compare_exports(
    spark: SparkSession,
    out: str,
    datasets: Iterable[str],
    targets: tuple[str, str],
    rules: CompareRules | None = None,
    employers: DataFrame | None = None,
    specs: Mapping[str, DatasetSpec] | None = None,
    stored: bool = True,
) -> Diff:
    """Compare two targets of exported datasets, optionally for some employers only."""
    tables = {}
    for name in datasets:
        two = [load_export(spark, out, name, t) for t in targets]
        if employers is not None:
            two = [df.join(employers.select(EMP), EMP, "left_semi") for df in two]
        tables[name] = (two[0], two[1])
    return compare_run(spark, tables, rules, specs, by=[EMP], stored=stored)


def differing_employers(diff: Diff) -> DataFrame:
    """How many datasets differ or failed per employer."""
    return diff.results.groupBy(EMP).agg(
        F.count_if(~F.col("match")).alias("n_different"),
        F.count_if(F.col("status") == labels.ERROR).alias("n_failed"),
    )
