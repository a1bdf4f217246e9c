"""Parameterised SQL as a source, and the export of many datasets."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.values import minutes_between
from tallyframe.operators.layout import balanced_by
from tallyframe.sources.delimited import write_delimited

# Names in SQL templates.
EMPLOYER = "employer_id"
INTERVAL = "time_interval"

_SLOT = re.compile(r"(?:\bINTERVAL\s+)?'?\{\{(\w+)\}\}'?", re.IGNORECASE)


def query_source(
    spark: SparkSession,
    query: str,
    args: Mapping[str, Any] | None = None,
    views: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Run SQL with ``:name`` parameters over registered views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=dict(args or {}))


def jdbc_source(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The same over JDBC: the database runs the query, Spark reads its result.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` (with
    ``dbtable`` instead of a query) to read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url)
    if "dbtable" not in options:
        reader = reader.option("query", query)
    return reader.options(**options).load()


@dataclass(frozen=True)
class QueryTemplate:
    """SQL text with ``{{employer_id}}`` and ``{{time_interval}}`` slots.

    Slots turn into named parameters, so values are never spliced into the text.
    """

    text: str

    def __post_init__(self) -> None:
        for literal in re.findall(r"'(?:[^']|'')*'", self.text):
            if "{{" in literal and not re.fullmatch(r"'\{\{\w+\}\}'", literal):
                raise ValueError(f"a slot inside a longer text, {literal}: join the parts with || instead")

    @property
    def sql(self) -> str:
        return _SLOT.sub(lambda m: ":" + m.group(1), self.text)

    @property
    def slots(self) -> set[str]:
        return {m.group(1) for m in _SLOT.finditer(self.text)}

    def args(
        self, employer_id: Any, lookback_minutes: int | None = None, on_missing: str = "error"
    ) -> dict[str, Any]:
        """Arguments for the slots; a missing lookback is an error or no lower bound."""
        out: dict[str, Any] = {}
        if EMPLOYER in self.slots:
            out[EMPLOYER] = employer_id
        if INTERVAL in self.slots:
            if lookback_minutes is not None:
                out[INTERVAL] = timedelta(minutes=lookback_minutes)
            elif on_missing == "unbounded":
                out[INTERVAL] = datetime.now() - datetime.min  # back to the first day of year 1
            else:
                raise ValueError(f"the query needs {INTERVAL}, but no lookback is known")
        return out

    def run(self, spark: SparkSession, employer_id: Any, lookback_minutes: int | None = None,
            on_missing: str = "error") -> DataFrame:
        return spark.sql(self.sql, args=self.args(employer_id, lookback_minutes, on_missing))


    def run_for_all(
        self, spark: SparkSession, employers: DataFrame, emp_col: str = "emp_id",
        lookback_col: str = "lookback_minutes",
    ) -> DataFrame:
        """The template for every row of ``employers`` in one query, with ``emp_col`` in front.

        The slots become columns of a lateral join, which Spark turns into a plain join.
        """
        employers.createOrReplaceTempView("_employers")
        columns = {
            EMPLOYER: f"_employers.`{emp_col}`",
            INTERVAL: f"make_dt_interval(0, 0, CAST(_employers.`{lookback_col}` AS INT), 0)",
        }
        body = _SLOT.sub(lambda m: columns[m.group(1)], self.text)
        return spark.sql(f"SELECT _employers.`{emp_col}`, q.* FROM _employers, LATERAL ({body}) AS q")


def lookbacks(deposits: DataFrame, by: Sequence[str], ts_col: str, as_of) -> DataFrame:
    """Per employer: newest deposit time and whole minutes from it to ``as_of``."""
    return (
        deposits.groupBy(*by)
        .agg(F.max(ts_col).alias("latest_at"))
        .withColumn("lookback_minutes", minutes_between(F.col("latest_at"), as_of))
    )


def one_row(df: DataFrame, order: Sequence[Any]) -> DataFrame:
    """The first row in the given order, as a DataFrame (empty if there is none)."""
    return df.orderBy(*order).limit(1)


def export_datasets(
    spark: SparkSession,
    queries: Mapping[str, str],
    out: str,
    target: str,
    emp_col: str = "emp_id",
    employers: DataFrame | None = None,
    args: Mapping[str, Any] | None = None,
    fmt: str = "parquet",
    run_date: str | None = None,
    run_ts: str | None = None,
) -> dict[str, str]:
    """Write every dataset's query for all employers at once; returns status per dataset.

    Queries are SQL over registered views and return an ``emp_col`` column. Layout:
    ``out/dataset=…/[run_date=…/run_ts=…/]target=…/emp_id=…``. A failing query gets status
    ``error: …`` and the others go on.
    """
    status: dict[str, str] = {}
    for name, text in queries.items():
        if not text:
            status[name] = "skipped: no query"
            continue
        try:
            df = spark.sql(QueryTemplate(text).sql, args=dict(args or {}))
            if employers is not None:
                df = df.join(employers.select(emp_col), emp_col, "left_semi")
            df = balanced_by(df, emp_col)
            path = "/".join(
                [out.rstrip("/"), f"dataset={name}"]
                + ([f"run_date={run_date}"] if run_date else [])
                + ([f"run_ts={run_ts}"] if run_ts else [])
                + [f"target={target}"]
            )
            if fmt == "parquet":
                # Employers that are not part of this export keep what an earlier one wrote.
                df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(emp_col).parquet(path)
            else:
                write_delimited(df, path, partition_by=[emp_col], mode="overwrite")
            status[name] = "ok"
        except Exception as problem:  # one dataset must not stop the others
            status[name] = f"error: {problem}"
    return status
