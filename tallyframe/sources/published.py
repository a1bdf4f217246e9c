"""Write, audit, publish: readers see a table only once it is whole.

A publication is written to a folder of its own, read back and audited, and then published by one small file in the manifest, with a
row per employer: how many rows, and the date and stamp of the run. Readers go by the manifest. So an export that was interrupted, failed, or did
not pass its audit is never seen, not even in part, and each employer has what was last published for it, also if a
later publication held other employers only. Nothing is overwritten; earlier publications can be read by their date.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.values import run_stamp
from tallyframe.operators.layout import balanced_by
from tallyframe.operators.ranking import latest_per_group
from tallyframe.sources.sql import QueryTemplate

PUBLICATION = "publication"
Audit = Callable[[DataFrame], "str | None"]


class NotPublished(RuntimeError):
    """An audit found something wrong; the publication stays unseen."""


def no_null_employer(emp_col: str = "emp_id") -> Audit:
    """An audit for tables in which every row needs an employer."""
    return lambda rows: f"rows without {emp_col}" if not rows.where(F.col(f"`{emp_col}`").isNull()).isEmpty() else None


def publish(df: DataFrame, path: str, run_at: datetime, emp_col: str = "emp_id", audits: tuple[Audit, ...] = ()) -> str:
    """Write ``df`` by employer, audit what was written and publish it; returns the publication's name.

    An audit gets the rows as readers will see them and returns what is wrong with them, or None. Rows are written by size:
    a large employer by many tasks, small ones together.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    own = f"{run_at:%Y%m%d%H%M}-{uuid.uuid4().hex}"
    kept = df.withColumn(PUBLICATION, F.lit(own)).withColumn("_employer", F.col(f"`{emp_col}`"))
    folder = f"{path}/data"
    balanced_by(kept, emp_col).write.mode("append").partitionBy(PUBLICATION, "_employer").parquet(folder)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes)
    written = spark.read.schema(schema).parquet(folder).where(F.col(PUBLICATION) == own)
    for audit in audits:
        if problem := audit(written.drop(PUBLICATION, "_employer")):
            raise NotPublished(problem)
    at = F.lit(run_at).cast("timestamp_ntz")
    rows = written.groupBy(F.col("_employer").alias(emp_col)).agg(F.count(F.lit(1)).alias("n_rows"))
    named = rows.select(
        F.lit(own).alias(PUBLICATION),
        emp_col,
        "n_rows",
        F.date_format(at, "MM-dd-yy").alias("run_date"),
        run_stamp(at).alias("run_stamp"),
        at.alias("run_at"),
        F.current_timestamp().cast("timestamp_ntz").alias("published_at"),
        F.lit(schema).alias("columns"),
    )
    # One file, so one rename makes all of it visible.
    named.coalesce(1).write.parquet(f"{path}/manifest/{own}")
    return own


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """What has been published, a row per publication and employer; None before the first one."""
    try:
        return spark.read.parquet(f"{path.rstrip('/')}/manifest/*")
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def published(
    spark: SparkSession, path: str, emp_col: str = "emp_id", run_date: str | None = None, with_run: bool = False
) -> DataFrame:
    """The rows last published for each employer, optionally of runs of one date (MM-DD-YY) only.

    Only the folders of these publications and employers are read. ``with_run`` adds run_at and run_stamp.
    """
    known = manifest(spark, path)
    if known is None:
        raise FileNotFoundError(f"nothing is published under {path}")
    columns = known.orderBy(F.desc("published_at")).select("columns").first()["columns"]
    if run_date is not None:
        known = known.where(F.col("run_date") == run_date)
    last = latest_per_group(known.drop("columns"), [emp_col], ["run_at", "published_at", PUBLICATION])
    last = last.select(F.col(PUBLICATION).alias("_of"), F.col(f"`{emp_col}`").alias("_emp"), "run_at", "run_stamp")
    rows = spark.read.schema(columns).parquet(f"{path.rstrip('/')}/data")
    same = (F.col(PUBLICATION) == F.col("_of")) & F.col("_employer").eqNullSafe(F.col("_emp"))
    joined = rows.join(last, same).drop(PUBLICATION, "_employer", "_of", "_emp")
    return joined if with_run else joined.drop("run_at", "run_stamp")


def export_published(
    spark: SparkSession,
    queries: Mapping[str, str],
    out: str,
    target: str,
    run_at: datetime,
    emp_col: str = "emp_id",
    employers: DataFrame | None = None,
    args: Mapping[str, Any] | None = None,
    audits: tuple[Audit, ...] = (),
) -> dict[str, str]:
    """Publish every dataset's query for all employers below ``out/dataset=…/target=…``; returns status per dataset.

    A query that fails, before or while running, or an audit that does, leaves what was published before, and the others go on.
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
            publish(df, f"{out.rstrip('/')}/dataset={name}/target={target}", run_at, emp_col, audits)
            status[name] = "ok"
        except Exception as problem:  # one dataset must not stop the others
            status[name] = f"error: {str(problem).splitlines()[0]}"
    return status
