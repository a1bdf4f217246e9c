"""Session helpers: shared scratch space and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that suit this library. The last one saves driver time: without it, every column
# expression records its call site.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_LISTING_KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only when the session is local."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and go on from there.

    One pass, columnar, and readers prune columns; a lost executor loses nothing.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Sources that are loaded inside list many folders in a few tasks per core; by default Spark starts one per folder, up to 10,000."""
    before = spark.conf.get(_LISTING_KEY)
    spark.conf.set(_LISTING_KEY, min(int(before), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(_LISTING_KEY, before)
