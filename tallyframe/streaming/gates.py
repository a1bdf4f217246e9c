"""Completion gates over status tables; the aggregations work on batch and streaming frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.functions.values import created_on
from tallyframe.operators.ranking import child_of_latest, latest_per_group

# States and reasons of the gates.
PROCESSED = "processed"
NO_DATASET = "no_dataset"
NO_FILE = "no file"
NOT_TODAY = "newest file is not of the day"
FAILED_READ = -1


def latest_deposits(deposits: DataFrame, by: str = "emp_id", ts: str = "created_at") -> DataFrame:
    """Newest deposit per employer: its id, state and time. Streams run it in update mode."""
    newest = F.max(F.struct(F.col(ts), F.col("id"), F.col("state"))).alias("_d")
    return deposits.groupBy(by).agg(newest).select(
        by, F.col("_d.id").alias("file_id"), F.col("_d.state").alias("state"), F.col(f"_d.{ts}").alias(ts)
    )


def arrival_gate(
    deposits: DataFrame, as_of: Column, employers: DataFrame | None = None, by: str = "emp_id",
    ts: str = "created_at",
) -> DataFrame:
    """Did each employer's newest deposit arrive on the day ``as_of``, and if not, why."""
    newest = latest_deposits(deposits, by, ts)
    if employers is not None:
        newest = employers.select(by).join(newest, by, "left")
    arrived = created_on(F.col(ts), as_of)
    return newest.select(
        by,
        "file_id",
        "state",
        arrived.alias("has_arrived"),
        F.when(F.col("file_id").isNull(), NO_FILE).when(~arrived, NOT_TODAY).alias("reason"),
    )


def state_completion(
    deposits: DataFrame,
    datasets: DataFrame,
    by: str = "emp_id",
    which: str = "earliest",
    deposit_order: Sequence[str] = ("id",),
) -> DataFrame:
    """Is the dataset of each employer's newest file processed?

    The newest file is that with the greatest ``deposit_order``, its dataset the ``which`` one by
    ``created_at``. Employers whose file has no dataset have status ``no_dataset``.
    """
    child = child_of_latest(
        deposits,
        datasets.select("deposited_file_id", F.col("id").alias("dataset_id"), "state", "created_at"),
        [by],
        "id",
        list(deposit_order),
        "deposited_file_id",
        ["created_at", "dataset_id"],
        which,
    )
    return child.select(
        by,
        F.col("deposited_file_id").alias("file_id"),
        "dataset_id",
        F.when(F.col("dataset_id").isNull(), NO_DATASET)
        .otherwise(F.coalesce("state", F.lit("")))
        .alias("status"),
        F.coalesce(F.col("state") == PROCESSED, F.lit(False)).alias("is_complete"),
    )


def latest_depths(depths: DataFrame, by: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Newest reading per queue of ``visible``, ``in_flight`` and ``delayed`` messages."""
    newest = F.max(F.struct(F.col(ts), "visible", "in_flight", "delayed")).alias("_q")
    return depths.groupBy(*by, "queue").agg(newest).select(
        *by, "queue", F.col(f"_q.{ts}").alias(ts), "_q.visible", "_q.in_flight", "_q.delayed"
    )


def queue_drain(latest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Complete if at least one queue is known and every one is empty.

    A null depth means the reading failed: that queue is unknown, so nothing is complete.
    """
    total = F.col("visible") + F.col("in_flight") + F.col("delayed")
    sums = (
        F.count(F.lit(1)).alias("n_queues"),
        F.coalesce(F.sum(total), F.lit(0)).alias("total_messages"),
        F.count_if(total.isNull()).alias("n_unknown"),
        F.count_if(total > 0).alias("n_busy"),
    )
    grouped = latest.groupBy(*by).agg(*sums) if by else latest.agg(*sums)
    done = (F.col("n_queues") > 0) & (F.col("n_busy") == 0) & (F.col("n_unknown") == 0)
    return grouped.withColumn("is_complete", done).withColumn(
        "reason",
        F.when(F.col("n_queues") == 0, "no queue known")
        .when(F.col("n_unknown") > 0, "depth unknown")
        .when(F.col("n_busy") > 0, "messages left"),
    )


def dlq_gate(latest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Messages in dead-letter queues, from rows ``(queue, messages)``; any blocks the comparison.

    A failed reading (null or -1) adds nothing to the total but is counted.
    """
    known = F.when(F.col("messages") >= 0, F.col("messages"))
    sums = (
        F.count(F.lit(1)).alias("n_queues"),
        F.coalesce(F.sum(known), F.lit(0)).alias("total_messages"),
        F.count_if(known.isNull()).alias("n_failed_reads"),
    )
    grouped = latest.groupBy(*by).agg(*sums) if by else latest.agg(*sums)
    return grouped.withColumn("has_errors", F.col("total_messages") > 0)


def latch(status: DataFrame, sources: Sequence[str], run: str = "run_id", ts: str = "ts") -> DataFrame:
    """One row per run: which sources have ever been done, and whether all have.

    Once done, a source stays done. One aggregation with one row of state per run, so it streams
    in update or complete mode; late rows cannot undo a latch.
    """
    if not sources:
        raise ValueError("no sources to wait for")
    done = [
        F.coalesce(F.max(F.when(F.col("source") == s, F.col("done"))), F.lit(False)).alias(f"done_{i}")
        for i, s in enumerate(sources)
    ]
    latched = status.groupBy(run).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *done)
    flags = [F.col(f"done_{i}") for i in range(len(sources))]
    pending = F.concat_ws(",", *[F.when(~f, F.lit(s)) for s, f in zip(sources, flags)])
    return latched.select(run, "first_ts", "last_ts", (pending == "").alias("is_complete"), pending.alias("pending"))


def latch_sources(status: DataFrame, run: str = "run_id", ts: str = "ts") -> DataFrame:
    """The latch of every run and source, when the sources are not known beforehand (batch)."""
    return status.groupBy(run, "source").agg(
        F.max("done").alias("latched"),
        F.min(ts).alias("first_ts"),
        F.min(F.when(F.col("done"), F.col(ts))).alias("done_at"),
    )


def with_timeout(latched: DataFrame, as_of: Column, max_wait_seconds: int = 7200) -> DataFrame:
    """Adds ``timed_out``, judged when the latch is read: an idle stream cannot do it."""
    waited = F.timestamp_diff("SECOND", F.col("first_ts"), as_of)
    return latched.withColumn("timed_out", ~F.col("is_complete") & (waited > max_wait_seconds))


def release_plan(arrivals: DataFrame, latched: DataFrame, dead_letters: DataFrame, run: str = "run_id") -> DataFrame:
    """Arrival, completion and dead-letter gate in order: which runs may be compared, or why not."""
    joined = arrivals.select(run, "has_arrived").join(latched.select(run, "is_complete"), run, "left").join(
        dead_letters.select(run, "has_errors"), run, "left"
    )
    arrived, complete = F.coalesce("has_arrived", F.lit(False)), F.coalesce("is_complete", F.lit(False))
    errors = F.coalesce("has_errors", F.lit(False))
    return joined.select(
        run,
        (arrived & complete & ~errors).alias("is_released"),
        F.when(~arrived, "no file").when(~complete, "not complete").when(errors, "dead letters").alias("blocked_by"),
    )


def release_stream(
    status: DataFrame,
    sources: Sequence[str],
    on_release: Callable[[DataFrame, int], None],
    path: str,
    checkpoint: str,
    gate: Callable[[DataFrame], DataFrame] | None = None,
    run: str = "run_id",
    ts: str = "ts",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Stream of status rows that calls ``on_release(runs, batch_id)`` once per completed run.

    ``gate`` filters completed runs (arrival, dead letters). Completed and released runs are tables
    under ``path``, one folder per micro-batch: a repeated batch rewrites its own folders and so
    releases the same runs again, never others twice. Put both paths on shared storage.
    """
    latched = latch(status, sources, run, ts)

    def release(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = batch.where("is_complete").select(run, "first_ts", "last_ts")
        done.write.mode("overwrite").parquet(batch_folder(f"{path}/completed", batch_id))
        # A run that the gate held back is tried again with every later batch.
        ready = read_batches(spark, f"{path}/completed").drop(BATCH).groupBy(run).agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
        )
        earlier = read_batches(spark, f"{path}/released")
        if earlier is not None:
            mine = earlier.where(F.col(BATCH) < batch_id).select(run)
            ready = ready.join(mine, run, "left_anti")
        if gate is not None:
            ready = gate(ready)
        folder = batch_folder(f"{path}/released", batch_id)
        ready.write.mode("overwrite").parquet(folder)
        fresh = spark.read.schema(ready.schema).parquet(folder)
        if not fresh.isEmpty():
            on_release(fresh, batch_id)

    return start_batches(latched, release, checkpoint, trigger)


BATCH = "batch_id"


def batch_folder(path: str, batch_id: int) -> str:
    """Folder of one micro-batch: writing it again replaces it, so a repeated batch is harmless."""
    return f"{path.rstrip('/')}/{BATCH}={batch_id}"


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """All micro-batches written under ``path``, or None before the first one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def start_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    output_mode: str = "update",
) -> StreamingQuery:
    """Start a stream that hands every micro-batch to ``handle(batch, batch_id)``."""
    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(handle).trigger(**(trigger or {"availableNow": True})).start()


def stream_to_table(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the changed rows of a streaming aggregation, one folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return start_batches(stream, write, checkpoint, trigger)


def current_rows(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The newest row of each key of a table that :func:`stream_to_table` writes."""
    rows = read_batches(spark, path)
    return latest_per_group(rows, list(key), [BATCH]).drop(BATCH)
