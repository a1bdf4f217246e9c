"""Gates as a stream with timers: runs that may be compared, or why not, come out by themselves, and state expires.

A run waits for its sources from its first status row on. A source is done at its first row that says so; the run is
complete once all are, if that is within ``max_wait`` of the first row, and has timed out if that time goes by without.
A complete run is released if a file of its own has arrived by then, and if the newest readings of its dead-letter queues are
empty. All of it is decided in event time: a run's row comes out when the watermark has passed the moment in question, so no row
that the watermark still lets in can change it, and the result does not depend on how rows fall into micro-batches. What is
decided stays so; later rows of the run are ignored until its state expires after ``keep``.

Nothing is read again: each row is seen once, and a restart goes on from the checkpoint. State per open run is its first time, a time per
source and the readings of its queues; a closed run keeps one flag. Rows behind the watermark are dropped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Outcomes of a wait.
RELEASED = "released"
COMPLETE = "complete"
TIMED_OUT = "timed out"
NO_FILE = "no file"
DEAD_LETTERS = "dead letters"

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVAL, STATUS, LETTERS = "arrival", "status", "letters"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_MICRO = timedelta(microseconds=1)


def _time(micros: int) -> datetime:
    return _EPOCH + timedelta(microseconds=micros)


class GateProcessor(StatefulProcessor):
    """State and timers of one run; times are microseconds since 1970 and timers milliseconds."""

    def __init__(self, name: str, sources: Sequence[str], max_wait: timedelta, keep: timedelta, gated: bool):
        self.name, self.sources, self.gated = name, list(sources), gated
        self.max_wait, self.keep = max_wait // _MICRO, keep // _MICRO

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first bigint, arrived bigint, closed boolean")
        self.done = handle.getMapState("done", "source string", "at bigint")
        self.letters = handle.getMapState("letters", "queue string, at bigint", "messages bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, arrived, closed = self.run.get() if self.run.exists() else (None, None, False)
        if closed:
            return
        times = {}
        for row in rows:
            at, source = row["micros"], row["source"]
            if row["kind"] == ARRIVAL:
                arrived = at if arrived is None else min(arrived, at)
            elif row["kind"] == LETTERS:
                self.letters.updateValue((source, at), (row["messages"],))
            else:
                first = at if first is None else min(first, at)
                if row["done"] and source in self.sources:
                    times[source] = min(times.get(source, at), at)
        for source, at in times.items():
            self.done.updateValue((source,), (min(at, self._done_at(source) or at),))
        self.run.update((first, arrived, False))
        if first is not None:
            self._wake_at(self._moment(first)[0])
        return
        yield  # rows come out by timers alone

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.run.exists():
            return
        first, arrived, closed = self.run.get()
        if closed:
            self.run.clear()
            return
        at, pending = self._moment(first)
        if expiredTimerInfo.getExpiryTimeInMs() < -(-at // 1000):  # rows have moved the moment
            self._wake_at(at)
            return
        outcome = TIMED_OUT if pending else self._gate(arrived, at) if self.gated else COMPLETE
        self.done.clear()
        self.letters.clear()
        self.run.update((first, arrived, True))
        self._wake_at(at + self.keep)
        rest = {"outcome": outcome, "first_ts": _time(first), "decided_at": _time(at), "pending": ",".join(pending)}
        yield Row(**{self.name: key[0]}, **rest)

    def _done_at(self, source: str) -> int | None:
        return self.done.getValue((source,))[0] if self.done.containsKey((source,)) else None

    def _moment(self, first: int) -> tuple[int, list[str]]:
        """When the wait ends, going by the rows so far, and the sources that are not done by then."""
        times = {source: self._done_at(source) for source in self.sources}
        pending = [s for s, at in times.items() if at is None or at > first + self.max_wait]
        return first + self.max_wait if pending else max(times.values()), pending

    def _gate(self, arrived: int | None, at: int) -> str:
        if arrived is None or arrived > at:
            return NO_FILE
        newest: dict[str, tuple[int, int]] = {}
        for (queue, seen), (messages,) in self.letters.iterator():
            if seen <= at:
                newest[queue] = max(newest.get(queue, (seen, messages or 0)), (seen, messages or 0))
        return DEAD_LETTERS if any(messages > 0 for _, messages in newest.values()) else RELEASED

    def _wake_at(self, micros: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-micros // 1000))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Set the session's state store to the one that timers need."""
    spark.conf.set(STATE_STORE, ROCKS_DB)


def _rows(df: DataFrame, kind: str, run: str, ts: str, source: str | None, done: bool, messages: bool) -> DataFrame:
    """Rows of one kind with the watermark's column; rows without a run or a time go."""
    named = df.select(
        run,
        F.lit(kind).alias("kind"),
        (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"),
        F.col(ts).cast("timestamp").alias("at"),
        (F.coalesce("done", F.lit(False)) if done else F.lit(False)).alias("done"),
        (F.greatest(F.coalesce("messages", F.lit(0)), F.lit(0)).cast("bigint") if messages else F.lit(0).cast("bigint")).alias("messages"),
    )
    return named.where(F.col("at").isNotNull() & F.col(run).isNotNull())


def _outcomes(rows: DataFrame, run: str, sources, max_wait, lateness, keep, gated: bool) -> DataFrame:
    if not sources:
        raise ValueError("no sources to wait for")
    use_state_store(rows.sparkSession)
    # The processor travels by value, so that executors need not have this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    marked = rows.withColumn("micros", F.unix_micros("at")).withWatermark("at", f"{lateness // _MICRO} microseconds")
    return marked.groupBy(run).transformWithState(
        GateProcessor(run, sources, max_wait, keep, gated),
        outputStructType=f"`{run}` {dict(rows.dtypes)[run]}, outcome string, first_ts timestamp, decided_at timestamp, pending string",
        outputMode="Append",
        timeMode="EventTime",
    )


def latch_outcomes(
    status: DataFrame,
    sources: Sequence[str],
    max_wait: timedelta = timedelta(hours=2),
    lateness: timedelta = timedelta(minutes=10),
    keep: timedelta = timedelta(days=1),
    run: str = "run_id",
    ts: str = "ts",
) -> DataFrame:
    """From a stream of status rows (run, source, ts, done), one row per run once it is complete or has timed out.

    Columns: run, outcome, first_ts, decided_at, pending (sources, in the order given). ``lateness`` is how much later than
    others a row may arrive. Sets the session's state store.
    """
    rows = _rows(status, STATUS, run, ts, "source", True, False)
    return _outcomes(rows, run, sources, max_wait, lateness, keep, False)


def release_outcomes(
    arrivals: DataFrame,
    status: DataFrame,
    dead_letters: DataFrame,
    sources: Sequence[str],
    max_wait: timedelta = timedelta(hours=2),
    lateness: timedelta = timedelta(minutes=10),
    keep: timedelta = timedelta(days=1),
    run: str = "run_id",
    ts: str = "ts",
) -> DataFrame:
    """From three streams, one row per run once it is released, or blocked for good, with the columns of :func:`latch_outcomes`.

    ``arrivals`` (run, ts), ``status`` (run, source, ts, done) and ``dead_letters`` (run, queue, ts, messages) meet by run in
    one state; they share one watermark. Outcomes: released, timed out, no file, dead letters, in the order in which the gates are asked.
    A failed reading of a queue (null or below 0) counts as empty.
    """
    rows = _rows(status, STATUS, run, ts, "source", True, False)
    rows = rows.unionByName(_rows(arrivals, ARRIVAL, run, ts, None, False, False))
    rows = rows.unionByName(_rows(dead_letters, LETTERS, run, ts, "queue", False, True))
    return _outcomes(rows, run, sources, max_wait, lateness, keep, True)


def append_to(outcomes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write outcomes as they come, each run once, also over restarts; returns the running query."""
    writer = outcomes.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.option("path", path).trigger(**(trigger or {"availableNow": True})).start()
