"""Queries of the completion gates, batch and streaming."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tallyframe.session import scratch_path
from tallyframe.streaming import gates, latches
from workload.data import run_sql
from workload.registry import query

SOURCES = ["view", "click", "error"]


@query(
    """SELECT emp_id, file_id, state, CAST(created_at AS DATE) = DATE '2024-01-31' AS has_arrived,
 CASE WHEN CAST(created_at AS DATE) <> DATE '2024-01-31' THEN 'newest file is not of the day' END AS reason
FROM (SELECT user_id AS emp_id, event_id AS file_id, event_type AS state, ts AS created_at, row_number() OVER (
 PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"""
)
def arrival_gate(spark, sf):
    deposits = run_sql(
        spark, sf, "SELECT user_id AS emp_id, event_id AS id, event_type AS state, ts AS created_at FROM events"
    )
    return gates.arrival_gate(deposits, F.to_date(F.lit("2024-01-31")))


_DATASETS = """SELECT l_orderkey AS deposited_file_id, l_partkey * 1000000 + l_suppkey * 10 + l_linenumber AS id,
 CASE WHEN l_partkey % 3 = 0 THEN 'processed' ELSE 'cleaning' END AS state, l_shipdate AS created_at FROM lineitem"""


def _state_sql(parent_order, direction):
    return f"""WITH o AS (SELECT * FROM (SELECT o_custkey AS emp_id, o_orderkey AS file_id, row_number() OVER (
 PARTITION BY o_custkey ORDER BY {parent_order}) AS k FROM orders) WHERE k = 1),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY deposited_file_id ORDER BY created_at {direction}, id {direction}) AS k
 FROM ({_DATASETS})) WHERE k = 1)
SELECT emp_id, file_id, d.id AS dataset_id, coalesce(d.state, 'no_dataset') AS status,
 coalesce(d.state = 'processed', false) AS is_complete FROM o LEFT JOIN d ON d.deposited_file_id = o.file_id"""


def _deposits(spark, sf):
    return run_sql(spark, sf, "SELECT o_custkey AS emp_id, o_orderkey AS id, o_orderdate AS created_at FROM orders")


@query(_state_sql("o_orderkey DESC", "ASC"))
def state_completion(spark, sf):
    return gates.state_completion(_deposits(spark, sf), run_sql(spark, sf, _DATASETS))


@query(_state_sql("o_orderdate DESC, o_orderkey DESC", "DESC"))
def state_completion_latest(spark, sf):
    """The other orders: newest file by time, its latest dataset."""
    return gates.state_completion(
        _deposits(spark, sf), run_sql(spark, sf, _DATASETS), which="latest", deposit_order=["created_at", "id"]
    )


_DEPTHS = """SELECT user_id, event_type AS queue, ts, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 3 END AS visible,
 CAST(event_id % 2 AS BIGINT) AS in_flight, CAST(0 AS BIGINT) AS delayed FROM events"""
_DRAIN = f"""WITH x AS (SELECT user_id, queue, (arg_max(struct_pack(v := visible, f := in_flight, d := delayed), ts)) AS q
 FROM ({_DEPTHS}) GROUP BY ALL), t AS (SELECT user_id, q.v + q.f + q.d AS n FROM x)
SELECT user_id, count(*) AS n_queues, coalesce(sum(n), 0)::BIGINT AS total_messages, count(*) FILTER (WHERE n IS NULL) AS n_unknown,
 count(*) FILTER (WHERE n > 0) AS n_busy, count(*) FILTER (WHERE n > 0 OR n IS NULL) = 0 AS is_complete,
 CASE WHEN count(*) FILTER (WHERE n IS NULL) > 0 THEN 'depth unknown' WHEN count(*) FILTER (WHERE n > 0) > 0 THEN 'messages left' END
 AS reason FROM t GROUP BY user_id"""


@query(_DRAIN)
def queue_drain(spark, sf):
    latest = gates.latest_depths(run_sql(spark, sf, _DEPTHS), ["user_id"])
    return gates.queue_drain(latest, ["user_id"])


@query(
    """SELECT user_id, count(*) AS n_queues, coalesce(sum(m) FILTER (WHERE m >= 0), 0)::BIGINT AS total_messages,
 count(*) FILTER (WHERE m IS NULL OR m < 0) AS n_failed_reads, coalesce(sum(m) FILTER (WHERE m >= 0), 0) > 0 AS has_errors
FROM (SELECT user_id, event_type, arg_max(event_id % 4 - 1, ts) AS m FROM events GROUP BY ALL) GROUP BY user_id"""
)
def dlq_gate(spark, sf):
    latest = run_sql(
        spark, sf,
        "SELECT user_id, event_type AS queue, max_by(event_id % 4 - 1, ts) AS messages FROM events GROUP BY user_id, event_type",
    )
    return gates.dlq_gate(latest, ["user_id"])


_STATUS = "SELECT user_id AS run_id, event_type AS source, ts, value > 100 AND event_id % 3 = 0 AS done FROM events"
_LATCH = f"""WITH s AS ({_STATUS}), l AS (SELECT run_id, min(ts) AS first_ts, max(ts) AS last_ts,
 coalesce(bool_or(done) FILTER (WHERE source = 'view'), false) AS a, coalesce(bool_or(done) FILTER (WHERE source = 'click'), false) AS b,
 coalesce(bool_or(done) FILTER (WHERE source = 'error'), false) AS c FROM s GROUP BY run_id)
SELECT run_id, a AND b AND c AS is_complete, concat_ws(',', CASE WHEN NOT a THEN 'view' END, CASE WHEN NOT b THEN 'click' END,
 CASE WHEN NOT c THEN 'error' END) AS pending"""


@query(_LATCH + " FROM l")
def latch_completion(spark, sf):
    return gates.latch(run_sql(spark, sf, _STATUS), SOURCES).drop("first_ts", "last_ts")


@query(
    _LATCH + """, NOT (a AND b AND c) AND epoch(TIMESTAMP '2024-02-01 00:00:00' - first_ts) > 2600000 AS timed_out FROM l"""
)
def latch_timeout(spark, sf):
    latched = gates.latch(run_sql(spark, sf, _STATUS), SOURCES)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return gates.with_timeout(latched, now, 2600000).drop("first_ts", "last_ts")


@query(
    f"""WITH s AS ({_STATUS}) SELECT run_id, source, bool_or(done) AS latched, CAST(min(ts) AS STRING) AS first_ts,
 CAST(min(ts) FILTER (WHERE done) AS STRING) AS done_at FROM s GROUP BY ALL"""
)
def latch_per_source(spark, sf):
    latched = gates.latch_sources(run_sql(spark, sf, _STATUS))
    return latched.withColumns({c: F.col(c).cast("string") for c in ("first_ts", "done_at")})


_RELEASE = """WITH a AS (SELECT user_id AS run_id, max(ts) >= TIMESTAMP '2024-01-31 00:00:00' AS has_arrived FROM events GROUP BY 1),
c AS (SELECT user_id AS run_id, bool_or(value > 400) AS is_complete FROM events GROUP BY 1),
d AS (SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'error' AND event_id % 50 = 0) > 0 AS has_errors FROM events GROUP BY 1) """


@query(
    _RELEASE + """SELECT run_id, has_arrived AND is_complete AND NOT has_errors AS is_released, CASE WHEN NOT has_arrived THEN 'no file'
 WHEN NOT is_complete THEN 'not complete' WHEN has_errors THEN 'dead letters' END AS blocked_by
FROM a JOIN c USING (run_id) JOIN d USING (run_id)"""
)
def release_plan(spark, sf):
    arrivals = run_sql(
        spark, sf,
        "SELECT user_id AS run_id, max(ts) >= TIMESTAMP_NTZ '2024-01-31 00:00:00' AS has_arrived FROM events GROUP BY user_id",
    )
    complete = run_sql(spark, sf, "SELECT user_id AS run_id, bool_or(value > 400) AS is_complete FROM events GROUP BY user_id")
    letters = run_sql(
        spark, sf,
        """SELECT user_id AS run_id, count_if(event_type = 'error' AND event_id % 50 = 0) > 0 AS has_errors
        FROM events GROUP BY user_id""",
    )
    return gates.release_plan(arrivals, complete, letters)


# --- the same as streams --------------------------------------------------------------------
def _event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _finish(running):
    running.awaitTermination()


@query(_LATCH + " FROM l")
def latch_stream(spark, sf):
    """The latch as a stream gives the same rows as over a table."""
    status = _event_stream(spark, sf).select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("source"),
        "ts",
        F.expr("value > 100 AND event_id % 3 = 0").alias("done"),
    )
    out = scratch_path(spark, "latch")
    _finish(gates.stream_to_table(gates.latch(status, SOURCES), f"{out}/rows", f"{out}/checkpoint"))
    return gates.current_rows(spark, f"{out}/rows", ["run_id"]).drop("first_ts", "last_ts")


@query(_DRAIN)
def queue_drain_stream(spark, sf):
    """Newest depths stream into a table; the drain test reads that table."""
    depths = _event_stream(spark, sf).select(
        "user_id",
        F.col("event_type").alias("queue"),
        "ts",
        F.expr("CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 3 END").alias("visible"),
        F.expr("event_id % 2").alias("in_flight"),
        F.lit(0).cast("bigint").alias("delayed"),
    )
    out = scratch_path(spark, "drain")
    latest = gates.latest_depths(depths, ["user_id"])
    _finish(gates.stream_to_table(latest, f"{out}/rows", f"{out}/checkpoint"))
    return gates.queue_drain(gates.current_rows(spark, f"{out}/rows", ["user_id", "queue"]), ["user_id"])


@query(
    f"WITH z AS ({_LATCH} FROM l) SELECT run_id, count(*) AS n_events FROM z JOIN events ON user_id = run_id"
    " WHERE is_complete AND run_id % 5 <> 0 GROUP BY run_id"
)
def release_stream(spark, sf):
    """Completed runs that the gate lets pass are handed on once; here they are counted."""
    status = _event_stream(spark, sf).select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("source"),
        "ts",
        F.expr("value > 100 AND event_id % 3 = 0").alias("done"),
    )
    out = scratch_path(spark, "release")

    def compare(ready, batch_id):
        events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run_id"))
        counted = events.join(ready, "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"))
        counted.write.mode("overwrite").parquet(gates.batch_folder(f"{out}/compared", batch_id))

    running = gates.release_stream(
        status, SOURCES, compare, out, f"{out}/checkpoint", gate=lambda r: r.where("run_id % 5 <> 0")
    )
    _finish(running)
    return spark.read.schema("run_id bigint, n_events bigint").parquet(f"{out}/compared").drop("batch_id")


# --- gates with timers ------------------------------------------------------------------------
# Events arrive in three batches by ten days each; one in eleven comes a batch late and one in thirteen two. A batch
# lets in what the watermark of the batch before allows: in the third, nothing up to three days before the end of the first.
# A last batch moves the time on.
_ARRIVE = """SELECT *, least(2, (day(ts) - 1) DIV 10 + CASE WHEN event_id % 13 = 0 THEN 2 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END)
 AS batch FROM events"""
_ACCEPTED = """a AS (SELECT *, least(2, (day(ts) - 1) // 10 + CASE WHEN event_id % 13 = 0 THEN 2 WHEN event_id % 11 = 0 THEN 1 ELSE 0 END)
 AS batch FROM events),
w AS (SELECT 2 AS batch, max(ts) - INTERVAL 3 DAY AS low FROM a WHERE batch = 0),
e AS (SELECT a.* FROM a LEFT JOIN w USING (batch) WHERE low IS NULL OR ts > low),
f AS (SELECT user_id, min(ts) AS first_ts FROM e WHERE event_type IN ('view', 'click', 'error') GROUP BY user_id),
d AS (SELECT user_id, event_type, min(ts) AS done_at FROM e WHERE event_type IN ('view', 'click', 'error') AND event_id % 3 = 0 GROUP BY ALL),
o AS (SELECT f.user_id AS run_id, first_ts, first_ts + INTERVAL 5 DAY AS deadline,
 max(done_at) FILTER (event_type = 'view') AS v, max(done_at) FILTER (event_type = 'click') AS c, max(done_at) FILTER (event_type = 'error') AS x
 FROM f LEFT JOIN d ON d.user_id = f.user_id AND done_at <= first_ts + INTERVAL 5 DAY GROUP BY ALL),
t AS (SELECT *, v IS NOT NULL AND c IS NOT NULL AND x IS NOT NULL AS is_complete, CASE WHEN v IS NOT NULL AND c IS NOT NULL AND x IS NOT NULL
 THEN greatest(v, c, x) ELSE deadline END AS decided_at FROM o)"""
_PENDING = "concat_ws(',', CASE WHEN v IS NULL THEN 'view' END, CASE WHEN c IS NULL THEN 'click' END, CASE WHEN x IS NULL THEN 'error' END) AS pending"


def _in_batches(spark, sf, out):
    """The events as a stream that reads one batch at a time."""
    events = run_sql(spark, sf, _ARRIVE)
    for batch in range(3):
        events.where(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(out)
    last = events.drop("batch").limit(1).withColumns(
        {"user_id": F.lit(-1).cast("bigint"), "event_type": F.lit("view"), "ts": F.lit("2024-06-01").cast(events.schema["ts"].dataType)}
    )
    last.coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema(spark.read.parquet(out).schema).option("maxFilesPerTrigger", 1).parquet(out)


def _status_of(events):
    kinds = events.where(F.col("event_type").isin(*SOURCES))
    return kinds.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("source"), "ts", (F.col("event_id") % 3 == 0).alias("done"))


def _outcome_rows(spark, outcomes, out):
    latches.append_to(outcomes, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    rows = spark.read.schema(outcomes.schema).parquet(f"{out}/rows")
    return rows.select("run_id", "outcome", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("decided_at").alias("decided_us"), "pending")


_LONG = {"max_wait": timedelta(days=5), "lateness": timedelta(days=3), "keep": timedelta(days=365)}


@query(
    f"""WITH {_ACCEPTED} SELECT run_id, CASE WHEN is_complete THEN 'complete' ELSE 'timed out' END AS outcome, epoch_us(first_ts) AS first_us,
 epoch_us(decided_at) AS decided_us, {_PENDING} FROM t"""
)
def latch_timers(spark, sf):
    """Runs as they complete or time out, from a stream in four batches with rows that come late or too late."""
    out = scratch_path(spark, "timers")
    return _outcome_rows(spark, latches.latch_outcomes(_status_of(_in_batches(spark, sf, f"{out}/in")), SOURCES, **_LONG), out)


@query(
    f"""WITH {_ACCEPTED},
arr AS (SELECT user_id AS run_id, min(ts) AS arrived FROM e WHERE event_type = 'purchase' AND event_id % 2 = 0 GROUP BY 1),
dlq AS (SELECT run_id, queue, arg_max(messages, ts) AS messages FROM (SELECT user_id AS run_id, event_type || event_id % 2 AS queue, ts,
 CASE WHEN event_id % 7 = 0 THEN event_id % 4 WHEN event_id % 7 = 1 THEN NULL ELSE -1 END AS messages FROM e WHERE event_type IN ('purchase', 'click'))
 JOIN t USING (run_id) WHERE ts <= decided_at GROUP BY ALL),
bad AS (SELECT run_id, max(messages) > 0 AS has_letters FROM (SELECT run_id, greatest(coalesce(messages, 0), 0) AS messages FROM dlq) GROUP BY 1)
SELECT run_id, CASE WHEN NOT is_complete THEN 'timed out' WHEN arrived IS NULL OR arrived > decided_at THEN 'no file'
 WHEN has_letters THEN 'dead letters' ELSE 'released' END AS outcome, epoch_us(first_ts) AS first_us, epoch_us(decided_at) AS decided_us, {_PENDING}
FROM t LEFT JOIN arr USING (run_id) LEFT JOIN bad USING (run_id)"""
)
def release_timers(spark, sf):
    """Arrivals, status rows and dead letters as three streams: which runs are released, and why others are not."""
    out = scratch_path(spark, "releases")
    events = _in_batches(spark, sf, f"{out}/in")
    arrivals = events.where("event_type = 'purchase' AND event_id % 2 = 0").select(F.col("user_id").alias("run_id"), "ts")
    letters = events.where("event_type IN ('purchase', 'click')").select(
        F.col("user_id").alias("run_id"),
        F.expr("concat(event_type, event_id % 2)").alias("queue"),
        "ts",
        F.expr("CASE WHEN event_id % 7 = 0 THEN event_id % 4 WHEN event_id % 7 = 1 THEN NULL ELSE -1 END").alias("messages"),
    )
    outcomes = latches.release_outcomes(arrivals, _status_of(events), letters, SOURCES, **_LONG)
    return _outcome_rows(spark, outcomes, out)
