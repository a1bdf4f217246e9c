"""Completion gates, batch and streaming."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.streaming import gates

STATUS = "run_id string, source string, ts timestamp, done boolean"


def at(hour):
    return dt(2024, 1, 1, hour)


def test_latch_stays(spark):
    rows = [("r", "a", at(1), True), ("r", "a", at(2), False), ("r", "b", at(3), True), ("q", "a", at(1), True)]
    got = {r.run_id: (r.is_complete, r.pending) for r in gates.latch(spark.createDataFrame(rows, STATUS), ["a", "b"]).collect()}
    assert got == {"r": (True, ""), "q": (False, "b")}
    with pytest.raises(ValueError):
        gates.latch(spark.createDataFrame(rows, STATUS), [])


def test_timeout_is_judged_on_reading(spark):
    latched = gates.latch(spark.createDataFrame([("r", "a", at(1), False)], STATUS), ["a"])
    for hour, late in ((2, False), (3, False), (4, True)):
        assert gates.with_timeout(latched, F.lit(at(hour)), 7200).first().timed_out is late


def test_arrival(spark):
    deposits = spark.createDataFrame(
        [("1", 10, "new", at(1)), ("1", 11, "new", dt(2024, 1, 2)), ("2", 12, "new", at(1))],
        "emp_id string, id int, state string, created_at timestamp",
    )
    employers = spark.createDataFrame([("1",), ("2",), ("3",)], "emp_id string")
    found = gates.arrival_gate(deposits, F.to_date(F.lit("2024-01-02")), employers).collect()
    assert {r.emp_id: (r.has_arrived, r.reason) for r in found} == {
        "1": (True, None), "2": (False, gates.NOT_TODAY), "3": (False, gates.NO_FILE),
    }


def test_states(spark):
    deposits = spark.createDataFrame(
        [("1", 10, at(2)), ("1", 11, at(1)), ("2", 12, at(1))], "emp_id string, id int, created_at timestamp"
    )
    data = spark.createDataFrame(
        [(1, 11, "processed", at(1)), (2, 11, "cleaning", at(2)), (3, 10, "cleaning", at(1))],
        "id int, deposited_file_id int, state string, created_at timestamp",
    )
    got = {r.emp_id: (r.status, r.is_complete) for r in gates.state_completion(deposits, data).collect()}
    assert got == {"1": ("processed", True), "2": ("no_dataset", False)}
    by_time = gates.state_completion(deposits, data, deposit_order=["created_at"]).collect()
    assert {r.emp_id: r.status for r in by_time}["1"] == "cleaning"


def test_queues(spark):
    cols = "queue string, ts timestamp, visible int, in_flight int, delayed int"
    check = lambda rows: gates.queue_drain(gates.latest_depths(spark.createDataFrame(rows, cols))).first()
    assert check([("a", at(1), 5, 0, 0), ("a", at(2), 0, 0, 0), ("b", at(1), 0, 0, 0)]).is_complete
    busy = check([("a", at(1), 0, 1, 2)])
    assert (busy.is_complete, busy.total_messages, busy.reason) == (False, 3, "messages left")
    # A queue that cannot be read is not an empty one.
    assert check([("a", at(1), None, None, None), ("b", at(1), 0, 0, 0)]).reason == "depth unknown"
    assert check([]).reason == "no queue known"


def test_dead_letters(spark):
    check = lambda rows: gates.dlq_gate(spark.createDataFrame(rows, "queue string, messages int")).first()
    assert not check([("a", 0), ("b", -1)]).has_errors
    full = check([("a", 3), ("b", None)])
    assert (full.has_errors, full.total_messages, full.n_failed_reads) == (True, 3, 1)
    assert not check([]).has_errors


def _add(spark, folder, n, rows):
    spark.createDataFrame(rows, STATUS).coalesce(1).write.parquet(f"{folder}/batch{n}")


def test_release_stream(spark, tmp_path):
    """Several batches: a run is released once, a held-back run is tried again."""
    status, out = str(tmp_path / "status"), str(tmp_path / "out")
    released, open_gate = [], set()

    def drain():
        stream = spark.readStream.schema(STATUS).option("recursiveFileLookup", True).parquet(status)
        running = gates.release_stream(
            stream, ["a", "b"], lambda runs, n: released.extend(r.run_id for r in runs.collect()), out, f"{out}/ck",
            gate=lambda r: r.where(F.col("run_id").isin(*open_gate) | (F.col("run_id") != "held")),
        )
        running.awaitTermination()

    _add(spark, status, 1, [("r", "a", at(1), True), ("held", "a", at(1), True), ("held", "b", at(1), True)])
    drain()
    assert released == []
    _add(spark, status, 2, [("r", "b", at(2), True)])
    drain()
    assert released == ["r"]
    open_gate.add("held")
    _add(spark, status, 3, [("r", "a", at(3), False), ("q", "a", at(3), True)])
    drain()
    assert released == ["r", "held"]
    _add(spark, status, 4, [("r", "b", at(4), True), ("q", "b", at(1), True)])
    drain()
    assert released == ["r", "held", "q"]


def test_streamed_latch_equals_batch(spark, tmp_path):
    status, out = str(tmp_path / "status"), str(tmp_path / "out")
    parts = [
        [("r", "a", at(1), True), ("q", "b", at(1), False)],
        [("r", "a", at(2), False), ("r", "b", at(2), True)],
        [("q", "b", at(0), True)],
    ]
    for n, rows in enumerate(parts):
        _add(spark, status, n, rows)
        stream = spark.readStream.schema(STATUS).option("recursiveFileLookup", True).parquet(status)
        gates.stream_to_table(gates.latch(stream, ["a", "b"]), f"{out}/t", f"{out}/ck").awaitTermination()
    got = {tuple(r) for r in gates.current_rows(spark, f"{out}/t", ["run_id"]).collect()}
    batch = gates.latch(spark.createDataFrame([r for p in parts for r in p], STATUS), ["a", "b"])
    assert got == {tuple(r) for r in batch.collect()}
