"""Gates with timers: batches, late rows, restarts and expiry."""

from datetime import datetime, timedelta

import pytest

from tallyframe.streaming import latches

STATUS = "run_id string, source string, ts timestamp, done boolean"
LETTERS = "run_id string, queue string, ts timestamp, messages bigint"


def at(hour, minute=0):
    return datetime(2024, 1, 1 + hour // 24, hour % 24, minute)


class Feed:
    """A folder per stream to which batches are added, one file each."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def add(self, name, schema, rows):
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def stream(self, name, schema, one_by_one=True):
        reader = self.spark.readStream.schema(schema)
        return (reader.option("maxFilesPerTrigger", 1) if one_by_one else reader).parquet(f"{self.path}/{name}")

    def run(self, outcomes):
        query = latches.append_to(outcomes, f"{self.path}/out", f"{self.path}/checkpoint")
        query.awaitTermination()
        rows = self.spark.read.schema(outcomes.schema).parquet(f"{self.path}/out").collect()
        assert len(rows) == len({r["run_id"] for r in rows})
        return query, {r["run_id"]: (r["outcome"], r["decided_at"], r["pending"]) for r in rows}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_batches_late_rows_and_a_restart(feed):
    add = lambda *rows: feed.add("status", STATUS, rows)
    outcomes = lambda: latches.latch_outcomes(feed.stream("status", STATUS), ["a", "b"])
    add(("one", "a", at(1), True), ("late", "a", at(1), True), ("none", "a", at(1), False), (None, "a", at(1), True), ("one", "a", None, True))
    add(("one", "b", at(2), True), ("one", "a", at(1, 30), False), ("late", "b", at(3, 30), True), ("late", "x", at(1, 59), True))
    add(("one", "b", at(3, 25), True), ("late", "b", at(0, 55), True), ("none", "a", at(0, 1), True), ("tick", "a", at(5), True))
    _, found = feed.run(outcomes())
    assert found == {
        "one": ("complete", at(2), ""),
        "none": ("timed out", at(3), "a,b"),
        "late": ("complete", at(1), ""),  # the third batch lets in what is after 0:50, here an earlier first row
    }
    # The stream goes on from its checkpoint: what was decided stays, what was open is decided now.
    add(("one", "a", at(6), False), ("tick", "b", at(6), True))
    add(("end", "a", at(30), False))
    _, found = feed.run(outcomes())
    assert found["one"] == ("complete", at(2), "") and found["tick"] == ("complete", at(6), "") and "end" not in found


def test_state_expires(feed):
    rows = [[(f"r{k}", "a", at(2 * k), True)] for k in range(12)]
    for batch in rows:
        feed.add("status", STATUS, batch)
    outcomes = latches.latch_outcomes(feed.stream("status", STATUS), ["a"], keep=timedelta(hours=4))
    query, found = feed.run(outcomes)
    assert set(found) == {f"r{k}" for k in range(11)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 12  # a few runs with a few rows of state each, not twelve


def test_release_of_three_streams(feed):
    names = ["free", "nofile", "letters", "cleared", "wait", "afterwards", "unread"]
    feed.add("status", STATUS, [(n, s, at(1, m), n != "wait" or s == "a") for n in names for s, m in (("a", 0), ("b", 30))])
    feed.add("arrivals", "run_id string, ts timestamp", [(n, at(0, 50)) for n in names if n != "nofile"] + [("nofile", at(1, 31))])
    feed.add(
        "letters",
        LETTERS,
        [
            ("letters", "q", at(1, 10), 0), ("letters", "q", at(1, 20), 3), ("letters", "p", at(1, 25), 0),
            ("cleared", "q", at(1, 10), 3), ("cleared", "q", at(1, 20), 0),
            ("afterwards", "q", at(1, 31), 5), ("unread", "q", at(1, 10), -1), ("unread", "p", at(1, 10), None),
        ],
    )
    feed.add("status", STATUS, [("end", "a", at(9), False)])
    outcomes = latches.release_outcomes(
        feed.stream("arrivals", "run_id string, ts timestamp"), feed.stream("status", STATUS), feed.stream("letters", LETTERS), ["a", "b"]
    )
    _, found = feed.run(outcomes)
    assert {n: o for n, (o, _, _) in found.items()} == {
        "free": "released", "nofile": "no file", "letters": "dead letters", "cleared": "released", "wait": "timed out",
        "afterwards": "released", "unread": "released",
    }
    assert found["wait"] == ("timed out", at(3), "b") and found["free"][1] == at(1, 30)


def test_sources_are_needed(spark, feed):
    feed.add("status", STATUS, [("r", "a", at(1), True)])
    with pytest.raises(ValueError):
        latches.latch_outcomes(feed.stream("status", STATUS), [])
