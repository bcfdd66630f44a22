"""Streams that arrive in several time-ordered batches."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from faktorium.streaming import jobs


def arriving(spark, tmp_path, batches, schema):
    """A stream that reads one file per batch, in the order of the list."""
    folder = tmp_path / "inbox"
    for i, rows in enumerate(batches):
        part = tmp_path / f"part-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        (source,) = part.glob("*.parquet")
        folder.mkdir(exist_ok=True)
        target = folder / f"{i}.parquet"
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def minute(n):
    return f"2025-03-01 {n // 60:02d}:{n % 60:02d}:00"


def test_dedupe_over_batches(spark, tmp_path):
    batches = [
        [("a", minute(0)), ("b", minute(1)), ("a", minute(2))], [("a", minute(5)), ("c", minute(6))], [("d", minute(30)), ("d", minute(31))],
        [("e", minute(50))], [("a", minute(60)), ("b", minute(61))],
    ]
    stream = arriving(spark, tmp_path, batches, "k string, at string").select("k", F.to_timestamp("at").alias("timestamp"))
    found = jobs.run_available(jobs.stream_dedupe(stream, ["k"]), "dedupe").collect()
    # Repeats within ten minutes are dropped; an hour later a key counts as new.
    assert sorted(r["k"] for r in found) == ["a", "a", "b", "b", "c", "d", "e"]


def test_traces_over_batches(spark, tmp_path):
    batches = [[("x", minute(0), "INFO")], [("x", minute(4), "ERROR"), ("y", minute(3), "INFO")], [("z", minute(50), "INFO")], [("z", minute(90), "INFO")]]
    stream = arriving(spark, tmp_path, batches, "correlation_id string, at string, level string")
    log = stream.withColumn("timestamp", F.to_timestamp("at"))
    found = jobs.run_available(jobs.stream_traces(log), "traces").collect()
    assert sorted((r["correlation_id"], r["records"], r["has_error"]) for r in found) == [("x", 2, True), ("y", 1, False), ("z", 1, False)]


def test_errors_and_open_traces_over_batches(spark, tmp_path):
    batches = [[("x", minute(0), "ERROR")], [("x", minute(4), "ERROR"), ("y", minute(3), "INFO")], [("x", minute(9), "INFO")], [("x", minute(13), "INFO")]]
    stream = arriving(spark, tmp_path, batches, "correlation_id string, at string, level string")
    log = stream.withColumn("timestamp", F.to_timestamp("at"))
    found = jobs.run_upserts(jobs.stream_error_rate(log), "errors", ["window_start", "window_end"]).collect()
    assert [r["errors"] for r in found] == [2]
    parts = jobs.run_upserts(jobs.stream_trace_parts(log), "parts", ["window_start", "correlation_id"])
    found = jobs.join_traces(parts).collect()
    # Five minutes between two records end a trace; the last ones are still open.
    assert sorted((r["correlation_id"], r["started"].minute, r["records"], r["has_error"]) for r in found) == [
        ("x", 0, 2, True), ("x", 9, 2, False), ("y", 3, 1, False),
    ]


def test_stages_of_a_session():
    def outcome(**events):
        found = jobs.walk_stages({k: set(v) for k, v in events.items()}, jobs.SESSION_CHAINS)
        return found and (found[0], found[1], found[2], found[4], found[5], found[6])

    assert outcome(accepted=[5]) is None
    assert outcome(opened=[9, 7]) == ("opened", 7, "opened", "accepted", 67, "waiting")
    assert outcome(opened=[7], accepted=[6, 67, 30]) == ("opened", 7, "accepted", "receipt", 90, "waiting")
    assert outcome(opened=[7], accepted=[68]) == ("opened", 7, "opened", "accepted", 67, "waiting")
    assert outcome(opened=[7], accepted=[30], receipt=[20, 90]) == ("opened", 7, "receipt", None, 90, "done")
    assert outcome(batch_opened=[3], opened=[4], processed=[33]) == ("batch_opened", 3, "processed", None, 33, "done")


def seconds(n):
    return f"2025-03-01 {n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}"


def test_session_tracker_over_batches_leaves_no_state(spark, tmp_path):
    batches = [
        [(1, "opened", 0), (2, "accepted", 10), (3, "accepted", 20), (4, "accepted", 0), (6, "batch_opened", 0), (7, "processed", 31)],
        [(1, "accepted", 30), (2, "opened", 30), (3, "opened", 0), (3, "receipt", 81), (7, "batch_opened", 1), (8, "opened", 0), (8, "accepted", 60)],
        [(1, "receipt", 90), (1, "accepted", 20), (1, "something", 3), (8, "opened", 0)],
        [(9, "opened", 6000)], [(5, "opened", 12000), (5, "accepted", 12060), (5, "receipt", 12120)], [(10, "opened", 14000), (11, "opened", 20000)],
    ]
    rows = [[(i, kind, seconds(n)) for i, kind, n in batch] for batch in batches]
    stream = arriving(spark, tmp_path, rows, "session_id long, kind string, at string")
    status = stream.select("session_id", "kind", F.to_timestamp("at").alias("timestamp"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    tracked = jobs.run_upserts(jobs.stream_session_tracker(status), "tracked", ["session_id"], ["final"], out, checkpoint).collect()
    assert sorted((r["session_id"], r["reached"], r["waiting_for"], r["outcome"], r["final"]) for r in tracked) == [
        (1, "accepted", "receipt", "timed out", True), (2, "opened", "accepted", "timed out", True), (3, "accepted", "receipt", "timed out", True),
        (5, "receipt", None, "done", True), (6, "batch_opened", "processed", "timed out", True), (7, "processed", None, "done", True),
        (8, "accepted", "receipt", "timed out", True), (9, "opened", "accepted", "timed out", True), (10, "opened", "accepted", "timed out", True),
        (11, "opened", "accepted", "waiting", False),
    ]
    state = spark.read.format("statestore").option("stateVarName", "events").load(checkpoint)
    assert {r["key"]["session_id"] for r in state.select("key").collect()} == {11}


class CountingHandle:
    """A state of one session in memory, with the number of calls that would go to the state store."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.held

    def update(self, value):
        self.calls, self.held = self.calls + 1, value

    def registerTimer(self, due):
        self.calls += 1
        self.timers.add(due)

    def deleteTimer(self, due):
        self.calls += 1
        self.timers.remove(due)


def test_tracker_calls_the_state_store_little():
    handle = CountingHandle()
    tracker = jobs.SessionTracker(jobs.SESSION_CHAINS)
    tracker.init(handle)
    rows = [{"kind": "opened", "second": 0}] + [{"kind": "accepted", "second": n} for n in range(1, 50)]
    (first,) = tracker.handleInputRows((1,), iter(rows), None)
    assert first["reached"] == "accepted" and handle.calls == 3 and handle.timers == {62_000}
    (second,) = tracker.handleInputRows((1,), iter([{"kind": "receipt", "second": 40}]), None)
    assert second["outcome"] == "done" and handle.calls == 7 and handle.timers == {41_000}


def test_events_of_a_session_reach_the_tracker_in_one_row():
    kinds, micros = ["accepted", "opened"], 1_000_000
    rows = [(i % 3, kinds[i % 2], (50 - i) * micros + i) for i in range(40)] + [(2, "opened", 50 * micros + 7), (2, "opened", 50 * micros + 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], ["session_id", "kind", "time"]) for part in (rows[:7], rows[7:])]
    found = [r for batch in jobs.pack_events(kinds)(iter(batches)) for r in batch.to_pylist()]
    expected = {(s, k, t) for s, k, t in rows if t != 50 * micros + 7}
    assert len(found) == 3 and {(r["session_id"], k, t) for r in found for k, t in zip(r["kinds"], r["times"])} == expected
    assert all(r["newest"] == max(r["times"]) for r in found)
    assert sum(b.num_rows for b in jobs.pack_events(kinds, limit=5)(iter(batches))) == 6 and not list(jobs.pack_events(kinds)(iter([])))


class At:
    def __init__(self, watermark_ms):
        self.getCurrentWatermarkInMs = lambda: watermark_ms


def test_late_events_of_a_row_are_dropped_one_by_one():
    tracker = jobs.PackedSessionTracker(jobs.SESSION_CHAINS)
    tracker.init(CountingHandle())
    row = {"session_id": 1, "kinds": ["opened", "opened", "accepted"], "times": [5_000_000, 9_000_001, 20_000_000]}
    assert list(tracker.handleInputRows((1,), iter([row]), At(20_000))) == []
    (found,) = tracker.handleInputRows((1,), iter([row]), At(9_000))
    assert (found["opened_s"], found["reached_s"]) == (9, 20)


def test_tracker_drops_late_events_and_events_without_a_time(spark, tmp_path):
    batches = [[(1, "opened", 0), (1, "accepted", 10), (4, "opened", None)], [(2, "opened", 6000)], [(3, "opened", 100), (3, "opened", 6010)]]
    rows = [[(i, kind, None if n is None else seconds(n)) for i, kind, n in batch] for batch in batches]
    status = arriving(spark, tmp_path, rows, "session_id long, kind string, at string").select("session_id", "kind", F.to_timestamp("at").alias("timestamp"))
    found = jobs.run_upserts(jobs.stream_session_tracker(status), "late", ["session_id"], ["final"]).collect()
    opened = {r["session_id"]: r["opened_s"] % 86400 for r in found}
    assert opened == {1: 0, 2: 6000, 3: 6010}
