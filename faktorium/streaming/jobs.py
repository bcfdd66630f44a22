"""Structured Streaming jobs over the processing log and arriving documents.

Late records are dropped after the watermark.  Appended results come once a
window, session or timer is closed; upserted ones are there at once and are
replaced until then, so what is open at the end of the input isn't missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence, Set

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from faktorium.operators.validation import validate_fa
from faktorium.session import work_path
from faktorium.sources.invoices import parse_fa_xml

WATERMARK = "10 minutes"
# Waiting times in seconds.
PROCESSING_TIMEOUT, RECEIPT_TIMEOUT, BATCH_TIMEOUT = 60, 60, 30
# Events that a task holds to put those of a session into one row.
PACK_EVENTS = 1 << 20
# What opens a session, and the stages that must follow, each in its time after the one before.
Chains = dict[str, tuple[tuple[str, int], ...]]
SESSION_CHAINS: Chains = {
    "opened": (("accepted", PROCESSING_TIMEOUT), ("receipt", RECEIPT_TIMEOUT)),
    "batch_opened": (("processed", BATCH_TIMEOUT),),
}


def stream_error_rate(log: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Errors per hour."""
    errors = log.where(F.col("level") == "ERROR").withWatermark("timestamp", watermark)
    counted = errors.groupBy(F.window("timestamp", "1 hour")).agg(F.count("*").alias("errors"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "errors")


def stream_dedupe(submissions: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """Every key once within the watermark.

    Of rows that arrive at most one watermark behind the newest one, no key is
    lost and a repeat within the watermark is dropped, however the input is cut
    into batches.  Rows that arrive later are late and are dropped; a repeat
    that comes after the watermark counts as new once its key has left the state.
    """
    return submissions.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(keys)


def stream_traces(log: DataFrame, gap: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Records of one correlation id until it is quiet.

    With the settings of ``faktorium.session`` sessions are merged inside a
    partition before the shuffle, so a busy id sends few rows.
    """
    sessions = log.withWatermark("timestamp", watermark).groupBy(F.session_window("timestamp", gap), "correlation_id")
    counted = sessions.agg(F.count("*").alias("records"), F.bool_or(F.col("level") == "ERROR").alias("has_error"))
    return counted.select(
        F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "correlation_id", "records", "has_error"
    )


def stream_trace_parts(log: DataFrame, gap: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Records of one correlation id in fixed windows as long as the gap, for ``run_upserts``.

    Records of such a window are never a gap apart, so a window belongs to one
    trace as a whole; ``join_traces`` puts windows together.  Unlike session
    windows these can be read while a trace is open.
    """
    windows = log.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", gap), "correlation_id")
    counted = windows.agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("*").alias("records"),
        F.bool_or(F.col("level") == "ERROR").alias("has_error"),
    )
    return counted.select(F.col("window.start").alias("window_start"), "correlation_id", "first", "last", "records", "has_error")


def join_traces(parts: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Traces, open ones too: windows of an id whose records follow each other within the gap."""
    order = Window.partitionBy("correlation_id").orderBy("window_start")
    fresh = F.coalesce(F.col("first") >= F.lag("last").over(order) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    numbered = parts.withColumn("_fresh", fresh.cast("long")).withColumn("_trace", F.sum("_fresh").over(order))
    joined = numbered.groupBy("correlation_id", "_trace").agg(
        F.min("first").alias("started"), (F.max("last") + F.expr(f"INTERVAL {gap}")).alias("ended"), F.sum("records").alias("records"),
        F.bool_or("has_error").alias("has_error"),
    )
    return joined.select("started", "ended", "correlation_id", "records", "has_error")


def stream_validate(documents: DataFrame, variant: int, valid_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: arriving XML (column ``xml``) to valid or quarantined documents.

    Folders carry the batch number and are overwritten, so a repeated batch
    leaves no copies.
    """
    keys = [c for c in documents.columns if c != "xml"]

    def handle(batch: DataFrame, number: int) -> None:
        parsed = parse_fa_xml(batch, variant)
        checked = validate_fa(parsed.select(*keys, "xml", "is_wellformed", "document.*"), variant)
        errors = F.filter("violations", lambda v: v["severity"] == "error")
        result = checked.select(*keys, "xml", "violations", (F.col("is_wellformed") & (F.size(errors) == 0)).alias("_valid"))
        held = result.persist()
        try:
            held.where("_valid").select(*keys, "xml").write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
            held.where("NOT _valid").select(*keys, "xml", "violations").write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
        finally:
            held.unpersist()

    return handle


# --- Session tracker -------------------------------------------------------------------------------------
TRACKER_OUTPUT = (
    "session_id long, opening string, opened_s long, reached string, reached_s long, waiting_for string, deadline_s long, "
    "outcome string, final boolean"
)
TRACKED = Row(*[c.split()[0] for c in TRACKER_OUTPUT.split(", ")])


def walk_stages(events: Mapping[str, Set[int]], chains: Chains) -> tuple | None:
    """How far a session is, from the seconds of its events: the columns from ``opening`` to ``outcome``.

    The first opening counts, and of each stage the first event in its time.  A
    session is done or waits for a stage until its deadline; None if not opened.
    """
    openings = [(min(events[kind]), kind) for kind in chains if events.get(kind)]
    if not openings:
        return None
    opened_s, opening = min(openings)
    reached, reached_s = opening, opened_s
    for stage, timeout in chains[opening]:
        inside = [second for second in events.get(stage, ()) if reached_s <= second <= reached_s + timeout]
        if not inside:
            return opening, opened_s, reached, reached_s, stage, reached_s + timeout, "waiting"
        reached, reached_s = stage, min(inside)
    return opening, opened_s, reached, reached_s, None, reached_s, "done"


class SessionTracker(StatefulProcessor):
    """Sessions go through the stages of their chain; every stage has a timer of its own.

    The state holds the seconds of the events that may still matter.  Each batch
    walks them anew, so the result doesn't depend on the order of arrival, and
    sets the timer of the stage that the session has come to.  When it fires, all
    events up to the deadline have arrived: the session timed out in that stage or
    is done, its last row is final and its state is cleared.  Events of sessions
    that aren't open (yet) wait as long as they could still be meant and are then
    forgotten.  Session ids are not used again.
    """

    def __init__(self, chains: Chains):
        self.chains = chains
        self.span = max(sum(timeout for _, timeout in chain) for chain in chains.values())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Each kind of event once a second, and the time of the timer: one read and one write of the state per session and batch.
        self.seen = handle.getValueState("events", "kinds array<string>, seconds array<long>, timer long")

    def _state(self) -> tuple[dict[str, set[int]], int | None]:
        held = self.seen.get()
        events: dict[str, set[int]] = {}
        if held is None:
            return events, None
        for kind, second in zip(held[0], held[1]):
            events.setdefault(kind, set()).add(second)
        return events, held[2]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events, timer = self._state()
        for row in rows:
            events.setdefault(row["kind"], set()).add(row["second"])
        found = walk_stages(events, self.chains)
        if found is None:
            last = max(map(max, events.values())) + self.span
        else:
            opened_s, last = found[1], found[5]
            events = {kind: {s for s in seconds if opened_s <= s <= opened_s + self.span} for kind, seconds in events.items()}
        # One timer, for when all events of its second have arrived.
        due = (last + 1) * 1000
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if timer != due:
            self.handle.registerTimer(due)
        pairs = [(kind, second) for kind, seconds in events.items() for second in sorted(seconds)]
        self.seen.update(([kind for kind, _ in pairs], [second for _, second in pairs], due))
        if found is not None:
            yield TRACKED(key[0], *found, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        found = walk_stages(self._state()[0], self.chains)
        self.seen.clear()
        if found is not None:
            outcome = "timed out" if found[-1] == "waiting" else found[-1]
            yield TRACKED(key[0], *found[:-1], outcome, True)

    def close(self) -> None:
        pass


class PackedSessionTracker(SessionTracker):
    """The same on rows of ``pack_events``; events behind the watermark are dropped one by one, as a row of them counts by its newest."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        events = [{"kind": k, "second": t // 1_000_000} for row in rows for k, t in zip(row["kinds"], row["times"]) if t > watermark]
        return super().handleInputRows(key, iter(events), timerValues) if events else iter([])


def pack_events(kinds: Sequence[str], limit: int = PACK_EVENTS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function over ``session_id, kind, time`` (microseconds): the events of a session in one row.

    A row that reaches the tracker costs far more than an event inside it.  A task
    holds ``limit`` events; of one kind and second, which count once, the newest stays.
    """
    names = pa.array(kinds, pa.string())

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        session, kind, time = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((time, kind, session))
        session, kind, time = session[order], kind[order], time[order]
        second = time // 1_000_000
        last = np.ones(len(order), bool)
        last[:-1] = (session[1:] != session[:-1]) | (kind[1:] != kind[:-1]) | (second[1:] != second[:-1])
        session, kind, time = session[last], kind[last], time[last]
        starts = np.flatnonzero(np.append(True, session[1:] != session[:-1]))
        bounds = pa.array(np.append(starts, len(session)), pa.int32())
        columns = [
            pa.array(session[starts]), pa.ListArray.from_arrays(bounds, names.take(pa.array(kind))),
            pa.ListArray.from_arrays(bounds, pa.array(time)), pa.array(np.maximum.reduceat(time, starts)),
        ]
        yield from pa.Table.from_arrays(columns, ["session_id", "kinds", "times", "newest"]).to_batches(max_chunksize=10_000)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                kind = pc.index_in(batch.column("kind"), value_set=names).to_numpy()
                held.append((batch.column("session_id").to_numpy(), kind, batch.column("time").to_numpy()))
                rows += batch.num_rows
            if rows >= limit:
                yield from packed(held)
                held, rows = [], 0
        if held:
            yield from packed(held)

    return pack


def stream_session_tracker(status: DataFrame, chains: Chains = SESSION_CHAINS, watermark: str = WATERMARK) -> DataFrame:
    """The stages of every session, for ``run_upserts`` with the key ``session_id`` and the order ``final``.

    ``status`` has ``session_id long, kind, timestamp``; kinds that no chain
    names are ignored.  Needs the state store that ``faktorium.session`` configures.
    """
    kinds = sorted({*chains, *(stage for chain in chains.values() for stage, _ in chain)})
    known = F.col("kind").isin(*kinds) & F.col("session_id").isNotNull() & F.col("timestamp").isNotNull()
    events = status.where(known).select("session_id", "kind", F.unix_micros("timestamp").alias("time"))
    packed = events.mapInArrow(pack_events(kinds), "session_id long, kinds array<string>, times array<long>, newest long")
    timed = packed.select("session_id", "kinds", "times", F.timestamp_micros("newest").alias("timestamp"))
    return timed.withWatermark("timestamp", watermark).groupBy("session_id").transformWithState(
        statefulProcessor=PackedSessionTracker(chains), outputStructType=TRACKER_OUTPUT, outputMode="update", timeMode="EventTime"
    )


def sessions_as_of(tracked: DataFrame, second: Column) -> DataFrame:
    """The newest rows as they stand at a second: who waits beyond the deadline timed out, whether or not the timer fired."""
    late = (F.col("outcome") == "waiting") & (F.col("deadline_s") < second)
    return tracked.withColumn("outcome", F.when(late, "timed out").otherwise(F.col("outcome"))).drop("final")


# --- Running ---------------------------------------------------------------------------------------------
def run_available(
    stream: DataFrame, label: str, mode: str = "append", path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Process what is there into a file sink and read the result back.

    A later run with the same ``path`` and ``checkpoint`` goes on where this one ended.
    """
    spark: SparkSession = stream.sparkSession
    path, checkpoint = path or work_path(spark, label), checkpoint or work_path(spark, f"{label}-checkpoint")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def upsert_to(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: the changed rows of a batch in a folder of its number, which a repeated batch overwrites."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return save


def newest_rows(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Of every key the row of the last batch that changed it; ``order`` decides inside a batch."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    rest = [c for c in schema.names if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", *order)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*schema.names)


def run_upserts(
    stream: DataFrame, label: str, keys: Sequence[str], order: Sequence[str] = (), path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Process what is there in update mode; the newest row of every key, whether it is closed or open.

    A later run with the same ``path`` and ``checkpoint`` goes on where this one ended.
    """
    spark: SparkSession = stream.sparkSession
    path, checkpoint = path or work_path(spark, label), checkpoint or work_path(spark, f"{label}-checkpoint")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    writer = stream.writeStream.foreachBatch(upsert_to(path)).option("checkpointLocation", checkpoint).outputMode("update")
    writer.trigger(availableNow=True).start().awaitTermination()
    return newest_rows(spark, path, stream.schema, keys, order)
