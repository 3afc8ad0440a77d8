"""Account events as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from duewise import params as P
from duewise.operators import audit
from duewise.operators.events import next_state, replay, rests_in_promise, route, transition_path
from duewise.sources import keyed, sinks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REVIEW_MICROS = P.COOLDOWN_DAYS * 86_400_000_000
REVIEW_STATES = list(P.REVIEW_TIMEOUT_STATES)


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeated event ids inside the watermark. Off by default: the audit log keeps repeats."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])


TRANSITION = "event_id BIGINT, invoice_id BIGINT, next_state STRING, state_transition_path STRING"


WAITING = "event_id BIGINT, micros BIGINT, rests BOOLEAN, state_after_promise STRING, path_after_promise STRING, state_otherwise STRING, path_otherwise STRING"


def promise_memory() -> StatefulProcessor:
    """The processor, as a local class: it travels by value, so the streaming runner needs no package of ours."""

    row = Row("event_id", "invoice_id", "next_state", "state_transition_path")

    class PromiseMemory(StatefulProcessor):
        """Releases an account's events in (time, id) order, remembers whether it rests in a promise, and wakes it for review.

        Events wait in a list until the watermark is past them, when no earlier one can come; one timer an account says when that
        is, or when a quiet account is due. The first waiting time and the timer are remembered beside the list, so new events are
        appended without reading those that wait. Both possible outcomes of an event arrive as columns; only which one holds is decided.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", WAITING)
            self.memory = handle.getValueState("memory", "rests BOOLEAN, review BIGINT, first BIGINT, timer BIGINT")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            names = ["event_id", "event_micros", *[x.split()[0] for x in WAITING.split(", ")[2:]]]
            held = [tuple(r[n] for n in names) for r in rows]
            self.waiting.appendList(held)
            rests, review, first, timer = self.memory.get() or (False, None, None, None)
            self.remember(rests, review, min(r[1] for r in [*held, (None, first)] if r[1] is not None), timer)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            now = timerValues.getCurrentWatermarkInMs() * 1000
            rests, review, first, _ = self.memory.get()
            held = [] if first is None else list(self.waiting.get())
            for r in sorted((r for r in held if r[1] < now), key=lambda r: (r[1], r[0] is None, r[0])):
                if review is not None and review < r[1]:
                    yield row(None, key[0], None, "review.timeout")
                state, path = (r[3], r[4]) if rests else (r[5], r[6])
                yield row(r[0], key[0], state, path)
                rests, review = bool(r[2]), r[1] + REVIEW_MICROS if state in REVIEW_STATES else None
            if review is not None and review < now:
                yield row(None, key[0], None, "review.timeout")
                review = None
            later = [r for r in held if r[1] >= now]
            if len(later) < len(held):
                self.waiting.put(later) if later else self.waiting.clear()
            self.remember(rests, review, min((r[1] for r in later), default=None), None)

        def remember(self, rests, review, first, timer) -> None:
            """``timer`` is set now; one that has expired is gone already."""
            due = min((x for x in (first, review) if x is not None), default=None)
            due = None if due is None else due // 1000 + 1
            if due != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due)
            self.memory.update((rests, review, first, due))

        def close(self) -> None:
            pass

    return PromiseMemory()


def stream_transitions(events: DataFrame) -> DataFrame:
    """State after every event, in event-time order; a row without event id says that an account is due for review.

    ``events`` needs ``event_time`` (TIMESTAMP) with a watermark, and its rows leave when the watermark is past them; later ones
    are dropped as late. Set the RocksDB state store on the session first. What an account holds is what the watermark's delay
    spans.
    """
    rows = events.select(
        F.col("event_id").cast("long").alias("event_id"), "invoice_id", F.unix_micros("event_time").alias("event_micros"), "event_time",
        F.coalesce(rests_in_promise(), F.lit(False)).alias("rests"), *_outcome("after_promise", True), *_outcome("otherwise", False),
    )
    return rows.groupBy("invoice_id").transformWithState(
        statefulProcessor=promise_memory(), outputStructType=TRANSITION, outputMode="Append", timeMode="EventTime",
    )


def _outcome(name: str, was_promise: bool):
    state = next_state(F.lit(was_promise))
    path = F.array_join(transition_path(F.lit(was_promise), state), ",")
    return [state.alias(f"state_{name}"), path.alias(f"path_{name}")]


STATE = "invoice_id BIGINT, current_state STRING, updated_at TIMESTAMP_NTZ"


def audit_sink(root: str, rounds_of=None):
    """A ``foreachBatch`` function: log the batch's rounds and update the accounts they move.

    Logs are keyed by batch id, and batch n turns version n of the keyed state table into version n + 1. So a batch that runs again
    replaces its own output and starts from the state before it, and only buckets with moved accounts are written. An event that
    names another account than ``expected_invoice_id`` (where events have it) is rejected: it is logged with its error and changes
    nothing. ``rounds_of`` may add the assessment columns of a round; without it only transitions are logged.
    """
    state = f"{root}/state"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            keyed.ensure(spark.createDataFrame([], STATE), state, ["invoice_id"])
        rejected = None
        if "expected_invoice_id" in batch.columns:
            routed = route(batch)
            rejected = routed.where("route = 'rejected'").withColumn("error", F.col("route_error")).drop("route", "route_error", "selected_action")
            batch = routed.where("route <> 'rejected'").drop("route", "route_error")
        done = replay(batch, keyed.read(spark, state, batch_id))
        rounds = with_empty_round(rounds_of(done) if rounds_of else done)
        if rejected is not None:
            rounds = rounds.unionByName(with_empty_round(rejected), allowMissingColumns=True)
        logs = audit.event_decision_logs(rounds)
        logs.write.mode("overwrite").parquet(f"{root}/logs/batch={batch_id}")
        decided = done.filter("next_state IS NOT NULL")  # an event that leads nowhere leaves the state and its time as they are
        updates = sinks.newest_per_key(
            decided.select("invoice_id", F.col("next_state").alias("current_state"), F.col("occurred_at").alias("updated_at"), "event_id"),
            ["invoice_id"], F.struct("updated_at", "event_id"),
        ).drop("event_id")
        keyed.upsert(updates, state, ["invoice_id"], base=batch_id)

    return run


def with_empty_round(done: DataFrame) -> DataFrame:
    """Log columns of a round that had no assessment beyond the event itself."""
    text = {c: F.lit(None).cast("string") for c in ("proposed_action", "policy_result", "policy_reason", "tool_result", "error", "root_cause_label")}
    number = {c: F.lit(None).cast("double") for c in ("recovery_probability", "ptp_probability", "root_cause_confidence")}
    missing = {c: v for c, v in {**text, **number, "retry_count": F.lit(0)}.items() if c not in done.columns}
    return done.withColumns(missing)


def run_to_end(writer, checkpoint: str) -> None:
    """Process everything available and stop."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
