"""State transitions, replay, streams, extraction answers and scans."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import ntz
from duewise.operators import events as EV
from duewise.session import new_path
from duewise.sources import keyed
from duewise.streaming import accounts as ST

SCHEMA = (
    "event_id BIGINT, event_type STRING, invoice_id BIGINT, occurred_at TIMESTAMP_NTZ, payload MAP<STRING,STRING>, "
    "is_disputed BOOLEAN, is_actually_paid BOOLEAN, selected_action STRING"
)
START = dt.datetime(2024, 1, 1)


def event(i, kind, invoice=1, hours=None, disputed=False, paid=False, action="email"):
    return (i, kind, invoice, START + dt.timedelta(hours=i if hours is None else hours), {}, disputed, paid, action)


def states(spark, rows, stored=None):
    kept = spark.createDataFrame(stored, "invoice_id BIGINT, current_state STRING") if stored else None
    out = EV.replay(spark.createDataFrame(rows, SCHEMA), kept).orderBy("event_id").collect()
    return [(r.next_state, r.state_transition_path) for r in out]


def fold(rows, start="overdue"):
    """One event at a time, from the rules."""
    now, out = {}, []
    for _, kind, inv, _, _, disputed, paid, action in sorted(rows, key=lambda e: (e[3], e[0])):
        told, rest = [], None
        if kind == "promise.created":
            told, rest = ["promise"], "promise"
        elif kind == "promise.broken":
            told = ["broken", "reassess"]
        elif now.get(inv, start) == "promise" and kind in ("payment.received", "payment.partial"):
            told, rest = ["kept"], "kept"
        state = "closed_paid" if paid else "dispute_review" if disputed else rest or ("closed_abandoned" if action == "stop" else P.ACTION_STATE[action])
        now[inv] = state
        out.append((state, told if told and told[-1] == state else told + [state]))
    return out


def test_promise_kept_then_closed(spark):
    rows = [event(1, "promise.created"), event(2, "payment.partial"), event(3, "promise.created"), event(4, "payment.received", paid=True)]
    assert states(spark, rows) == [("promise", ["promise"]), ("kept", ["kept"]), ("promise", ["promise"]), ("closed_paid", ["kept", "closed_paid"])]


def test_rule_order(spark):
    rows = [
        event(1, "promise.broken", action="voice"), event(2, "promise.created", disputed=True), event(3, "payment.received"),
        event(4, "invoice.overdue", action="stop"), event(5, "promise.created", disputed=True, paid=True),
    ]
    assert states(spark, rows) == [
        ("remind", ["broken", "reassess", "remind"]), ("dispute_review", ["promise", "dispute_review"]), ("remind", ["remind"]),
        ("closed_abandoned", ["closed_abandoned"]), ("closed_paid", ["promise", "closed_paid"]),
    ]


def test_stored_state_seeds_the_first_event(spark):
    rows = [event(1, "payment.received"), event(2, "payment.received", invoice=2)]
    assert [s for s, _ in states(spark, rows, [(1, "promise")])] == ["kept", "remind"]


def random_events(seed, n=600):
    rng = random.Random(seed)
    pick = lambda i: event(
        i, rng.choice(P.EVENT_TYPES), rng.choice([1, 1, 1, 2, 3]), rng.choice([i // 7, i / 3]), rng.random() < 0.1, rng.random() < 0.1, rng.choice(list(P.ACTIONS))
    )
    return [pick(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_one_event_at_a_time(spark, seed):
    rows = random_events(seed)
    got = EV.replay(spark.createDataFrame(rows, SCHEMA)).orderBy("occurred_at", "event_id").collect()
    assert [(r.next_state, r.state_transition_path) for r in got] == fold(rows)


def batches(spark, rows, n, shuffled=None, last=()):
    """Events in time order (or shuffled), one file per micro-batch; ``last`` come in one more."""
    path = new_path(spark, "events")
    rows = sorted(rows, key=lambda e: (e[3], e[0]))
    if shuffled is not None:
        random.Random(shuffled).shuffle(rows)
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    if last:
        spark.createDataFrame(last, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = ST.read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    return stream.withColumn("event_time", F.col("occurred_at").cast("timestamp"))


def streamed(spark, events, delay):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    out = new_path(spark, "out")
    done = ST.stream_transitions(events.withWatermark("event_time", delay))
    ST.run_to_end(done.writeStream.format("parquet").option("path", out), new_path(spark, "check"))
    return spark.read.schema(ST.TRANSITION).parquet(out).collect()


def last_event(hours=24 * 400):
    return event(None, "invoice.overdue", -1, hours=hours)


@pytest.mark.parametrize("seed", [None, 8])
def test_stream_over_shuffled_batches_equals_replay(spark, seed):
    rows = random_events(4, 150)
    done = streamed(spark, batches(spark, rows, 3, seed, [last_event()]), "100 days")
    got = {r.event_id: (r.next_state, r.state_transition_path) for r in done if r.event_id is not None}
    want = {e[0]: (s, ",".join(p)) for e, (s, p) in zip(sorted(rows, key=lambda e: (e[3], e[0])), fold(rows))}
    assert got == want


def test_events_wait_for_earlier_ones(spark):
    """A payment that comes before the promise it keeps, in another batch."""
    rows = [event(5, "payment.received", 1, hours=5), event(4, "promise.created", 1, hours=4), event(9, "invoice.overdue", 2, hours=9)]
    path = new_path(spark, "events")
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = ST.read_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1).withColumn("event_time", F.col("occurred_at").cast("timestamp"))
    got = {r.event_id: r.next_state for r in streamed(spark, stream, "3 hours")}
    assert got == {4: "promise", 5: "kept"}  # the last event still waits


def test_quiet_account_is_woken_for_review(spark):
    rows = [event(1, "invoice.overdue", 1), event(2, "promise.created", 2), event(3, "invoice.overdue", 3, hours=24 * 9), event(4, "invoice.overdue", 3, hours=24 * 10)]
    got = streamed(spark, batches(spark, [*rows, last_event(24 * 10 + 2)], 5), "1 hour")
    assert [r.invoice_id for r in got if r.event_id is None] == [1], "only the account resting in a watched state is due"
    assert sorted(r.event_id for r in got if r.event_id is not None) == [1, 2, 3, 4]


def test_audit_sink_over_batches_and_a_repeated_batch(spark):
    rows = random_events(5, 90)
    root = new_path(spark, "audit")
    sink = ST.audit_sink(root)
    ST.run_to_end(batches(spark, rows, 3).writeStream.foreachBatch(sink), new_path(spark, "check"))
    logs = spark.read.parquet(f"{root}/logs")
    assert logs.count() == len(rows)
    last = {r.invoice_id: r.current_state for r in keyed.read(spark, f"{root}/state", 3).collect()}
    ordered = sorted(rows, key=lambda e: (e[3], e[0]))
    assert last == {e[2]: s for e, (s, _) in zip(ordered, fold(rows))}
    sink(spark.createDataFrame(ordered[60:], SCHEMA), 2)
    assert spark.read.parquet(f"{root}/logs").count() == len(rows)


def test_an_event_without_a_next_state_leaves_the_account_as_it_is(spark):
    root = new_path(spark, "audit")
    sink = ST.audit_sink(root)
    sink(spark.createDataFrame([event(1, "promise.created", 1), event(2, "invoice.overdue", 1, action=None), event(3, "invoice.overdue", 2, action=None), event(4, "invoice.overdue", 3)], SCHEMA), 0)
    state = {r.invoice_id: (r.current_state, r.updated_at) for r in keyed.read(spark, f"{root}/state", 1).collect()}
    assert state == {1: ("promise", START + dt.timedelta(hours=1)), 3: (P.ACTION_STATE["email"], START + dt.timedelta(hours=4))}
    reasons = {r.event_id: r.reason for r in spark.read.parquet(f"{root}/logs").collect()}
    assert reasons[1] == "promise recorded -- account moved to promise" and {reasons[k] for k in (2, 3, 4)} == {"no assessment this round"}
    sink(spark.createDataFrame([event(9, "invoice.overdue", 1, action=None)], SCHEMA), 1)
    later = {r.invoice_id: r.updated_at for r in keyed.read(spark, f"{root}/state", 2).collect()}
    assert later[1] == START + dt.timedelta(hours=1)


def test_a_rejected_event_is_logged_and_changes_nothing(spark):
    root = new_path(spark, "audit")
    sink = ST.audit_sink(root)
    rows = spark.createDataFrame([event(1, "invoice.overdue", 1), event(2, "promise.created", 1), event(3, "payment.received", 1), event(4, "promise.created", 2)], SCHEMA)
    sink(rows.withColumn("expected_invoice_id", F.col("invoice_id") + F.col("event_id").isin(2, 4).cast("int")), 0)
    state = {r.invoice_id: (r.current_state, r.updated_at) for r in keyed.read(spark, f"{root}/state", 1).collect()}
    assert state == {1: (P.ACTION_STATE["email"], START + dt.timedelta(hours=3))}  # not kept: the promise before it was rejected
    logs = {r.event_id: r for r in spark.read.parquet(f"{root}/logs").collect()}
    assert logs[2].decision == "rejected" and logs[2].reason == "invalid event: event.invoice_id (1) != state invoice_id (2)"
    assert '"state_transition_path":[]' in logs[4].policy_checks and "selected_action" not in logs[4].policy_checks and len(logs) == 4


def test_dedup_inside_the_watermark(spark):
    rows = [event(1, "invoice.overdue"), event(1, "invoice.overdue"), event(2, "invoice.overdue")]
    out = new_path(spark, "out")
    once = ST.deduplicated(batches(spark, rows, 1).select("event_id", "event_time"))
    ST.run_to_end(once.writeStream.format("parquet").option("path", out), new_path(spark, "check"))
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2]


@pytest.mark.parametrize("raw, want", [
    ('{"promise_found": true, "promised_amount": 5000, "promised_date": "2026-09-01"}', ("promise", 5000.0, dt.date(2026, 9, 1))),
    ('{"promise_found": true, "promised_amount": "5000.50", "promised_date": "20260901"}', ("promise", 5000.5, dt.date(2026, 9, 1))),
    ('{"promise_found": false, "promised_amount": null, "promised_date": null}', ("none", None, None)),
    ("{oops", ("malformed json", None, None)),
    ("[1, 2]", ("malformed response shape", None, None)),
    ('{"promised_amount": 5}', ("malformed response shape", None, None)),
    ('{"promise_found": true, "promised_amount": 0, "promised_date": "2026-09-01"}', ("non-positive promised_amount", None, None)),
    ('{"promise_found": true, "promised_amount": 5, "promised_date": "Friday"}', ("malformed promise fields", None, None)),
    ('{"promise_found": true, "promised_amount": 5, "promised_date": "2026-02-31"}', ("malformed promise fields", None, None)),
    ('{"promise_found": true, "promised_date": "2026-09-01"}', ("malformed promise fields", None, None)),
])
def test_extraction_answers(spark, raw, want):
    got = EV.check_extractions(spark.createDataFrame([(raw,)], "raw_json STRING")).first()
    amount = None if got.promised_amount is None else float(got.promised_amount)
    assert (got.outcome, amount, got.promised_date) == want


def test_routes(spark):
    rows = spark.createDataFrame([(1, "promise.created", 1, 1), (2, "customer.responded", 1, 1), (3, "invoice.overdue", 1, 1), (4, "promise.created", 1, 2)],
                                 "event_id INT, event_type STRING, invoice_id INT, expected_invoice_id INT")
    got = EV.route(rows).orderBy("event_id").collect()
    assert [r.route for r in got] == ["promise", "extract", "full", "rejected"]
    assert got[3].route_error == "invalid event: event.invoice_id (1) != state invoice_id (2)"


def test_scans(spark):
    from decimal import Decimal

    assert not set(P.REVIEW_TIMEOUT_STATES) & set(P.BROKEN_PROMISE_STATES)
    as_of = dt.datetime(2026, 8, 27, 12)
    edge = as_of - dt.timedelta(days=3)
    state = spark.createDataFrame([(1, "wait", edge), (2, "wait", edge + dt.timedelta(seconds=1)), (3, "promise", START), (4, "kept", START)],
                                  "invoice_id BIGINT, current_state STRING, updated_at TIMESTAMP_NTZ")
    assert sorted(r.invoice_id for r in EV.review_timeouts(state, ntz("2026-08-27 12:00:00")).collect()) == [1, 4]
    made, money = dt.datetime(2026, 8, 10), Decimal("100.00")
    promises = spark.createDataFrame(
        [(1, 1, money, dt.date(2026, 8, 20), "open", made), (2, 2, money, dt.date(2026, 8, 20), "open", made), (3, 3, money, dt.date(2026, 8, 27), "open", made),
         (4, 4, money, dt.date(2026, 8, 20), "kept", made), (5, 5, money, dt.date(2026, 8, 20), "open", made)],
        "id BIGINT, invoice_id BIGINT, promised_amount DECIMAL(12,2), promised_date DATE, status STRING, created_at TIMESTAMP_NTZ")
    payments = spark.createDataFrame(
        [(2, Decimal("60.00"), dt.date(2026, 8, 11)), (2, Decimal("40.00"), dt.date(2026, 8, 12)), (5, Decimal("100.00"), dt.date(2026, 8, 9)), (1, Decimal("99.99"), dt.date(2026, 8, 12))],
        "invoice_id BIGINT, amount DECIMAL(12,2), payment_date DATE")
    broken = EV.broken_promises(promises, payments, ntz("2026-08-27 12:00:00")).collect()
    assert sorted(r.payload["promise_id"] for r in broken) == ["1", "5"]


def test_new_events_are_appended_without_reading_the_waiting_ones():
    """What an account costs in a batch follows its new events, not those that wait; one timer stands at the first of them."""

    class Handle:
        def __init__(self):
            self.rows, self.value, self.timers, self.reads = [], None, set(), 0

        def getListState(self, name, schema):
            return SimpleNamespace(appendList=self.rows.extend, get=self.read, put=lambda rows: self.rows.__setitem__(slice(None), rows), clear=self.rows.clear, exists=lambda: bool(self.rows))

        def getValueState(self, name, schema):
            return SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v), exists=lambda: self.value is not None)

        def read(self):
            self.reads += 1
            return list(self.rows)

        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.remove(at)
        listTimers = lambda self: list(self.timers)

    handle, memory = Handle(), ST.promise_memory()
    memory.init(handle)
    event = lambda id_, at: Row(event_id=id_, event_micros=at, rests=False, state_after_promise="kept", path_after_promise="kept", state_otherwise="closed_paid", path_otherwise="closed_paid")
    for at in (9_000_000, 5_000_000, 7_000_000):
        assert list(memory.handleInputRows((1,), iter([event(at, at)]), None)) == []
    assert handle.reads == 0 and handle.timers == {5001} and len(handle.rows) == 3
    handle.timers.clear()  # it expires
    done = list(memory.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 8000), None))
    assert [r.event_id for r in done] == [5_000_000, 7_000_000] and handle.timers == {9001} and len(handle.rows) == 1


def test_a_stream_of_many_files_loses_no_event(spark):
    """More files than two batches read: the event that closes the stream comes after all of them."""
    from duewise.queries import lifecycle as L
    from duewise.queries.registry import Inputs

    root = new_path(spark, "many-files")
    kind = F.element_at(F.array(*map(F.lit, ("signup", "purchase", "error", "click", "view"))), (F.col("id") % 5 + 1).cast("int"))
    rows = spark.range(60).select(
        F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 7200)).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 4).alias("user_id"), kind.alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    rows.repartition(20, "event_id").sortWithinPartitions("event_id").write.option("maxRecordsPerFile", 2).parquet(f"{root}/events.parquet")
    assert len(spark.read.parquet(f"{root}/events.parquet").inputFiles()) > 16
    got = {r.event_id: r for r in L.state_stream(Inputs(spark, root)).collect()}
    want = {r.event_id: r for r in L.state_replay(Inputs(spark, root)).withColumn("state_transition_path", F.array_join("state_transition_path", ",")).collect()}
    assert len(got) == 60 and got == want
