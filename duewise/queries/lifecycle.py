"""Queries on account events: validity, routing, extraction, transitions, scans, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise import params as P
from duewise.operators import events as EV
from duewise.queries.registry import query
from duewise.queries.sqlviews import AS_OF, case, r, sql, ts, view
from duewise.session import new_path
from duewise.sources.driver_tables import account_events_from
from duewise.streaming import accounts as ST


def context_columns(events):
    """The given context of each event of the test tables: dispute, ledger and engine outcome."""
    key = F.col("event_id")
    return events.withColumns({
        "is_actually_paid": F.col("value") > 400.0, "is_disputed": key % 50 == 0,
        "selected_action": EV.lookup(key % 7, dict(enumerate(P.ACTIONS))),
    })


def events(x):
    return context_columns(x.d.account_events)


view("ev", f"SELECT *, value > 400.0 AS is_actually_paid, event_id % 50 = 0 AS is_disputed, {case('event_id % 7', dict(enumerate(P.ACTIONS)))} AS selected_action FROM account_events")
view("replayed", """SELECT *, CASE WHEN len(told) > 0 AND told[len(told)] = next_state THEN told ELSE list_append(told, next_state) END AS path FROM (
  SELECT *, CASE WHEN is_actually_paid THEN 'closed_paid' WHEN is_disputed THEN 'dispute_review' WHEN event_type = 'promise.created' THEN 'promise'
    WHEN was AND event_type IN ('payment.received', 'payment.partial') THEN 'kept' WHEN selected_action = 'stop' THEN 'closed_abandoned'
    WHEN selected_action = 'wait' THEN 'wait' WHEN selected_action = 'escalate' THEN 'escalate' ELSE 'remind' END AS next_state,
    CASE WHEN event_type = 'promise.created' THEN ['promise'] WHEN event_type = 'promise.broken' THEN ['broken', 'reassess']
    WHEN was AND event_type IN ('payment.received', 'payment.partial') THEN ['kept'] ELSE [] END AS told FROM (
  SELECT *, coalesce(lag(event_type = 'promise.created' AND NOT is_actually_paid AND NOT is_disputed) OVER (PARTITION BY invoice_id ORDER BY occurred_at, event_id), false) AS was FROM ev))""")
_replay_sql = sql("SELECT event_id, invoice_id, next_state, array_to_string(path, ',') AS state_transition_path FROM replayed")
_replay_cols = ["event_id", "invoice_id", "next_state", "state_transition_path"]


@query("O160_event_envelope", sql(f"SELECT event_type, count(*) AS n, {ts('min(occurred_at)')} AS first_at FROM account_events GROUP BY 1"))
def envelope(x):
    return x.d.account_events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("occurred_at").alias("first_at"))


@query("O161_event_routing", sql("""SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'rejected' WHEN event_type = 'customer.responded' THEN 'extract'
  WHEN event_type = 'promise.created' THEN 'promise' ELSE 'full' END AS route, CASE WHEN event_id % 97 = 0 THEN
  'invalid event: event.invoice_id (' || invoice_id || ') != state invoice_id (' || (invoice_id + 1) || ')' END AS route_error FROM account_events"""))
def routing(x):
    expected = F.col("invoice_id") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)
    rows = x.d.account_events.withColumn("expected_invoice_id", expected)
    return EV.route(rows).select("event_id", "route", "route_error")


def answers(x):
    """Raw extraction answers of response events, in all the shapes that occur."""
    key, k = F.col("event_id"), F.get_json_object("props", "$.k")
    day = F.format_string("2024-02-%02d", k.cast("int") % 28 + 1)
    shape = key % 6
    raw = (
        F.when(shape == 0, F.concat(F.lit('{"promise_found": true, "promised_amount": '), k, F.lit('.5, "promised_date": "'), day, F.lit('"}')))
        .when(shape == 1, F.lit('{"promise_found": false, "promised_amount": null, "promised_date": null}'))
        .when(shape == 2, F.concat(F.lit("not json "), k))
        .when(shape == 3, F.lit('{"promised_amount": 5}'))
        .when(shape == 4, F.concat(F.lit('{"promise_found": true, "promised_amount": -'), k, F.lit(', "promised_date": "'), day, F.lit('"}')))
        .otherwise(F.lit('{"promise_found": true, "promised_amount": 10, "promised_date": "next week"}'))
    )
    return x.raw("events").filter("event_type = 'click'").select("event_id", raw.alias("raw_json"))


_answer = """CASE event_id % 6 WHEN 0 THEN 'promise' WHEN 1 THEN 'none' WHEN 2 THEN 'malformed json' WHEN 3 THEN 'malformed response shape'
  WHEN 4 THEN CASE WHEN k::INT = 0 THEN 'non-positive promised_amount' ELSE 'non-positive promised_amount' END ELSE 'malformed promise fields' END"""
view("answers", f"""SELECT event_id, {_answer} AS outcome, CASE WHEN event_id % 6 = 0 THEN (k || '.5')::DOUBLE END AS promised_amount,
  CASE WHEN event_id % 6 = 0 THEN strftime(DATE '2024-02-01' + (k::INT % 28), '%Y-%m-%d') END AS promised_date
  FROM account_events WHERE event_type = 'customer.responded'""")


@query("O132_extraction_check", sql(f"SELECT event_id, outcome, {r('promised_amount')} AS promised_amount, promised_date FROM answers"))
def extraction(x):
    return EV.check_extractions(answers(x)).select("event_id", "outcome", "promised_amount", "promised_date")


@query("O133_promise_event", sql("""SELECT e.event_id, CASE WHEN a.outcome = 'promise' THEN 'promise.created' ELSE e.event_type END AS event_type,
  CASE WHEN a.outcome = 'promise' THEN a.promised_date END AS promised_date, CASE WHEN a.outcome = 'promise' THEN 'unknown' END AS source
  FROM account_events e LEFT JOIN answers a ON a.event_id = e.event_id"""))
def promise_event(x):
    turned = EV.apply_extractions(x.d.account_events, EV.check_extractions(answers(x)))
    return turned.select("event_id", "event_type", F.col("payload")["promised_date"].alias("promised_date"), F.col("payload")["source"].alias("source"))


@query("O162_state_replay", _replay_sql)
def state_replay(x):
    return EV.replay(events(x)).select(*_replay_cols)


def _stream(x):
    spark = x.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    schema = x.raw("events").schema
    source = ST.read_stream(spark, f"{x.sf_dir}/event[s].parquet", schema)
    return _context(source)


def _context(source):
    return context_columns(account_events_from(source)).withColumn("event_time", F.col("occurred_at").cast("timestamp"))


def _closable_stream(x):
    """The events, and a function that adds one of another account long after them, so that the watermark passes them all.

    It is called when all events are read: files come some at a time, and what comes after the last event is late.
    """
    raw = x.raw("events")
    last = raw.agg(F.max("ts").alias("ts")).select(F.col("ts") + F.make_dt_interval(F.lit(100)))
    path = new_path(x.spark, "closing")
    known = {"ts": F.col("ts"), "user_id": F.lit(-1)}
    closing = last.toDF("ts").select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in raw.schema])
    x.spark.createDataFrame([], raw.schema).write.parquet(path)
    return _stream(x).unionByName(_context(ST.read_stream(x.spark, path, raw.schema))), lambda: closing.write.mode("append").parquet(path)


@query("O162_state_stream", _replay_sql)
def state_stream(x):
    stream, close = _closable_stream(x)
    done = ST.stream_transitions(stream.withWatermark("event_time", "31 days"))
    out, checkpoint = new_path(x.spark, "transitions"), new_path(x.spark, "checkpoint")
    ST.run_to_end(done.writeStream.format("parquet").option("path", out), checkpoint)
    close()
    ST.run_to_end(done.writeStream.format("parquet").option("path", out), checkpoint)
    return x.spark.read.schema(ST.TRANSITION).parquet(out).filter("event_id IS NOT NULL").select(*_replay_cols)


@query("O163_review_timeouts", sql(f"""SELECT 'review.timeout' AS event_type, invoice_id, {ts(AS_OF)} AS occurred_at FROM account_state
  WHERE current_state IN ('wait', 'remind', 'escalate', 'kept') AND updated_at <= {AS_OF} - to_days(3)"""))
def timeouts(x):
    return EV.review_timeouts(x.d.account_state, x.as_of)


@query("O164_broken_promises", sql(f"""SELECT 'promise.broken' AS event_type, p.invoice_id, {ts(AS_OF)} AS occurred_at, p.id::VARCHAR AS promise_id FROM promises p
  LEFT JOIN payments y ON y.invoice_id = p.invoice_id AND y.payment_date >= p.created_at AND y.payment_date <= {AS_OF}
  WHERE p.status = 'open' AND p.promised_date < {AS_OF}::DATE GROUP BY p.id, p.invoice_id, p.promised_cents
  HAVING coalesce(sum(y.cents), 0) < p.promised_cents"""))
def broken(x):
    return EV.broken_promises(x.d.promises, x.d.payments, x.as_of).select(
        "event_type", "invoice_id", "occurred_at", F.col("payload")["promise_id"].alias("promise_id")
    )


@query("O166_stream_audit", sql("""SELECT event_id, invoice_id, selected_action AS decision, CASE WHEN event_type LIKE 'promise.%' AND next_state IS NOT NULL THEN 'promise recorded -- account moved to ' || next_state ELSE 'no assessment this round' END AS reason,
  array_to_string(path, ',') AS path FROM replayed"""))
def stream_audit(x):
    root = new_path(x.spark, "audit")
    ST.run_to_end(_stream(x).writeStream.foreachBatch(ST.audit_sink(root)), new_path(x.spark, "checkpoint"))
    logs = x.spark.read.parquet(f"{root}/logs")
    path = F.from_json(F.get_json_object("policy_checks", "$.state_transition_path"), "array<string>")
    return logs.select("event_id", "invoice_id", "decision", "reason", path.alias("path"))


@query("O168_stream_dedup", sql("SELECT event_type, count(DISTINCT event_id) AS n FROM account_events GROUP BY 1"))
def stream_dedup(x):
    twice = _stream(x).select("event_id", "event_type", "event_time")
    once = ST.deduplicated(twice.unionByName(_stream(x).select("event_id", "event_type", "event_time")), "31 days")
    out = new_path(x.spark, "dedup")
    ST.run_to_end(once.writeStream.format("parquet").option("path", out), new_path(x.spark, "checkpoint"))
    return x.spark.read.schema("event_id BIGINT, event_type STRING").parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
