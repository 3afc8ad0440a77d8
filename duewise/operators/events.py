"""Account events: validity, routing, promise extraction answers, state transitions, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import cents, lookup, to_ntz
from duewise.operators.prefix import chunked_lag

_PAYMENTS = ["payment.received", "payment.partial"]


def route(events: DataFrame, expected: str = "expected_invoice_id") -> DataFrame:
    """Branch of each event; an event about another invoice is only logged."""
    wrong = F.col("invoice_id") != F.col(expected)
    kind = F.col("event_type")
    text = F.concat(
        F.lit("invalid event: event.invoice_id ("), F.col("invoice_id").cast("string"), F.lit(") != state invoice_id ("),
        F.col(expected).cast("string"), F.lit(")"),
    )
    return events.select(
        "*",
        F.when(wrong, "rejected").when(kind == "customer.responded", "extract").when(kind == "promise.created", "promise")
        .otherwise("full").alias("route"),
        F.when(wrong, text).alias("route_error"),
    )


def check_extractions(answers: DataFrame) -> DataFrame:
    """Verdict on raw JSON answers: ``outcome`` is promise, none or a failure reason. ``answers``: raw_json."""
    path = lambda p: F.get_json_object("raw_json", p)
    parsed = F.try_parse_json("raw_json")
    found = path("$.promise_found")
    amount = path("$.promised_amount").try_cast("decimal(18,2)")
    text = path("$.promised_date")
    compact = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).when(text.rlike(r"^\d{8}$"), compact)
    date = iso.try_cast("date")
    keys = F.json_object_keys("raw_json")
    truthy = found.isNotNull() & ~found.isin("false", "null", "0", "")
    present = F.coalesce(F.array_contains(keys, "promise_found"), F.lit(False))
    outcome = (
        F.when(parsed.isNull(), "malformed json")
        .when(~present, "malformed response shape")
        .when(~truthy, "none")
        .when(amount.isNull() | date.isNull(), "malformed promise fields")
        .when(amount <= 0, "non-positive promised_amount")
        .otherwise("promise")
    )
    good = F.col("outcome") == "promise"
    rows = answers.withColumns({"outcome": outcome, "_amount": amount, "_date": date})
    return rows.withColumns({
        "promised_amount": F.when(good, F.col("_amount")), "promised_date": F.when(good, F.col("_date")),
    }).drop("_amount", "_date")


def apply_extractions(events: DataFrame, checked: DataFrame) -> DataFrame:
    """A response with a valid promise becomes a promise event; every other event stays as it is."""
    found = checked.filter("outcome = 'promise'").select("event_id", "promised_amount", "promised_date")
    rows = events.join(found, "event_id", "left")
    turned = F.col("promised_date").isNotNull() & (F.col("event_type") == "customer.responded")
    payload = F.create_map(
        F.lit("promised_amount"), F.col("promised_amount").cast("double").cast("string"), F.lit("promised_date"),
        F.col("promised_date").cast("string"), F.lit("source"), F.coalesce(F.col("payload")["channel"], F.lit("unknown")),
    )
    return rows.withColumns({
        "event_type": F.when(turned, "promise.created").otherwise(F.col("event_type")),
        "payload": F.when(turned, payload).otherwise(F.col("payload")),
    }).drop("promised_amount", "promised_date")


# State transitions


def rests_in_promise() -> Column:
    """Whether the account rests in ``promise`` after this event; does not depend on the state before it."""
    return (F.col("event_type") == "promise.created") & ~F.col("is_actually_paid") & ~F.col("is_disputed")


def next_state(was_promise: Column) -> Column:
    kind = F.col("event_type")
    settled = F.when(F.col("selected_action") == "stop", "closed_abandoned").otherwise(lookup(F.col("selected_action"), P.ACTION_STATE))
    return (
        F.when(F.col("is_actually_paid"), "closed_paid")
        .when(F.col("is_disputed"), "dispute_review")
        .when(kind == "promise.created", "promise")
        .when(was_promise & kind.isin(_PAYMENTS), "kept")
        .otherwise(settled)
    )


def transition_path(was_promise: Column, state: Column) -> Column:
    """What happened this round, ending in the resting state, which is not repeated."""
    kind = F.col("event_type")
    told = (
        F.when(kind == "promise.created", F.array(F.lit("promise")))
        .when(kind == "promise.broken", F.array(F.lit("broken"), F.lit("reassess")))
        .when(was_promise & kind.isin(_PAYMENTS), F.array(F.lit("kept")))
        .otherwise(F.array().cast("array<string>"))
    )
    same = F.coalesce(F.element_at(told, -1) == state, F.lit(False))
    return F.when((F.size(told) > 0) & same, told).otherwise(F.concat(told, F.array(state)))


def with_transition(events: DataFrame, was_promise: Column) -> DataFrame:
    rows = events.withColumn("next_state", next_state(was_promise))
    return rows.withColumn("state_transition_path", transition_path(was_promise, F.col("next_state")))


def replay(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """State after every event of every account, in (time, id) order.

    Only ``kept`` depends on the state before, and only through ``promise``, which the event before decides alone; so
    the previous event is enough. Hours split a busy account over tasks. ``stored``: invoice_id, current_state.
    """
    marked = events.withColumn("rests", rests_in_promise())
    lagged = chunked_lag(marked, "invoice_id", F.date_trunc("hour", "occurred_at"), ["occurred_at", "event_id"], "rests", "was")
    seed = F.lit(False)
    if stored is not None:
        lagged = lagged.join(stored.select("invoice_id", (F.col("current_state") == "promise").alias("seed")), "invoice_id", "left")
        seed = F.coalesce(F.col("seed"), F.lit(False))
    done = with_transition(lagged.withColumn("was", F.coalesce(F.col("was"), seed)), F.col("was"))
    return done.drop("rests", "was", "seed")


# Scans


def review_timeouts(account_state: DataFrame, as_of: Column) -> DataFrame:
    """Accounts resting in a watched state, untouched for the cooldown."""
    stale = F.col("updated_at") <= as_of - F.make_dt_interval(F.lit(P.COOLDOWN_DAYS))
    return account_state.filter(F.col("current_state").isin(P.REVIEW_TIMEOUT_STATES) & stale).select(
        F.lit("review.timeout").alias("event_type"), "invoice_id", as_of.alias("occurred_at")
    )


def broken_promises(promises: DataFrame, payments: DataFrame, as_of: Column) -> DataFrame:
    """Open promises past their date whose payments since they were made fall short."""
    due = promises.filter((F.col("status") == "open") & (F.col("promised_date") < F.to_date(as_of)))
    daily = payments.groupBy("invoice_id", "payment_date").agg(F.sum(cents(F.col("amount"))).alias("paid"))
    at = to_ntz(F.col("payment_date"))
    paid = (
        due.select("id", "invoice_id", "created_at").join(daily, "invoice_id")
        .filter((at >= F.col("created_at")) & (at <= as_of)).groupBy("id").agg(F.sum("paid").alias("paid"))
    )
    short = F.coalesce(F.col("paid"), F.lit(0)) < cents(F.col("promised_amount"))
    return due.join(paid, "id", "left").filter(short).select(
        F.lit("promise.broken").alias("event_type"), "invoice_id", as_of.alias("occurred_at"),
        F.create_map(F.lit("promise_id"), F.col("id").cast("string")).alias("payload"),
    )
