"""Decision logs: JSON shapes, labels, reasons, and reads from stored logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import lookup, to_ntz

_KEEP_NULLS = {"ignoreNullFields": "false"}


def candidate_json() -> Column:
    """Ranked candidates without the sort key."""
    return F.transform(
        "ranking",
        lambda c: F.struct(c["action_type"], c["probability"], c["cost"], c["friction"], c["expected_value"]),
    )


def batch_decision_logs(decisions: DataFrame, as_of: Column, cases: DataFrame | None = None) -> DataFrame:
    """Log rows of a batch pass. ``cases``: invoice_id, retrieved_cases (array of struct), bounded by top-k."""
    rows = decisions
    if cases is not None:
        rows = rows.join(cases, "invoice_id", "left")
        evidence = F.to_json(F.struct(F.coalesce(F.col("retrieved_cases"), F.array().cast(cases.schema["retrieved_cases"].dataType)).alias("retrieved_cases")))
    else:
        evidence = F.lit('{"retrieved_cases":[]}')
    cause = F.when(
        F.col("root_cause_label").isNotNull(),
        F.struct(F.col("root_cause_label").alias("predicted_label"), F.col("root_cause_confidence").alias("confidence")),
    )
    scores = F.struct(
        F.col("base_probability").alias("recovery_probability"), candidate_json().alias("candidate_actions"), cause.alias("root_cause")
    )
    checks = F.struct(
        "is_disputed", "is_actually_paid", "proposed_action", "final_action", F.col("policy_result").alias("result")
    )
    return rows.select(
        "invoice_id", F.col("final_action").alias("decision"), F.to_json(scores, _KEEP_NULLS).alias("model_scores"),
        evidence.alias("evidence"), F.to_json(checks).alias("policy_checks"), "reason", as_of.alias("timestamp"),
    )


def decision_label() -> Column:
    return F.coalesce(F.col("selected_action"), F.col("next_state"), F.lit("rejected"))


def decision_reason() -> Column:
    """Error first, then the policy verdict, then the recorded promise of a promise round."""
    moved = F.when(
        F.col("next_state").isNotNull() & F.col("event_type").startswith("promise."), F.concat(F.lit("promise recorded -- account moved to "), F.col("next_state"))
    )
    return F.coalesce(F.col("error"), F.col("policy_reason"), moved, F.lit("no assessment this round"))


def event_decision_logs(rounds: DataFrame) -> DataFrame:
    """Log rows of processed events, in the three shapes: full round, promise only, rejected.

    Scores keep their explicit nulls; keys a round never produced are absent. ``rounds`` holds NULL for those.
    """
    cause = F.when(
        F.col("root_cause_label").isNotNull(),
        F.struct(F.col("root_cause_label").alias("predicted_label"), F.col("root_cause_confidence").alias("confidence")),
    )
    always = F.to_json(
        F.struct(F.col("recovery_probability"), F.col("ptp_probability"), cause.alias("root_cause")), _KEEP_NULLS
    )
    base = F.to_json(F.struct(
        "is_disputed", "is_actually_paid", F.coalesce("state_transition_path", F.array().cast("array<string>")).alias("state_transition_path"),
        "retry_count", "error",
    ), _KEEP_NULLS)
    optional = F.to_json(F.struct("proposed_action", "selected_action", "policy_result", "tool_result"))
    evidence = F.struct(F.struct("event_type", "payload").alias("trigger_event"))
    return rounds.select(
        "event_id", "invoice_id", decision_label().alias("decision"), always.alias("model_scores"),
        F.to_json(evidence).alias("evidence"), merge_json(base, optional).alias("policy_checks"),
        decision_reason().alias("reason"), F.col("occurred_at").alias("timestamp"),
    )


def merge_json(first: Column, second: Column) -> Column:
    """Two flat JSON objects as one; the second may be empty."""
    return F.when(second == "{}", first).otherwise(
        F.concat(F.substring(first, F.lit(1), F.length(first) - 1), F.lit(","), F.substring(second, F.lit(2), F.length(second)))
    )


def failed_action_fallback(decisions: DataFrame, results: DataFrame) -> DataFrame:
    """Actions whose delivery failed fall back to waiting. ``results``: invoice_id, success, attempts."""
    rows = decisions.join(results, "invoice_id", "left")
    failed = ~F.col("selected_action").isin("wait", "stop") & ~F.coalesce(F.col("success"), F.lit(True))
    text = F.concat(
        F.col("selected_action"), F.lit(" failed after "), F.col("attempts").cast("string"), F.lit(" attempt(s), fell back to wait")
    )
    return rows.select(
        *[c for c in decisions.columns if c != "selected_action"],
        F.when(failed, F.lit("wait")).otherwise(F.col("selected_action")).alias("selected_action"),
        F.when(failed, text).alias("error"),
        F.when(failed | (~F.col("selected_action").isin("wait", "stop") & F.col("success")), F.col("attempts") - 1).alias("retry_count"),
    )


def rewrite_reasons(logs: DataFrame) -> DataFrame:
    """New wording for old reasons. Only the old forms match, so a second run changes nothing."""
    old_failure = r"^(\w+) failed after (\d+) attempt\(s\): .+$"
    reason = F.col("reason")
    fixed = F.regexp_replace(reason, old_failure, r"$1 failed after $2 attempt(s), fell back to wait")
    return logs.withColumn(
        "reason",
        F.when(reason == P.OLD_CLOSING_REASON, P.CLOSING_REASON).when(reason.rlike(old_failure), fixed).otherwise(reason),
    )


# Reads from stored logs


def parsed_logs(logs: DataFrame) -> DataFrame:
    path = lambda c, p: F.get_json_object(c, p)
    return logs.select(
        "*",
        path("model_scores", "$.recovery_probability").cast("double").alias("recovery_probability"),
        path("model_scores", "$.ptp_probability").cast("double").alias("ptp_probability"),
        path("model_scores", "$.root_cause").alias("root_cause"),
        path("evidence", "$.trigger_event.event_type").alias("trigger_event_type"),
        path("policy_checks", "$.policy_result").alias("policy_result"),
        F.coalesce(path("policy_checks", "$.is_actually_paid") == "true", F.lit(False)).alias("is_paid"),
        path("policy_checks", "$.error").alias("error"),
        F.from_json(path("policy_checks", "$.state_transition_path"), "array<string>").alias("state_transition_path"),
    )


def _has_score() -> Column:
    return F.col("recovery_probability").isNotNull() | F.col("ptp_probability").isNotNull() | F.col("root_cause").isNotNull()


def latest_log(logs: DataFrame) -> DataFrame:
    """Newest log per invoice by business time, then insert time. An aggregate, so a hot invoice combines map-side."""
    order = F.struct("timestamp", "created_at", "id")
    return logs.groupBy("invoice_id").agg(F.max_by(F.struct("id", "decision", "reason", "timestamp"), order).alias("l")).select("invoice_id", "l.*")


def decision_trace(logs: DataFrame) -> DataFrame:
    """Newest decision per invoice; scores come from the newest earlier log that has any when the newest is bare."""
    order = F.struct("timestamp", "created_at", "id")
    rows = parsed_logs(logs)
    body = F.struct("id", "decision", "reason", "timestamp", "policy_checks", "model_scores", "evidence", _has_score().alias("scored"))
    seen = rows.groupBy("invoice_id").agg(
        F.max_by(body, order).alias("newest"),
        F.max_by(F.when(_has_score(), body), F.when(_has_score(), order)).alias("scored"),
    )
    fall_back = ~F.col("newest.scored") & F.col("scored").isNotNull()
    return seen.select(
        "invoice_id", "newest.decision", "newest.reason", "newest.policy_checks", "newest.timestamp",
        F.when(fall_back, F.col("scored.model_scores")).otherwise(F.col("newest.model_scores")).alias("model_scores"),
        F.when(fall_back, F.col("scored.evidence")).otherwise(F.col("newest.evidence")).alias("evidence"),
        F.when(fall_back, F.col("scored.timestamp")).alias("assessed_at"),
    )


def timeline(logs: DataFrame, payments: DataFrame) -> DataFrame:
    """Decisions and payments of every invoice in one chronological list; decisions come first on equal times."""
    p = parsed_logs(logs)
    decided = p.select(
        "invoice_id", "timestamp", F.lit("decision").alias("type"), F.concat_ws(" -- ", "decision", "reason").alias("summary"),
        "trigger_event_type", "policy_result", "is_paid", "error", F.array_join("state_transition_path", ">").alias("path"),
        F.col("created_at").alias("_tie"),
    )
    note = lookup(F.col("method"), P.SYNTHETIC_PAYMENT_NOTES)
    head = F.concat(F.lit("Payment of Rs."), F.format_number(F.col("amount"), 2))
    at = to_ntz(F.col("payment_date"))
    paid = payments.select(
        "invoice_id", at.alias("timestamp"), F.lit("payment").alias("type"),
        F.when(note.isNotNull(), F.concat(head, F.lit(" -- "), note)).otherwise(F.concat(head, F.lit(" via "), F.col("method"))).alias("summary"),
        F.lit(None).cast("string").alias("trigger_event_type"), F.lit(None).cast("string").alias("policy_result"),
        F.lit(False).alias("is_paid"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("path"),
        at.alias("_tie"),
    )
    entries = decided.unionByName(paid)
    return entries.withColumn("round", round_label()).repartition("invoice_id").sortWithinPartitions("invoice_id", "timestamp", "type", "_tie", "summary").drop("_tie")


def round_label() -> Column:
    trigger = F.col("trigger_event_type")
    return (
        F.when(F.col("type") == "payment", "Payment")
        .when(F.col("is_paid"), "Safety closure")
        .when(F.col("error").isNotNull(), "Execution failure")
        .when(F.col("policy_result") == "blocked", "Policy block")
        .when(F.col("policy_result") == "escalated", "Escalated")
        .when(trigger == "promise.created", "Promise created")
        .when(trigger.isin("promise.broken", "review.timeout"), "Reassessment")
        .when(trigger == "customer.responded", "Customer response")
        .otherwise("Decision")
    )


def closing_logs(paid: DataFrame, logs: DataFrame) -> DataFrame:
    """One closing log per invoice in ``paid`` (invoice_id, payment_date), always after its newest existing log."""
    newest = logs.groupBy("invoice_id").agg(F.max("timestamp").alias("newest"))
    at = to_ntz(F.col("payment_date"))
    later = F.col("newest") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1))
    scores = '{"recovery_probability":null,"ptp_probability":null,"root_cause":null}'
    evidence = '{"trigger_event":{"event_type":"attribution.simulated_recovery","payload":{}}}'
    checks = (
        '{"is_disputed":false,"is_actually_paid":true,"selected_action":"stop","policy_result":"allowed",'
        '"state_transition_path":["closed_paid"]}'
    )
    return paid.join(newest, "invoice_id", "left").select(
        "invoice_id", F.lit("stop").alias("decision"), F.lit(scores).alias("model_scores"), F.lit(evidence).alias("evidence"),
        F.lit(checks).alias("policy_checks"), F.lit(P.CLOSING_REASON).alias("reason"),
        F.when(F.col("newest") >= at, later).otherwise(at).alias("timestamp"),
    )


def missing_closing_logs(payments: DataFrame, logs: DataFrame) -> DataFrame:
    """Write-back payments whose invoice has no closing log yet, one row per invoice: safe to run again."""
    written = payments.filter(F.col("method") == P.SIMULATED_PAYMENT_METHOD).groupBy("invoice_id").agg(
        F.min("payment_date").alias("payment_date")
    )
    closed = logs.filter(F.col("reason").contains(P.CLOSING_MARKER)).select("invoice_id")
    return closing_logs(written.join(closed, "invoice_id", "left_anti"), logs)
