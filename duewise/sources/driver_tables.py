"""The star-schema test tables read as domain tables. Every value derives from the given rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from duewise import params as P
from duewise.functions.expr import hash_prefix, lookup, plus_days, rnd, to_ntz
from duewise.sources.tables import Domain

AS_OF = "2001-08-01 12:00:00"
NOW_UTC = "2001-08-01 06:30:00"
SUNDAY_UTC = "2001-08-05 06:30:00"  # out of hours

TERM_DAYS = {"1-URGENT": 30, "2-HIGH": 45, "3-MEDIUM": 60, "4-NOT SPECIFIED": 90, "5-LOW": 120}
STATUS = {"F": "paid", "P": "written_off", "O": "open"}
METHOD = {"R": P.SIMULATED_PAYMENT_METHOD, "A": "bank_transfer", "N": "upi"}
ACTION_OF_EVENT = {
    "click": "email", "error": "escalate", "purchase": "payment_link", "signup": "voice", "view": "whatsapp",
}
ACCOUNT_EVENT = {
    "signup": "promise.created", "purchase": "payment.received", "error": "promise.broken",
    "click": "customer.responded", "view": "review.timeout",
}
LOG_DECISION = {1: "wait", 2: "email", 3: "whatsapp", 4: "payment_link", 5: "voice", 6: "escalate", 7: "stop"}
LOG_STATE = {
    1: "wait", 2: "remind", 3: "remind", 4: "remind", 5: "remind", 6: "escalate", 7: "closed_paid",
}
INDUSTRY = ["retail", "manufacturing", "logistics", "healthcare", "technology"]
MERCHANT_SEGMENT = ["SMB", "Mid-Market", "Enterprise"]
STATE_CYCLE = ["wait", "remind", "escalate", "kept", "promise", "dispute_review", "overdue"]


def _decimal(cents_expr, precision: int = 12):
    return (cents_expr.cast("decimal(14,0)") / F.lit(100).cast("decimal(14,0)")).cast(f"decimal({precision},2)")


def _cents(price):
    return F.floor(price * 100.0 + 0.5).cast("bigint")


_SCHEMAS: dict[str, StructType] = {}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Schema inference opens a file footer; it is done once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read_raw(spark, sf_dir, "nation"), read_raw(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        key.cast("bigint").alias("id"),
        F.col("r_name").alias("industry"),
        lookup(key % 3, dict(enumerate(MERCHANT_SEGMENT))).alias("segment"),
        F.date_add(F.lit("1994-01-01").cast("date"), key).alias("relationship_start_date"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    arch = lookup(key % 8, dict(enumerate(P.ARCHETYPES)))
    return read_raw(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_nationkey").cast("bigint").alias("merchant_id"),
        F.col("c_name").alias("company_name"),
        lookup(key % 5, dict(enumerate(INDUSTRY))).alias("industry"),
        F.col("c_mktsegment").alias("segment"),
        F.date_add(F.lit("1995-01-01").cast("date"), (key % 730).cast("int")).alias("relationship_start_date"),
        arch.alias("archetype"),
        lookup(arch, {k: v[1] for k, v in P.ARCHETYPES.items()}).alias("true_recovery_probability"),
        lookup(arch, {k: v[2] for k, v in P.ARCHETYPES.items()}).alias("true_promise_keep_probability"),
    )


def _order_dates(orders: DataFrame) -> DataFrame:
    """The due date of an order, needed by several domain tables."""
    issue = F.col("o_orderdate").cast("date")
    return orders.select(
        "*", issue.alias("issue_date"), F.date_add(issue, lookup(F.col("o_orderpriority"), TERM_DAYS)).alias("due_date")
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = lookup(F.col("o_orderstatus"), STATUS)
    delay = (key * 7919 % 80).cast("int") - 5
    paid_at = plus_days(to_ntz(F.col("due_date")), delay) + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))
    kind = key % 100
    return _order_dates(read_raw(spark, sf_dir, "orders")).select(
        key.alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("INV-"), F.lpad(key.cast("string"), 10, "0")).alias("invoice_number"),
        _decimal(_cents(F.col("o_totalprice"))).alias("amount"),
        "issue_date",
        "due_date",
        status.alias("status"),
        F.when(F.col("o_orderstatus") == "F", paid_at).alias("paid_at"),
        F.when(kind < 6, "dispute").when(kind < 50, "cash_flow_stress").otherwise("oversight").alias("true_root_cause"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"),
        _decimal(_cents(F.col("l_extendedprice") * (1.0 - F.col("l_discount")))).alias("amount"),
        F.col("l_shipdate").cast("date").alias("payment_date"),
        lookup(F.col("l_returnflag"), METHOD).alias("method"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed").alias("status"),
    )


def _events_on_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive events touch one invoice."""
    events = read_raw(spark, sf_dir, "events")
    orders = _order_dates(read_raw(spark, sf_dir, "orders")).select(
        F.col("o_orderkey").alias("invoice_id"), "due_date", "o_totalprice"
    )
    keyed = events.withColumn("invoice_id", F.col("event_id") - F.col("event_id") % 3)
    return keyed.join(orders, "invoice_id")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    kind = lookup(F.col("event_type"), ACTION_OF_EVENT)
    cost = lookup(kind, {a: c for a, (c, _, _) in P.ACTIONS.items()})
    when = plus_days(to_ntz(F.col("due_date")), (key % 40).cast("int"))
    return _events_on_invoices(spark, sf_dir).select(
        key.alias("id"), "invoice_id", kind.alias("action_type"), F.col("value").alias("expected_value"),
        cost.cast("decimal(10,2)").alias("cost"), F.lit("allowed").alias("policy_result"), F.lit("sent").alias("result"),
        (when + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))).alias("timestamp"),
    )


def promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    created = plus_days(to_ntz(F.col("due_date")), (key % 10).cast("int"))
    share = (k + 1).cast("bigint")
    return (
        _events_on_invoices(spark, sf_dir)
        .filter(F.col("event_type").isin("signup", "error"))
        .select(
            key.alias("id"), "invoice_id",
            _decimal(F.floor(_cents(F.col("o_totalprice")) * share / 100.0).cast("bigint")).alias("promised_amount"),
            F.date_add(F.col("due_date"), k % 30 + 10).alias("promised_date"),
            F.when(key % 2 == 0, "voice").otherwise("email").alias("source"),
            (F.col("value") / 500.0).alias("confidence_score"),
            lookup(key % 3, {0: "kept", 1: "broken", 2: "open"}).alias("status"),
            created.alias("created_at"),
        )
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return read_raw(spark, sf_dir, "conversations").select(
        F.concat_ws(":", conv, turn).alias("id"),
        (conv * 13).cast("bigint").alias("customer_id"),
        F.when(turn % 2 == 0, (conv * 211 + turn).cast("bigint")).alias("invoice_id"),
        F.when(conv % 2 == 0, "email").otherwise("voice").alias("channel"),
        F.col("text").alias("content"),
        F.col("role").alias("intent"),
        F.lit("logged").alias("outcome"),
        F.lit(0).cast("decimal(10,2)").alias("cost"),
        plus_days(F.lit(AS_OF).cast("timestamp_ntz"), -turn.cast("int")).alias("timestamp"),
    )


def account_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = lookup(key % 7, dict(enumerate(STATE_CYCLE)))
    score = 0.05 + (key % 90) / 100.0
    return read_raw(spark, sf_dir, "orders").filter((key % 10 != 0) & (F.col("o_orderstatus") == "O")).select(
        key.alias("invoice_id"),
        state.alias("current_state"),
        score.alias("recoverability_score"),
        F.lit(0.0).alias("promise_score"),
        F.lit(None).cast("date").alias("expected_payment_date"),
        rnd(F.col("o_totalprice") * (1.0 - score), 2).alias("revenue_at_risk"),
        lookup(key % 6, dict(enumerate(P.CANDIDATE_ACTIONS))).alias("next_action"),
        plus_days(F.lit(AS_OF).cast("timestamp_ntz"), -(key % 6).cast("int")).alias("updated_at"),
    )


def decision_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored log per line item; every third line is a bare entry without scores."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    part = F.col("l_partkey")
    stamp = to_ntz(F.col("l_shipdate")) + F.make_dt_interval(F.lit(0), line)
    scored = F.when(line % 3 != 0, (part % 100) / 100.0)
    decision, state = lookup(line, LOG_DECISION), lookup(line, LOG_STATE)
    result = F.when(line == 6, "escalated").when(part % 5 == 0, "blocked").otherwise("allowed")
    error = F.when(part % 11 == 0, F.concat(decision, F.lit(" failed after 2 attempt(s): gateway error")))
    trigger = lookup(part % 4, {0: "invoice.overdue", 1: "promise.broken", 2: "review.timeout", 3: "promise.created"})
    return read_raw(spark, sf_dir, "lineitem").select(
        F.md5(F.concat_ws(":", key, line, part, F.col("l_suppkey"), F.col("l_extendedprice").cast("bigint"))).alias("id"),
        key.alias("invoice_id"),
        decision.alias("decision"),
        F.to_json(F.struct(
            scored.alias("recovery_probability"), F.lit(None).cast("double").alias("ptp_probability"),
            F.lit(None).cast("string").alias("root_cause"),
        ), {"ignoreNullFields": "false"}).alias("model_scores"),
        F.to_json(F.struct(F.struct(trigger.alias("event_type")).alias("trigger_event"))).alias("evidence"),
        F.to_json(F.struct(
            (line == 7).alias("is_actually_paid"), F.array(state).alias("state_transition_path"),
            result.alias("policy_result"), error.alias("error"),
        )).alias("policy_checks"),
        F.coalesce(error, F.when(line == 7, P.OLD_CLOSING_REASON).otherwise(P.REASON_ALLOWED)).alias("reason"),
        stamp.alias("timestamp"),
        (stamp + F.make_dt_interval(F.lit(0), F.lit(0), (part % 60).cast("int"))).alias("created_at"),
    )


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream: one account per user."""
    return account_events_from(read_raw(spark, sf_dir, "events"))


def account_events_from(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        lookup(F.col("event_type"), ACCOUNT_EVENT).alias("event_type"),
        F.col("user_id").alias("invoice_id"),
        to_ntz(F.col("ts")).alias("occurred_at"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("payload"),
        "value",
    )


def with_probability(df: DataFrame, key: str = "invoice_id") -> DataFrame:
    """The given probability columns of the test tables: recovery and root cause."""
    return df.select(
        "*",
        (0.05 + (F.col(key) % 90) / 100.0).alias("base_probability"),
        ((F.col(key) * 31 % 100) / 100.0).alias("cash_flow_probability"),
    )


def outcome_draws(df: DataFrame, key: str = "invoice_id") -> DataFrame:
    """Given outcomes of the experiment: recovered at all, and after how many days."""
    drawn = hash_prefix(F.concat(F.lit("outcome:"), F.col(key).cast("string")), 8)
    return df.select(
        "*", (drawn % 100 < 70).alias("recovered_ever"), F.when(drawn % 100 < 70, (drawn % 97).cast("int")).alias("true_delay_days")
    )


LOADERS = {
    "merchants": merchants, "customers": customers, "invoices": invoices, "payments": payments, "promises": promises,
    "actions": actions, "interactions": interactions, "account_state": account_state,
    "decision_logs": decision_logs, "account_events": account_events,
}


def load(spark: SparkSession, sf_dir: str) -> Domain:
    return Domain(lambda table: LOADERS[table](spark, sf_dir))
