"""Feature tables: static invoice features, rolling history, labels and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import cents, floor_days, money, plus_days, ratio, to_ntz
from duewise.operators.history import history_facts, known_history, query_points, rolling_columns
from duewise.session import materialise
from duewise.sources.tables import Domain, live_pool, organic_history, visible_customers


def star(invoices: DataFrame, customers: DataFrame, merchants: DataFrame) -> DataFrame:
    """Invoice with its customer and merchant attributes. Join strategy is left to the planner's size checks."""
    c = visible_customers(customers).select(
        F.col("id").alias("customer_id"), "merchant_id", F.col("segment").alias("customer_segment"),
        F.col("industry").alias("customer_industry"), "relationship_start_date",
    )
    m = merchants.select(
        F.col("id").alias("merchant_id"), F.col("segment").alias("merchant_segment"),
        F.col("industry").alias("merchant_industry"),
    )
    return invoices.join(c, "customer_id").join(m, "merchant_id")


def paid_as_of(points: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments up to each cutoff, whatever their status. One row per invoice and day enters the join."""
    daily = payments.groupBy("invoice_id", "payment_date").agg(F.sum(cents(F.col("amount"))).alias("paid_cents"))
    asked = points.select("query_id", "invoice_id", "cutoff")
    return (
        asked.join(daily, "invoice_id")
        .filter(to_ntz(F.col("payment_date")) <= F.col("cutoff"))
        .groupBy("query_id").agg(F.sum("paid_cents").alias("paid_cents"))
    )


def static_features(rows: DataFrame) -> DataFrame:
    """Needs the star columns, ``cutoff`` and ``paid_cents``."""
    amount = F.col("amount").cast("double")
    outstanding = (cents(F.col("amount")) - F.coalesce(F.col("paid_cents"), F.lit(0)))
    relation = floor_days(to_ntz(F.col("relationship_start_date")), F.col("cutoff"))
    return rows.withColumns({
        "amount": amount,
        "amount_log1p": F.log1p(amount),
        "payment_term_days": F.datediff("due_date", "issue_date"),
        "issue_month": F.month("issue_date"),
        "issue_day_of_week": F.weekday("issue_date"),
        "customer_relationship_days_at_cutoff": F.when(relation >= 0, relation.cast("double")),
        "outstanding_amount": money(outstanding),
        "outstanding_ratio": ratio(money(outstanding), amount),
    })


def feature_rows(
    d: Domain, points: DataFrame, facts: DataFrame, *, keep: list[str], midnight: bool = True, own_may_be_known: bool = False,
) -> DataFrame:
    """Static and rolling features of the query points, with history drawn from ``facts``.

    A point carries its own columns through the history joins, so no join puts the two halves together again.
    """
    rows = star(points.join(paid_as_of(points, d.payments), "query_id", "left"), d.customers, d.merchants)
    known = known_history(rows, facts, midnight=midnight, own_may_be_known=own_may_be_known)
    features = [*P.NUMERIC_FEATURES, *P.CATEGORICAL_FEATURES]
    out = static_features(known).withColumns(rolling_columns())
    return out.select(*dict.fromkeys(["invoice_id", "customer_id", "merchant_id", *keep, *features]))


def stored_facts(d: Domain, invoices: DataFrame) -> DataFrame:
    """One narrow row per invoice, written once: every later step reads it instead of the raw tables."""
    return materialise(history_facts(invoices, d.promises, d.actions), "facts")


def recovery_features(d: Domain) -> DataFrame:
    """One row per resolved organic invoice, as of its due date, seeing only organic history."""
    facts = stored_facts(d, organic_history(d.invoices, d.payments))
    points = query_points(facts, to_ntz(F.col("due_date")))
    return feature_rows(d, points, facts, keep=["invoice_number", "due_date", "issue_date", "status", "paid_at"])


def live_features(d: Domain) -> DataFrame:
    """One row per open invoice, as of its due date, seeing all invoices of its customer."""
    facts = stored_facts(d, d.invoices)
    points = query_points(live_pool(facts), to_ntz(F.col("due_date")))
    return feature_rows(d, points, facts, keep=["invoice_number", "due_date", "issue_date", "status"])


def promise_cutoffs(promises: DataFrame, actions: DataFrame) -> DataFrame:
    """T: the last action on the promise's invoice, else a fixed lead before the promised date."""
    last = actions.groupBy("invoice_id").agg(F.max("timestamp").alias("last_action"))
    fallback = plus_days(to_ntz(F.col("promised_date")), -P.PROMISE_LEAD_FALLBACK_DAYS)
    return promises.join(last, "invoice_id", "left").select(
        *promises.columns, F.coalesce(F.col("last_action"), fallback).alias("T"),
        F.col("last_action").isNull().alias("is_fallback"),
    )


def _promise_points(promises: DataFrame, facts: DataFrame) -> DataFrame:
    p = promises.select(
        F.col("id").alias("promise_id"), "invoice_id", "promised_date", "source", F.col("status").alias("promise_status"), "T"
    )
    keep = ["promise_id", "promised_date", "source", "promise_status", "T"]
    return query_points(p.join(facts, "invoice_id"), F.col("T"), "promise_id", keep)


def promise_features(d: Domain) -> DataFrame:
    """One row per kept or broken promise on organic history, as of its cutoff T."""
    facts = stored_facts(d, organic_history(d.invoices, d.payments))
    closed = promise_cutoffs(d.promises.filter(F.col("status").isin("kept", "broken")), d.actions)
    points = _promise_points(closed, facts).withColumn("kept", (F.col("promise_status") == "kept").cast("int"))
    keep = ["promise_id", "T", "promised_date", "source", "kept"]
    return feature_rows(d, points, facts, keep=keep, midnight=False, own_may_be_known=True)


def live_promise_features(d: Domain, promises: DataFrame) -> DataFrame:
    """Features of just-made promises at ``T`` (their event time), seeing all invoices of the customer."""
    facts = stored_facts(d, d.invoices)
    keep = ["promise_id", "T", "promised_date", "source"]
    return feature_rows(d, _promise_points(promises, facts), facts, keep=keep, midnight=False, own_may_be_known=True)


# Labels


def delay_days(paid_at: str = "paid_at", due: str = "due_date") -> Column:
    return floor_days(to_ntz(F.col(due)), F.col(paid_at))


def recovery_label(horizon: int = P.HORIZON_DAYS) -> Column:
    inside = (F.col("status") == "paid") & (delay_days() <= horizon)
    return F.coalesce(inside, F.lit(False)).cast("int")


def eventually_paid() -> Column:
    return (F.col("status") == "paid").cast("int")


def root_cause_label() -> Column:
    """1 for cash-flow stress; a disputed row here is an error upstream."""
    cause = F.col("true_root_cause")
    wrong = F.raise_error(F.lit("root cause label asked for a disputed row")).cast("int")
    return F.when(cause.eqNullSafe("dispute"), wrong).otherwise(F.coalesce(cause == "cash_flow_stress", F.lit(False)).cast("int"))


def root_cause_table(d: Domain) -> DataFrame:
    causes = d.invoices.select(F.col("id").alias("invoice_id"), "true_root_cause")
    rows = recovery_features(d).join(causes, "invoice_id").filter(~F.col("true_root_cause").eqNullSafe("dispute"))
    return rows.withColumn("root_cause_label", root_cause_label()).drop("true_root_cause")


# Diagnostics (the only place that reads hidden truth)


def with_archetype(df: DataFrame, customers: DataFrame) -> DataFrame:
    truth = customers.select(F.col("id").alias("customer_id"), "archetype", "true_recovery_probability")
    return df.join(truth, "customer_id", "left")


def resolution_curve(d: Domain) -> DataFrame:
    """Cumulative share paid by day marks over resolved history, pooled (archetype NULL) and per archetype."""
    past = with_archetype(organic_history(d.invoices, d.payments), d.customers)
    paid = F.col("status") == "paid"
    marks = [(F.count_if(paid & (delay_days() <= m)) / F.count(F.lit(1))).alias(f"paid_by_{m}") for m in P.DAY_MARKS]
    pooled = [F.count(F.lit(1)).alias("n"), (F.count_if(F.col("status") == "written_off") / F.count(F.lit(1))).alias("written_off_rate")]
    return (
        past.groupingSets([[], ["archetype"]], "archetype").agg(F.grouping("archetype").alias("pooled"), *pooled, *marks)
        .filter((F.col("pooled") == 1) | F.col("archetype").isNotNull())
    )


def class_balance(curve: DataFrame, horizon: int = P.HORIZON_DAYS) -> DataFrame:
    """Label rate at the horizon against the allowed band; only the pooled row gates."""
    rate = F.col(f"paid_by_{horizon}")
    return curve.select(
        "archetype", "n", rate.alias("rate"), rate.between(P.CLASS_BALANCE_LOW, P.CLASS_BALANCE_HIGH).alias("passed"),
        (F.col("pooled") == 1).alias("gates"),
    )


def largest_divergence(features: DataFrame) -> DataFrame:
    """The customer whose recent payment rate is furthest from the full-history rate."""
    gap = F.abs(F.col("prior_payment_rate") - F.col("recent_90d_payment_rate"))
    return features.filter(gap.isNotNull()).agg(
        F.max_by("customer_id", F.struct(gap, -F.col("customer_id"))).alias("customer_id"), F.max(gap).alias("divergence")
    )


def busiest_customer(features: DataFrame, customers: DataFrame) -> DataFrame:
    """Per archetype, the customer with most rows; smallest id on ties."""
    sized = with_archetype(features, customers).groupBy("archetype", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    return sized.filter("archetype IS NOT NULL").groupBy("archetype").agg(
        F.max_by("customer_id", F.struct("n", -F.col("customer_id"))).alias("customer_id"), F.max("n").alias("n")
    )
