"""The live decision pass and its evaluation, each one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import lookup
from duewise.operators.context import decision_context
from duewise.operators.economics import decide, friction, probability_given, with_cause
from duewise.sources.tables import Domain, live_pool

ScoreFn = Callable[[DataFrame], DataFrame]


def live_context(d: Domain, score: ScoreFn, as_of: Column) -> DataFrame:
    """Open invoices with ledger and contact context, scores and predicted cause."""
    live = live_pool(d.invoices).withColumnRenamed("id", "invoice_id")
    context = decision_context(live, d.payments, d.actions, as_of)
    return with_cause(score(context)).withColumn("amount", F.col("amount").cast("double"))


def live_decisions(d: Domain, score: ScoreFn, as_of: Column, now_utc: Column) -> DataFrame:
    """One decision per open invoice. After the two context joins everything is a row expression."""
    return decide(live_context(d, score, as_of), now_utc)


def next_account_state(action: Column, is_paid: Column) -> Column:
    closed = F.when(is_paid, "closed_paid").otherwise("closed_abandoned")
    return F.when(action == "stop", closed).otherwise(lookup(action, P.ACTION_STATE))


def account_updates(decisions: DataFrame) -> DataFrame:
    """The account-state row each decision leads to; no promise score or expected date exists at this point."""
    return decisions.select(
        "invoice_id",
        next_account_state(F.col("final_action"), F.col("is_actually_paid")).alias("current_state"),
        F.col("base_probability").alias("recoverability_score"),
        F.lit(0.0).alias("promise_score"),
        F.lit(None).cast("date").alias("expected_payment_date"),
        (F.col("amount") * (1.0 - F.col("base_probability"))).alias("revenue_at_risk"),
        F.col("final_action").alias("next_action"),
    )


def strategies(decisions: DataFrame) -> DataFrame:
    """Both strategies over the same invoices: a reminder to everyone, and the engine's choice."""
    base = decisions.select("invoice_id", "base_probability", "amount", "final_action")
    both = F.array(
        F.struct(F.lit(P.BASELINE_STRATEGY).alias("strategy"), F.lit("email").alias("action")),
        F.struct(F.lit(P.ENGINE_STRATEGY).alias("strategy"), F.col("final_action").alias("action")),
    )
    return base.select("invoice_id", "base_probability", "amount", F.inline(both))


def _for_action(build: Callable[[str], Column]) -> Column:
    out = None
    for action in P.ACTIONS:
        out = F.when(F.col("action") == action, build(action)) if out is None else out.when(F.col("action") == action, build(action))
    return out


def strategy_summary(outcomes: DataFrame) -> DataFrame:
    """Counts, gross and net expected recovery per strategy, without contacts or cause nudge."""
    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    prob = _for_action(lambda a: probability_given(a, F.col("base_probability"), F.col("amount"), none, zero))
    valued = outcomes.select(
        "strategy", "action", "amount", (prob * F.col("amount")).alias("gross"),
        lookup(F.col("action"), {a: v[0] for a, v in P.ACTIONS.items()}).alias("cost"),
        _for_action(lambda a: friction(a, F.lit(0))).alias("friction"),
    )
    totals = valued.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_invoices"),
        F.count_if(~F.col("action").isin("wait", "stop")).alias("n_interventions"),
        F.count_if(F.col("action") == "wait").alias("n_wait"),
        F.count_if(F.col("action") == "stop").alias("n_stop"),
        F.sum("amount").alias("total_amount"),
        F.sum("gross").alias("gross_expected_recovered"),
        F.sum("cost").alias("total_cost"),
        F.sum("friction").alias("total_friction"),
    )
    names = outcomes.sparkSession.range(1).select(
        F.explode(F.array(F.lit(P.BASELINE_STRATEGY), F.lit(P.ENGINE_STRATEGY))).alias("strategy")
    )
    # A strategy without invoices still has its row, with zeros.
    totals = names.join(totals, "strategy", "left").na.fill(0)
    return totals.withColumns({
        "net_expected_recovered": F.col("gross_expected_recovered") - F.col("total_cost") - F.col("total_friction"),
        "recovery_rate": F.when(F.col("total_amount") != 0, F.col("gross_expected_recovered") / F.col("total_amount")).otherwise(0.0),
    })


def interventions_avoided(summary: DataFrame) -> DataFrame:
    """Invoices the baseline would have contacted and the engine left alone."""
    return summary.filter(F.col("strategy") == P.ENGINE_STRATEGY).select((F.col("n_wait") + F.col("n_stop")).alias("avoided"))


def evaluation_snapshot(summary: DataFrame) -> DataFrame:
    """The stored two-row comparison; the avoided count belongs to the engine row."""
    return summary.withColumn(
        "unnecessary_interventions_avoided",
        F.when(F.col("strategy") == P.ENGINE_STRATEGY, F.col("n_wait") + F.col("n_stop")),
    )


def escalation_check(decisions: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Diagnostic: share of escalations in archetypes where they truly help, and where they do not."""
    rows = decisions.filter(F.col("final_action") == "escalate").join(archetypes, "customer_id", "left")
    share = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("n_escalated"),
        share(F.col("archetype") == P.HIGH_ESCALATE_ARCHETYPE).alias("high_uplift_share"),
        share(F.col("archetype").isin(P.LOW_ESCALATE_ARCHETYPES)).alias("low_uplift_share"),
    )


def distributions(decisions: DataFrame) -> DataFrame:
    """Counts and shares of final action, policy result and next state."""
    state = next_account_state(F.col("final_action"), F.col("is_actually_paid"))
    labels = F.array(
        F.struct(F.lit("final_action").alias("dimension"), F.col("final_action").alias("value")),
        F.struct(F.lit("policy_result").alias("dimension"), F.col("policy_result").alias("value")),
        F.struct(F.lit("next_state").alias("dimension"), state.alias("value")),
    )
    counts = decisions.select(F.inline(labels)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dimension")))


def safety_checks(decisions: DataFrame, in_hours: Column) -> DataFrame:
    """One row of counts that must be zero, and the number of abandoned accounts."""
    sent = ~F.col("final_action").isin("wait", "stop")
    loud = F.col("final_action").isin(P.DISPUTE_EXCLUDED)
    p = F.col("base_probability")
    per_invoice = decisions.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sent & (F.col("policy_result") == "blocked")).alias("bypass"),
        F.count_if(sent & loud & ~in_hours).alias("late"),
        F.count_if(p.isNull()).alias("missing"),
        F.count_if(~p.between(P.PROBABILITY_FLOOR, P.PROBABILITY_CEILING)).alias("out"),
        F.count_if((F.col("final_action") == "stop") & ~F.col("is_actually_paid")).alias("abandoned"),
    )
    return per_invoice.agg(
        F.sum(F.col("n") - 1).alias("duplicate_invoices"), F.sum("bypass").alias("policy_bypass"),
        F.sum("late").alias("out_of_hours"), F.sum("missing").alias("missing_score"),
        F.sum("out").alias("score_out_of_bounds"), F.sum("abandoned").alias("abandoned"),
    )
