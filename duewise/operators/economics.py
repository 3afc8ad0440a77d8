"""Expected value of candidate actions and the ordered policy, as row expressions: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import clip_probability, fixed, lookup


def uplift(action: str, amount: Column, cause: Column, confidence: Column) -> Column:
    base = F.lit(P.ACTIONS[action][1])
    if action == "escalate":
        base = F.when(amount >= P.LARGE_ESCALATE_AMOUNT, P.LARGE_ESCALATE_UPLIFT).otherwise(base)
    for (label, target), nudge in P.CAUSE_NUDGE.items():
        if target == action:
            sure = F.coalesce((cause == label) & (confidence >= P.CAUSE_CONFIDENCE), F.lit(False))
            base = base + F.when(sure, nudge).otherwise(0.0)
    return base


def probability_given(action: str, p: Column, amount: Column, cause: Column, confidence: Column) -> Column:
    raw = p + uplift(action, amount, cause, confidence) * (1.0 - p)
    return clip_probability(raw, P.PROBABILITY_FLOOR, P.PROBABILITY_CEILING)


def friction(action: str, contacts: Column) -> Column:
    return F.lit(P.ACTIONS[action][2]) * (1.0 + P.FRICTION_GROWTH * F.greatest(contacts, F.lit(0)))


def candidate(action: str, p, amount, contacts, cause, confidence) -> Column:
    """Sort key first: best value, then cheaper, then candidate order."""
    prob = probability_given(action, p, amount, cause, confidence)
    cost, drag = F.lit(P.ACTIONS[action][0]), friction(action, contacts)
    value = prob * amount - cost - drag
    return F.struct(
        (-value).alias("rank_key"), cost.alias("cost"), F.lit(P.CANDIDATE_ACTIONS.index(action)).alias("ordinal"),
        F.lit(action).alias("action_type"), prob.alias("probability"), drag.alias("friction"), value.alias("expected_value"),
    )


def ranking(p: Column, amount: Column, contacts: Column, disputed: Column, cause: Column, confidence: Column) -> Column:
    """All candidate actions of a row, best first."""
    one = lambda a: candidate(a, p, amount, contacts, cause, confidence)
    calm = [one(a) for a in P.CANDIDATE_ACTIONS if a not in P.DISPUTE_EXCLUDED]
    full = [one(a) for a in P.CANDIDATE_ACTIONS]
    return F.sort_array(F.when(disputed, F.array(*calm)).otherwise(F.array(*full)))


def materiality(amount: Column) -> Column:
    return F.greatest(F.lit(P.MATERIALITY_FLOOR), P.MATERIALITY_FRACTION * amount)


def recommended(ranked: Column, p: Column, amount: Column) -> Column:
    """Top action, unless its edge over waiting is immaterial."""
    wait_value = clip_probability(p, P.PROBABILITY_FLOOR, P.PROBABILITY_CEILING) * amount
    top = ranked[0]
    thin = top["expected_value"] - wait_value < materiality(amount)
    return F.when(thin, F.lit("wait")).otherwise(top["action_type"])


def in_business_hours(now_utc: Column) -> Column:
    local = now_utc + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(P.BUSINESS_OFFSET_MINUTES))
    hour = F.hour(local)
    return (F.weekday(local) != P.SUNDAY) & (hour >= P.BUSINESS_START_HOUR) & (hour < P.BUSINESS_END_HOUR)


def policy_rule(action: Column, now_utc: Column) -> Column:
    """Number of the first rule that applies; needs the decision context columns."""
    amount, p = F.col("amount"), F.col("base_probability")
    disputed = F.col("is_disputed")
    contact = action.isin(P.CONTACT_ACTIONS)
    loud = action.isin(P.DISPUTE_EXCLUDED)
    return (
        F.when(F.col("is_actually_paid"), 1)
        .when(disputed & loud, 2)
        .when((action == "wait") & ~disputed & (p * amount < P.MIN_PURSUIT_VALUE), 3)
        .when((F.col("prior_contact_count") >= P.MAX_CONTACTS) & contact, 4)
        .when(F.col("days_since_last_contact").isNotNull() & (F.col("days_since_last_contact") < P.COOLDOWN_DAYS) & contact, 5)
        .when(loud & ~in_business_hours(now_utc), 6)
        .when((amount >= P.HUMAN_APPROVAL_AMOUNT) & (action == "escalate"), 7)
        .otherwise(8)
    )


def policy_outcome(rule: Column, action: Column) -> dict[str, Column]:
    waited = F.concat(
        F.lit("cooldown active -- contacted "), F.col("days_since_last_contact").cast("bigint").cast("string"),
        F.lit(f"d ago, minimum {P.COOLDOWN_DAYS}d"),
    )
    reasons = {1: P.REASON_PAID, 2: P.REASON_DISPUTE, 3: P.REASON_SMALL, 4: P.REASON_MAX_CONTACTS,
               6: P.REASON_HOURS, 7: P.REASON_APPROVAL, 8: P.REASON_ALLOWED}
    return {
        "policy_result": F.when(rule <= 6, "blocked").when(rule == 7, "escalated").otherwise("allowed"),
        "final_action": F.when(rule.isin(1, 3, 4), "stop").when(rule.isin(2, 5, 6), "wait").otherwise(action),
        "reason": F.when(rule == 5, waited).otherwise(lookup(rule, reasons)),
    }


def with_cause(df: DataFrame) -> DataFrame:
    """Predicted cause and its confidence, only where the invoice is not disputed."""
    p = F.col("cash_flow_probability")
    clear = ~F.col("is_disputed")
    return df.select(
        "*",
        F.when(clear, F.when(p >= 0.5, "cash_flow_stress").otherwise("oversight")).alias("root_cause_label"),
        F.when(clear, F.when(p >= 0.5, p).otherwise(1.0 - p)).alias("root_cause_confidence"),
    )


def decide(context: DataFrame, now_utc: Column) -> DataFrame:
    """Rank, recommend and gate each row. ``context`` holds the policy inputs and the root-cause columns."""
    p, amount = F.col("base_probability"), F.col("amount")
    ranked = ranking(
        p, amount, F.col("prior_contact_count"), F.col("is_disputed"), F.col("root_cause_label"), F.col("root_cause_confidence")
    )
    rows = fixed(context, ranking=ranked)
    rows = fixed(rows, proposed_action=recommended(F.col("ranking"), p, amount))
    action = F.col("proposed_action")
    rows = fixed(rows, policy_rule=policy_rule(action, now_utc))
    return rows.withColumns(policy_outcome(F.col("policy_rule"), action))


def counterfactual(df: DataFrame, now_utc: Column, out: str = "counterfactual_action") -> DataFrame:
    """What the engine would do for a clean invoice: no contacts, no cause, no dispute, not paid."""
    clean = {
        "is_disputed": F.lit(False), "is_actually_paid": F.lit(False), "prior_contact_count": F.lit(0),
        "days_since_last_contact": F.lit(None).cast("double"), "root_cause_label": F.lit(None).cast("string"),
        "root_cause_confidence": F.lit(None).cast("double"),
    }
    kept = {c: F.col(c).alias(f"_keep_{c}") for c in clean if c in df.columns}
    decided = decide(df.select("*", *kept.values()).withColumns(clean), now_utc)
    back = [F.col(f"_keep_{c}").alias(c) if c in kept else F.col(c) for c in df.columns]
    return decided.select(*back, F.col("final_action").alias(out))
