"""Queries on economics, policy, the live decision pass and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import clip_probability, rnd
from duewise.operators import economics as E
from duewise.operators.context import decision_context, is_disputed
from duewise.plans import decisions as PD
from duewise.queries import sqldecisions  # noqa: F401
from duewise.queries.registry import query
from duewise.queries.sqlviews import NOW_UTC, SUNDAY_UTC, r, rr, sql
from duewise.sources.driver_tables import with_probability
from duewise.sources.tables import live_pool


def context(x):
    return PD.live_context(x.d, with_probability, x.as_of)


def decisions(x, now=None):
    return PD.live_decisions(x.d, with_probability, x.as_of, x.now_utc if now is None else now)


def ranked(x):
    return decisions(x).select("invoice_id", F.posexplode("ranking").alias("pos", "c")).select(
        "invoice_id", (F.col("pos") + 1).alias("rank"), "c.*"
    )


@query("O026_dispute_flag", sql("SELECT id, true_root_cause = 'dispute' AS is_disputed FROM invoices"))
def disputes(x):
    return x.d.invoices.select("id", is_disputed().alias("is_disputed"))


@query("O027_already_paid", sql("SELECT invoice_id, is_actually_paid FROM ctx"))
def already_paid(x):
    return context(x).select("invoice_id", "is_actually_paid")


@query("O028_business_hours", """SELECT event_id, isodow(t) <> 7 AND hour(t) >= 9 AND hour(t) < 19 AS in_hours
  FROM (SELECT event_id, ts + to_minutes(330) AS t FROM events)""")
def hours(x):
    now = F.col("ts").cast("timestamp_ntz")
    return x.raw("events").select("event_id", E.in_business_hours(now).alias("in_hours"))


_cand = f"SELECT invoice_id, action AS action_type, {{}} FROM cand"


@query("O029_action_uplift", sql(_cand.format(r("up") + " AS uplift")))
def uplift(x):
    per = F.array(*[
        F.struct(F.lit(a).alias("action_type"),
                 E.uplift(a, F.col("amount"), F.col("root_cause_label"), F.col("root_cause_confidence")).alias("uplift"))
        for a in P.CANDIDATE_ACTIONS
    ])
    rows = context(x).select("invoice_id", "is_disputed", F.inline(per))
    return rows.filter(~(F.col("is_disputed") & F.col("action_type").isin(P.DISPUTE_EXCLUDED))).drop("is_disputed")


@query("O030_probability_given_action", sql(_cand.format(r("probability") + " AS probability")))
def probability(x):
    return ranked(x).select("invoice_id", "action_type", "probability")


@query("O031_friction", sql(_cand.format(r("drag") + " AS friction")))
def frictions(x):
    return ranked(x).select("invoice_id", "action_type", "friction")


@query("O032_expected_value", sql(_cand.format(f"{r('cost')} AS cost, {r('ev', 4)} AS expected_value")))
def values(x):
    return ranked(x).select("invoice_id", "action_type", "cost", rnd(F.col("expected_value"), 4).alias("expected_value"))


@query("O033_materiality", sql(f"SELECT invoice_id, {r('greatest(50.0, 0.01 * amount)')} AS threshold FROM ctx"))
def threshold(x):
    return context(x).select("invoice_id", E.materiality(F.col("amount")).alias("threshold"))


@query("O034_policy", sql("SELECT invoice_id, proposed AS proposed_action, rule::BIGINT AS policy_rule, policy_result, final_action, reason FROM decided"))
def policy(x):
    return decisions(x).select("invoice_id", "proposed_action", "policy_rule", "policy_result", "final_action", "reason")


@query("O034_policy_sunday", sql("SELECT invoice_id, proposed AS proposed_action, rule::BIGINT AS policy_rule, policy_result, final_action, reason FROM decided_sunday"))
def policy_sunday(x):
    return decisions(x, x.sunday_utc).select("invoice_id", "proposed_action", "policy_rule", "policy_result", "final_action", "reason")


@query("O035_action_state", sql("SELECT invoice_id, final_action, next_state AS current_state FROM next_states"))
def action_state(x):
    return decisions(x).select(
        "invoice_id", "final_action", PD.next_account_state(F.col("final_action"), F.col("is_actually_paid")).alias("current_state")
    )


@query("O036_account_updates", sql(f"""SELECT invoice_id, next_state AS current_state, {r('base_probability', 4)} AS recoverability_score, 0.0::DOUBLE AS promise_score,
  NULL::VARCHAR AS expected_payment_date, {r('amount * (1.0::DOUBLE - base_probability)', 4)} AS revenue_at_risk, final_action AS next_action FROM next_states"""), digits=4)
def updates(x):
    return PD.account_updates(decisions(x))


@query("O037_probability_clip", f"SELECT event_id, {r('least(greatest(value / 300.0, 0.01), 0.99)')} AS p FROM events")
def clip(x):
    return x.raw("events").select(
        "event_id", clip_probability(F.col("value") / 300.0, P.PROBABILITY_FLOOR, P.PROBABILITY_CEILING).alias("p")
    )


@query("O038_root_cause_prediction", sql(f"SELECT invoice_id, cause AS root_cause_label, {r('cause_p')} AS root_cause_confidence FROM ctx"))
def cause(x):
    return context(x).select("invoice_id", "root_cause_label", "root_cause_confidence")


@query("O058_decision_context", sql(f"""SELECT invoice_id, {r('paid_cents / 100.0', 4)} AS paid_total, is_actually_paid, is_disputed,
  contacts::BIGINT AS prior_contact_count, {r('days_since', 4)} AS days_since_last_contact FROM ctx"""), digits=4)
def ledger_context(x):
    rows = live_pool(x.d.invoices).withColumnRenamed("id", "invoice_id")
    return decision_context(rows, x.d.payments, x.d.actions, x.as_of).select(
        "invoice_id", "paid_total", "is_actually_paid", "is_disputed", "prior_contact_count", "days_since_last_contact"
    )


@query("O062_candidate_expansion", sql("SELECT invoice_id, action AS action_type FROM cand"))
def expansion(x):
    return ranked(x).select("invoice_id", "action_type")


@query("O064_strategies", sql(f"SELECT invoice_id, strategy, action, {r('amount', 2)} AS amount, {r('base_probability', 2)} AS base_probability FROM outcomes"), digits=2)
def both(x):
    return PD.strategies(decisions(x))


_sum = f"""strategy, n_invoices, n_interventions, n_wait, n_stop,
  {rr('total_amount gross_expected_recovered total_cost total_friction net_expected_recovered', 2)}, {r('recovery_rate', 2)} AS recovery_rate"""


@query("O081_strategy_summary", sql(f"SELECT {_sum} FROM summary"), digits=2)
def summary(x):
    return PD.strategy_summary(PD.strategies(decisions(x)))


@query("O082_interventions_avoided", sql(f"SELECT n_wait + n_stop AS avoided FROM summary WHERE strategy = '{P.ENGINE_STRATEGY}'"))
def avoided(x):
    return PD.interventions_avoided(PD.strategy_summary(PD.strategies(decisions(x))))


@query("O083_escalation_check", sql(f"""SELECT count(*) AS n_escalated, {r("coalesce(avg((archetype = 'chronic_late')::INT), 0)")} AS high_uplift_share,
  {r("coalesce(avg((archetype IN ('reliable_payer', 'strategic_enterprise', 'already_paid_false_alarm'))::INT), 0)")} AS low_uplift_share
  FROM decided d JOIN customers c ON c.id = d.customer_id WHERE final_action = 'escalate'"""))
def escalation(x):
    truth = x.d.customers.select(F.col("id").alias("customer_id"), "archetype")
    return PD.escalation_check(decisions(x), truth)


_dist = " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, {col} AS value, count(*) AS n FROM next_states GROUP BY 2"
    for name, col in [("final_action", "final_action"), ("policy_result", "policy_result"), ("next_state", "next_state")]
)


@query("O097_decision_distribution", sql(f"SELECT dimension, value, n, {r('n / sum(n) OVER (PARTITION BY dimension)')} AS share FROM ({_dist})"))
def distribution(x):
    return PD.distributions(decisions(x))


@query("O101_action_ranking", sql(f"""SELECT invoice_id, row_number() OVER (PARTITION BY invoice_id ORDER BY ev DESC, cost, ordinal) AS rank, action AS action_type,
  {r('ev', 4)} AS expected_value FROM cand"""), digits=4)
def action_ranking(x):
    return ranked(x).select("invoice_id", "rank", "action_type", "expected_value")


@query("O102_recommendation", sql("SELECT invoice_id, proposed AS proposed_action FROM reco"))
def recommendation(x):
    return decisions(x).select("invoice_id", "proposed_action")


@query("O116_counterfactual_action", sql("SELECT invoice_id, final_action AS counterfactual_action FROM decided_cf"))
def counterfactual(x):
    return E.counterfactual(context(x), x.now_utc).select("invoice_id", "counterfactual_action")


def _safety(source: str, now: str) -> str:
    return f"""SELECT count(*) - count(DISTINCT invoice_id) AS duplicate_invoices,
  count(*) FILTER (final_action NOT IN ('wait', 'stop') AND policy_result = 'blocked') AS policy_bypass,
  count(*) FILTER (final_action IN ('voice', 'escalate') AND NOT {sqldecisions.hours_sql(now)}) AS out_of_hours, count(*) FILTER (base_probability IS NULL) AS missing_score,
  count(*) FILTER (base_probability < 0.01 OR base_probability > 0.99) AS score_out_of_bounds,
  count(*) FILTER (final_action = 'stop' AND NOT is_actually_paid) AS abandoned FROM {source}"""


@query("O157_decision_safety", sql(_safety("decided", NOW_UTC)))
def safety(x):
    return PD.safety_checks(decisions(x), E.in_business_hours(x.now_utc))


@query("O157_decision_safety_sunday", sql(_safety("decided_sunday", SUNDAY_UTC)))
def safety_sunday(x):
    return PD.safety_checks(decisions(x, x.sunday_utc), E.in_business_hours(x.sunday_utc))


@query("O171_baseline_vs_engine", sql(f"SELECT {_sum}, CASE WHEN strategy = '{P.ENGINE_STRATEGY}' THEN (n_wait + n_stop)::DOUBLE END AS unnecessary_interventions_avoided FROM summary"), digits=2)
def evaluation(x):
    snapshot = PD.evaluation_snapshot(PD.strategy_summary(PD.strategies(decisions(x))))
    return snapshot.withColumn("unnecessary_interventions_avoided", F.col("unnecessary_interventions_avoided").cast("double"))
