"""Economics, policy and evaluation on hand-built rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duewise.operators import economics as E
from duewise.plans import decisions as PD

NOON = dt.datetime(2026, 8, 24, 6, 30)
SUNDAY = dt.datetime(2026, 8, 23, 6, 30)
SCHEMA = (
    "invoice_id BIGINT, base_probability DOUBLE, amount DOUBLE, prior_contact_count INT, is_disputed BOOLEAN, is_actually_paid BOOLEAN, "
    "root_cause_label STRING, root_cause_confidence DOUBLE, days_since_last_contact DOUBLE, proposed STRING, now TIMESTAMP_NTZ"
)
DEFAULT = dict(
    invoice_id=1, base_probability=0.5, amount=50_000.0, prior_contact_count=0, is_disputed=False, is_actually_paid=False,
    root_cause_label=None, root_cause_confidence=None, days_since_last_contact=None, proposed="email", now=NOON,
)


def frame(spark, *rows):
    return spark.createDataFrame([tuple({**DEFAULT, **row}.values()) for row in rows], SCHEMA)


CASES = [
    ({"is_actually_paid": True}, 1, "stop", "blocked"),
    ({"is_disputed": True, "proposed": "voice"}, 2, "wait", "blocked"),
    ({"proposed": "wait", "amount": 3_000.0}, 3, "stop", "blocked"),
    ({"prior_contact_count": 5}, 4, "stop", "blocked"),
    ({"days_since_last_contact": 2.0}, 5, "wait", "blocked"),
    ({"proposed": "voice", "now": SUNDAY}, 6, "wait", "blocked"),
    ({"proposed": "escalate", "amount": 200_000.0}, 7, "escalate", "escalated"),
    ({}, 8, "email", "allowed"),
    ({"is_disputed": True, "proposed": "wait", "amount": 3_000.0}, 8, "wait", "allowed"),
    ({"days_since_last_contact": 3.0}, 8, "email", "allowed"),
    ({"proposed": "wait", "amount": 4_000.0}, 8, "wait", "allowed"),
    ({"is_actually_paid": True, "is_disputed": True, "proposed": "escalate"}, 1, "stop", "blocked"),
]


def test_policy_rules_in_order(spark):
    rows = frame(spark, *[{**c[0], "invoice_id": i} for i, c in enumerate(CASES)])
    action = F.col("proposed")
    got = rows.withColumn("rule", E.policy_rule(action, F.col("now"))).withColumns(E.policy_outcome(F.col("rule"), action)).orderBy("invoice_id").collect()
    for row, (_, rule, final, result) in zip(got, CASES):
        assert (row.rule, row.final_action, row.policy_result) == (rule, final, result), row
    assert got[4].reason == "cooldown active -- contacted 2d ago, minimum 3d"


@pytest.mark.parametrize("utc, open_", [
    (dt.datetime(2026, 8, 24, 3, 29), False), (dt.datetime(2026, 8, 24, 3, 30), True), (dt.datetime(2026, 8, 24, 13, 29), True),
    (dt.datetime(2026, 8, 24, 13, 30), False), (SUNDAY, False), (dt.datetime(2026, 8, 22, 18, 40), False),
])
def test_business_hours_are_in_the_business_zone(spark, utc, open_):
    row = spark.createDataFrame([(utc,)], "t TIMESTAMP_NTZ").select(E.in_business_hours(F.col("t"))).first()
    assert row[0] is open_


def test_published_example(spark):
    best = E.decide(frame(spark, {"amount": 300_000.0}), F.col("now")).first().ranking
    assert best[0].action_type == "voice" and best[0].expected_value == pytest.approx(164_780)
    assert [c.action_type for c in best][4] == "escalate" and best[4].expected_value == pytest.approx(152_270)


def test_disputes_lose_the_loud_actions_and_stop_is_never_proposed(spark):
    a, b = E.decide(frame(spark, {}, {"invoice_id": 2, "is_disputed": True}), F.col("now")).orderBy("invoice_id").collect()
    assert {c.action_type for c in a.ranking} == {"wait", "email", "whatsapp", "payment_link", "voice", "escalate"}
    assert {c.action_type for c in b.ranking} == {"wait", "email", "whatsapp", "payment_link"}


def test_small_edges_wait_and_nudges_need_confidence(spark):
    small = E.decide(frame(spark, {"amount": 500.0}), F.col("now")).first()
    assert small.proposed_action == "wait"
    rows = [dict(amount=10_000.0, root_cause_label="cash_flow_stress", root_cause_confidence=c, invoice_id=i) for i, c in enumerate([0.59, 0.6])]
    low, high = E.decide(frame(spark, *rows), F.col("now")).orderBy("invoice_id").collect()
    p = lambda r: next(c.probability for c in r.ranking if c.action_type == "payment_link")
    assert p(low) == pytest.approx(0.53) and p(high) == pytest.approx(0.545)


def test_contacts_raise_friction_and_probability_is_clipped(spark):
    rows = frame(spark, {"prior_contact_count": 2, "base_probability": 0.999}, {"invoice_id": 2, "prior_contact_count": -1})
    a, b = E.decide(rows, F.col("now")).orderBy("invoice_id").collect()
    assert next(c.friction for c in a.ranking if c.action_type == "voice") == 40.0 and max(c.probability for c in a.ranking) == 0.99
    assert next(c.friction for c in b.ranking if c.action_type == "voice") == 20.0


def test_counterfactual_ignores_context_and_keeps_columns(spark):
    rows = frame(spark, {"prior_contact_count": 9, "is_disputed": True, "is_actually_paid": True})
    out = E.counterfactual(rows, F.col("now"))
    assert out.columns == [*rows.columns, "counterfactual_action"]
    row = out.first()
    assert row.prior_contact_count == 9 and row.is_disputed and row.counterfactual_action not in ("stop", "wait")


def test_empty_evaluation_gives_no_error(spark):
    decided = E.decide(frame(spark, {}), F.col("now"))
    empty = PD.strategy_summary(PD.strategies(decided.filter("invoice_id < 0"))).collect()
    assert [(r.n_invoices, r.recovery_rate) for r in empty] == [(0, 0.0), (0, 0.0)]
    check = PD.escalation_check(decided.withColumn("customer_id", F.lit(1)).filter("invoice_id < 0"), spark.createDataFrame([(1, "chronic_late")], "customer_id INT, archetype STRING")).first()
    assert (check.n_escalated, check.high_uplift_share) == (0, 0.0)


def test_stop_closes_by_payment(spark):
    rows = spark.createDataFrame([("stop", True), ("stop", False), ("voice", False), ("escalate", True), ("wait", False)], "a STRING, p BOOLEAN")
    got = [r[0] for r in rows.select(PD.next_account_state(F.col("a"), F.col("p"))).collect()]
    assert got == ["closed_paid", "closed_abandoned", "remind", "escalate", "wait"]


def test_baseline_emails_everyone(spark):
    decided = E.decide(frame(spark, {"amount": 10_000.0}), F.col("now"))
    base = PD.strategy_summary(PD.strategies(decided)).filter("strategy LIKE 'Baseline%'").first()
    assert base.gross_expected_recovered == pytest.approx(0.515 * 10_000) and base.total_cost == 5.0 and base.total_friction == 2.0
