"""DuckDB views for the decision steps."""

from __future__ import annotations

from duewise import params as P
from duewise.queries.sqlviews import AS_OF, NOW_UTC, SUNDAY_UTC, fdays, view

BASE_P = "(0.05::DOUBLE + (i.id % 90)::DOUBLE / 100.0)"
CASH_P = "((i.id * 31 % 100)::DOUBLE / 100.0)"

_values = ", ".join(
    f"('{a}', {P.ACTIONS[a][0]}::DOUBLE, {P.ACTIONS[a][1]}::DOUBLE, {P.ACTIONS[a][2]}::DOUBLE, {n})"
    for n, a in enumerate(P.CANDIDATE_ACTIONS)
)
view("action_params", f"SELECT * FROM (VALUES {_values}, ('stop', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 6)) t(action, cost, uplift, friction, ordinal)")

view("ctx", f"""SELECT i.id AS invoice_id, i.customer_id, i.cents / 100.0 AS amount, i.cents, i.due_date, {BASE_P} AS base_probability,
  {CASH_P} AS cash_p, i.true_root_cause = 'dispute' AS is_disputed, coalesce(p.cents, 0) AS paid_cents,
  coalesce(p.cents, 0) >= i.cents AS is_actually_paid, coalesce(a.n, 0) AS contacts,
  {fdays('a.last', AS_OF)} AS days_since,
  CASE WHEN i.true_root_cause <> 'dispute' THEN CASE WHEN {CASH_P} >= 0.5 THEN 'cash_flow_stress' ELSE 'oversight' END END AS cause,
  CASE WHEN i.true_root_cause <> 'dispute' THEN CASE WHEN {CASH_P} >= 0.5 THEN {CASH_P} ELSE 1.0::DOUBLE - {CASH_P} END END AS cause_p
  FROM live i LEFT JOIN (SELECT invoice_id, sum(cents) AS cents FROM payments WHERE payment_date <= {AS_OF} GROUP BY 1) p ON p.invoice_id = i.id
  LEFT JOIN (SELECT invoice_id, count(*) AS n, max(timestamp) AS last FROM actions GROUP BY 1) a ON a.invoice_id = i.id""")


def candidate_sql(source: str, contacts: str, cause: str, cause_p: str, disputed: str) -> str:
    nudge = " ".join(
        f"WHEN {cause} = '{c}' AND action = '{a}' AND {cause_p} >= {P.CAUSE_CONFIDENCE} THEN {n}::DOUBLE"
        for (c, a), n in P.CAUSE_NUDGE.items()
    )
    return f"""SELECT *, probability * amount - cost - drag AS ev FROM (
      SELECT *, least(greatest(base_probability + up * (1.0::DOUBLE - base_probability), 0.01::DOUBLE), 0.99::DOUBLE) AS probability FROM (
        SELECT c.*, a.action, a.cost, a.ordinal, a.friction * (1.0::DOUBLE + 0.5::DOUBLE * greatest({contacts}, 0)) AS drag,
        (CASE WHEN a.action = 'escalate' AND c.amount >= 100000 THEN 0.02::DOUBLE ELSE a.uplift END) + (CASE {nudge} ELSE 0.0::DOUBLE END) AS up
        FROM {source} c, action_params a WHERE a.action <> 'stop' AND NOT ({disputed} AND a.action IN ('voice', 'escalate'))))"""


def recommend_sql(candidates: str) -> str:
    return f"""SELECT * EXCLUDE (rn, wait_ev), CASE WHEN ev - wait_ev < greatest(50.0, 0.01 * amount) THEN 'wait' ELSE action END AS proposed FROM (
      SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY ev DESC, cost, ordinal) AS rn,
      max(ev) FILTER (action = 'wait') OVER (PARTITION BY invoice_id) AS wait_ev FROM {candidates}) WHERE rn = 1"""


def hours_sql(now: str) -> str:
    local = f"({now} + to_minutes(330))"
    return f"(isodow({local}) <> 7 AND hour({local}) >= 9 AND hour({local}) < 19)"


def policy_sql(source: str, paid: str, disputed: str, contacts: str, days: str, now: str = NOW_UTC) -> str:
    hours = hours_sql(now)
    contact = "proposed IN ('email', 'whatsapp', 'payment_link', 'voice', 'escalate')"
    loud = "proposed IN ('voice', 'escalate')"
    rule = f"""CASE WHEN {paid} THEN 1 WHEN {disputed} AND {loud} THEN 2
      WHEN proposed = 'wait' AND NOT {disputed} AND base_probability * amount < 2000 THEN 3
      WHEN {contacts} >= 5 AND {contact} THEN 4 WHEN {days} IS NOT NULL AND {days} < 3 AND {contact} THEN 5
      WHEN {loud} AND NOT {hours} THEN 6 WHEN amount >= 200000 AND proposed = 'escalate' THEN 7 ELSE 8 END"""
    return f"""SELECT *, CASE WHEN rule <= 6 THEN 'blocked' WHEN rule = 7 THEN 'escalated' ELSE 'allowed' END AS policy_result,
      CASE WHEN rule IN (1, 3, 4) THEN 'stop' WHEN rule IN (2, 5, 6) THEN 'wait' ELSE proposed END AS final_action,
      CASE rule WHEN 1 THEN '{P.REASON_PAID}' WHEN 2 THEN '{P.REASON_DISPUTE}' WHEN 3 THEN '{P.REASON_SMALL}' WHEN 4 THEN '{P.REASON_MAX_CONTACTS}'
        WHEN 5 THEN 'cooldown active -- contacted ' || ({days})::BIGINT || 'd ago, minimum 3d' WHEN 6 THEN '{P.REASON_HOURS}'
        WHEN 7 THEN '{P.REASON_APPROVAL}' ELSE '{P.REASON_ALLOWED}' END AS reason
      FROM (SELECT *, {rule} AS rule FROM {source})"""


view("cand", candidate_sql("ctx", "c.contacts", "cause", "cause_p", "c.is_disputed"))
view("reco", recommend_sql("cand"))
view("decided", policy_sql("reco", "is_actually_paid", "is_disputed", "contacts", "days_since"))
view("decided_sunday", policy_sql("reco", "is_actually_paid", "is_disputed", "contacts", "days_since", SUNDAY_UTC))
view("cand_cf", candidate_sql("ctx", "0", "NULL", "0.0", "false"))
view("reco_cf", recommend_sql("cand_cf"))
view("decided_cf", policy_sql("reco_cf", "false", "false", "0", "NULL::DOUBLE"))
view("next_states", """SELECT *, CASE WHEN final_action = 'stop' THEN CASE WHEN is_actually_paid THEN 'closed_paid' ELSE 'closed_abandoned' END
  WHEN final_action = 'wait' THEN 'wait' WHEN final_action = 'escalate' THEN 'escalate' ELSE 'remind' END AS next_state FROM decided""")
view("outcomes", f"""SELECT invoice_id, base_probability, amount, '{P.BASELINE_STRATEGY}' AS strategy, 'email' AS action FROM decided
  UNION ALL SELECT invoice_id, base_probability, amount, '{P.ENGINE_STRATEGY}', final_action FROM decided""")
view("summary", """SELECT strategy, count(*) AS n_invoices, count(*) FILTER (action NOT IN ('wait', 'stop')) AS n_interventions,
  count(*) FILTER (action = 'wait') AS n_wait, count(*) FILTER (action = 'stop') AS n_stop, sum(amount) AS total_amount,
  sum(gross) AS gross_expected_recovered, sum(cost) AS total_cost, sum(drag) AS total_friction,
  sum(gross) - sum(cost) - sum(drag) AS net_expected_recovered, coalesce(sum(gross) / nullif(sum(amount), 0), 0) AS recovery_rate
  FROM (SELECT o.strategy, o.action, o.amount, a.cost, a.friction AS drag, least(greatest(o.base_probability +
    (CASE WHEN o.action = 'escalate' AND o.amount >= 100000 THEN 0.02 ELSE a.uplift END) * (1 - o.base_probability), 0.01), 0.99) * o.amount AS gross
    FROM outcomes o JOIN action_params a ON a.action = o.action) GROUP BY 1""")
