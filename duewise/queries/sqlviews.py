"""DuckDB views for the checks: the domain tables and shared steps written independently in SQL."""

from __future__ import annotations

import re

from duewise import params as P
from duewise.sources import driver_tables as D

VIEWS: dict[str, str] = {}
AS_OF = f"TIMESTAMP '{D.AS_OF}'"
NOW_UTC = f"TIMESTAMP '{D.NOW_UTC}'"
SUNDAY_UTC = f"TIMESTAMP '{D.SUNDAY_UTC}'"


def r(expr: str, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits} + 0.5) / 1e{digits}"


def rr(names: str, digits: int = 6) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names.split())


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def case(expr: str, table: dict, default: str = "NULL") -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {expr} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + f" ELSE {default} END"


def fdays(start: str, end: str) -> str:
    return f"floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0)"


def md5_prefix(text: str, digits: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def view(name: str, body: str) -> None:
    VIEWS[name] = body


def sql(body: str) -> str:
    """Put the views that ``body`` needs, directly or not, in front of it."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    ordered = [n for n in VIEWS if n in needed]
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered) + "\n" + body


_money = lambda cents: f"(({cents}) / 100.0)::DECIMAL(12,2)"
_price = "floor(o_totalprice * 100.0 + 0.5)::BIGINT"

view("merchants", f"""SELECT n_nationkey::BIGINT AS id, r_name AS industry,
  {case('n_nationkey % 3', dict(enumerate(D.MERCHANT_SEGMENT)))} AS segment,
  DATE '1994-01-01' + n_nationkey::INT AS relationship_start_date
  FROM nation JOIN region ON n_regionkey = r_regionkey""")

view("customers", f"""SELECT c_custkey AS id, c_nationkey::BIGINT AS merchant_id, c_name AS company_name,
  {case('c_custkey % 5', dict(enumerate(D.INDUSTRY)))} AS industry, c_mktsegment AS segment,
  DATE '1995-01-01' + (c_custkey % 730)::INT AS relationship_start_date,
  {case('c_custkey % 8', dict(enumerate(P.ARCHETYPES)))} AS archetype,
  {case('c_custkey % 8', {i: v[1] for i, v in enumerate(P.ARCHETYPES.values())})}::DOUBLE AS true_recovery_probability
  FROM customer""")

view("dated_orders", f"""SELECT *, o_orderdate::DATE AS issue_date,
  o_orderdate::DATE + {case('o_orderpriority', D.TERM_DAYS)} AS due_date FROM orders""")

view("invoices", f"""SELECT o_orderkey AS id, o_custkey AS customer_id,
  'INV-' || lpad(o_orderkey::VARCHAR, 10, '0') AS invoice_number, {_money(_price)} AS amount, {_price} AS cents,
  issue_date, due_date, {case('o_orderstatus', D.STATUS)} AS status,
  CASE WHEN o_orderstatus = 'F' THEN due_date::TIMESTAMP + to_days((o_orderkey * 7919 % 80)::INT - 5)
    + to_hours((o_orderkey % 24)::INT) END AS paid_at,
  CASE WHEN o_orderkey % 100 < 6 THEN 'dispute' WHEN o_orderkey % 100 < 50 THEN 'cash_flow_stress'
    ELSE 'oversight' END AS true_root_cause
  FROM dated_orders""")

view("payments", f"""SELECT l_orderkey AS invoice_id,
  {_money('floor(l_extendedprice * (1.0 - l_discount) * 100.0 + 0.5)::BIGINT')} AS amount,
  floor(l_extendedprice * (1.0 - l_discount) * 100.0 + 0.5)::BIGINT AS cents,
  l_shipdate::DATE AS payment_date, {case('l_returnflag', D.METHOD)} AS method,
  CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'failed' END AS status FROM lineitem""")

view("touched", """SELECT e.*, o.o_orderkey AS invoice_id, o.due_date, o.o_totalprice
  FROM events e JOIN dated_orders o ON o.o_orderkey = e.event_id - e.event_id % 3""")

view("actions", f"""SELECT event_id AS id, invoice_id, {case('event_type', D.ACTION_OF_EVENT)} AS action_type,
  due_date::TIMESTAMP + to_days((event_id % 40)::INT) + to_hours((event_id % 24)::INT) AS timestamp,
  {case(case('event_type', D.ACTION_OF_EVENT), {a: c[0] for a, c in P.ACTIONS.items()})}::DOUBLE AS cost FROM touched""")

view("promises", f"""SELECT event_id AS id, invoice_id,
  {_money(f"floor({_price} * (k + 1) / 100.0)::BIGINT")} AS promised_amount,
  floor({_price} * (k + 1) / 100.0)::BIGINT AS promised_cents,
  due_date + (k % 30 + 10) AS promised_date, CASE WHEN event_id % 2 = 0 THEN 'voice' ELSE 'email' END AS source,
  {case('event_id % 3', {0: 'kept', 1: 'broken', 2: 'open'})} AS status,
  due_date::TIMESTAMP + to_days((event_id % 10)::INT) AS created_at
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM touched WHERE event_type IN ('signup', 'error'))""")

view("interactions", """SELECT concat_ws(':', conv_id, turn) AS id, (conv_id * 13)::BIGINT AS customer_id,
  CASE WHEN turn % 2 = 0 THEN (conv_id * 211 + turn)::BIGINT END AS invoice_id FROM conversations""")

view("account_state", f"""SELECT o_orderkey AS invoice_id, {case('o_orderkey % 7', dict(enumerate(D.STATE_CYCLE)))} AS current_state,
  0.05 + (o_orderkey % 90) / 100.0 AS recoverability_score, 0.0 AS promise_score,
  floor(o_totalprice * (1.0 - (0.05::DOUBLE + (o_orderkey % 90) / 100.0)) * 100 + 0.5) / 100 AS revenue_at_risk,
  {case('o_orderkey % 6', dict(enumerate(P.CANDIDATE_ACTIONS)))} AS next_action,
  {AS_OF} - to_days((o_orderkey % 6)::INT) AS updated_at
  FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderstatus = 'O'""")

view("decision_logs", f"""SELECT md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(l_extendedprice)::BIGINT)) AS id,
  l_orderkey AS invoice_id, {case('l_linenumber', D.LOG_DECISION)} AS decision,
  {case('l_linenumber', D.LOG_STATE)} AS state,
  CASE WHEN l_linenumber % 3 <> 0 THEN (l_partkey % 100) / 100.0 END AS recovery_probability,
  {case('l_partkey % 4', {0: 'invoice.overdue', 1: 'promise.broken', 2: 'review.timeout', 3: 'promise.created'})} AS trigger_type,
  CASE WHEN l_linenumber = 6 THEN 'escalated' WHEN l_partkey % 5 = 0 THEN 'blocked' ELSE 'allowed' END AS policy_result,
  l_linenumber = 7 AS is_actually_paid,
  CASE WHEN l_partkey % 11 = 0 THEN {case('l_linenumber', D.LOG_DECISION)} || ' failed after 2 attempt(s): gateway error' END AS error,
  CASE WHEN l_partkey % 11 = 0 THEN {case('l_linenumber', D.LOG_DECISION)} || ' failed after 2 attempt(s): gateway error'
    WHEN l_linenumber = 7 THEN '{P.OLD_CLOSING_REASON.replace("'", "''")}' ELSE '{P.REASON_ALLOWED}' END AS reason,
  l_shipdate + to_hours(l_linenumber) AS timestamp,
  l_shipdate + to_hours(l_linenumber) + to_minutes((l_partkey % 60)::INT) AS created_at FROM lineitem""")

view("account_events", f"""SELECT event_id, {case('event_type', D.ACCOUNT_EVENT)} AS event_type, user_id AS invoice_id,
  ts AS occurred_at, json_extract_string(props, '$.k') AS k, value FROM events""")

view("past", f"""SELECT * FROM invoices WHERE status IN ('paid', 'written_off') AND id NOT IN
  (SELECT invoice_id FROM payments WHERE method = '{P.SIMULATED_PAYMENT_METHOD}')""")
view("live", "SELECT * FROM invoices WHERE status = 'open'")

for scope in ("past", "invoices"):
    view(f"facts_{scope}", f"""SELECT i.id AS invoice_id, i.customer_id, i.issue_date, i.due_date, i.status, i.cents, i.paid_at,
      CASE WHEN i.status = 'paid' AND i.paid_at IS NOT NULL THEN greatest(i.due_date::TIMESTAMP, i.paid_at)
           WHEN i.status = 'written_off' THEN i.due_date::TIMESTAMP + to_days({P.WRITE_OFF_KNOWN_AFTER_DAYS}) END AS resolved_at,
      CASE WHEN i.status = 'paid' THEN {fdays('i.due_date::TIMESTAMP', 'i.paid_at')} END AS delay,
      i.status = 'written_off' OR (i.status = 'paid' AND i.paid_at > i.due_date) AS late,
      coalesce(p.n, 0) AS promises, coalesce(p.kept, 0) AS kept, coalesce(a.n, 0) AS escalations
      FROM {scope} i
      LEFT JOIN (SELECT invoice_id, count(*) AS n, count(*) FILTER (status = 'kept') AS kept FROM promises GROUP BY 1) p ON p.invoice_id = i.id
      LEFT JOIN (SELECT invoice_id, count(*) AS n FROM actions WHERE action_type = 'escalate' GROUP BY 1) a ON a.invoice_id = i.id""")

view("promise_cut", f"""SELECT p.*, coalesce(a.last_action, p.promised_date::TIMESTAMP - to_days({P.PROMISE_LEAD_FALLBACK_DAYS})) AS T,
  a.last_action IS NULL AS is_fallback
  FROM promises p LEFT JOIN (SELECT invoice_id, max(timestamp) AS last_action FROM actions GROUP BY 1) a USING (invoice_id)""")


def feature_views(name: str, points: str, scope: str) -> None:
    """``points``: SQL giving qid, invoice_id, cutoff and columns to keep. History by plain join, on purpose."""
    view(f"pts_{name}", points)
    known = "f.customer_id = q.customer_id AND f.invoice_id <> q.invoice_id AND f.resolved_at < q.cutoff"
    long = f"(f.due_date >= q.cutoff - to_days({P.RECENT_LONG_DAYS}))"
    short = f"(f.due_date >= q.cutoff - to_days({P.RECENT_SHORT_DAYS}))"
    view(f"hist_{name}", f"""SELECT q.qid, count(f.invoice_id) AS n, count(*) FILTER (f.status = 'paid') AS paid,
      count(*) FILTER (f.status = 'written_off') AS written_off, sum(f.delay) AS delay, sum(f.cents) AS cents, max(f.cents) AS top,
      coalesce(sum(f.promises), 0) AS promises, sum(f.kept) AS kept, sum(f.escalations) AS escalations,
      count(*) FILTER ({short}) AS n90, count(*) FILTER ({short} AND f.status = 'paid') AS paid90, count(*) FILTER ({short} AND f.late) AS late90,
      count(*) FILTER ({long}) AS n180, count(*) FILTER ({long} AND f.status = 'paid') AS paid180, sum(f.delay) FILTER ({long}) AS delay180,
      sum(f.promises) FILTER ({long}) AS promises180, sum(f.kept) FILTER ({long}) AS kept180
      FROM (SELECT p.*, i.customer_id FROM pts_{name} p JOIN invoices i ON i.id = p.invoice_id) q
      LEFT JOIN facts_{scope} f ON {known} GROUP BY 1""")
    view(f"issued_{name}", f"""SELECT q.qid, count(f.id) AS issued, max(f.issue_date) AS last_issue
      FROM (SELECT p.*, i.customer_id FROM pts_{name} p JOIN invoices i ON i.id = p.invoice_id) q
      LEFT JOIN {scope} f ON f.customer_id = q.customer_id AND f.id <> q.invoice_id AND f.issue_date < q.cutoff GROUP BY 1""")
    view(f"paidto_{name}", f"""SELECT q.qid, coalesce(sum(y.cents), 0) AS paid_cents FROM pts_{name} q
      LEFT JOIN payments y ON y.invoice_id = q.invoice_id AND y.payment_date <= q.cutoff GROUP BY 1""")
    months = f"({fdays('c.relationship_start_date::TIMESTAMP', 'q.cutoff')} / 30.0)"
    relation = fdays("c.relationship_start_date::TIMESTAMP", "q.cutoff")
    view(f"feat_{name}", f"""SELECT q.*, i.customer_id, c.merchant_id, i.amount::DOUBLE AS amount, ln(1 + i.amount::DOUBLE) AS amount_log1p,
      date_diff('day', i.issue_date, i.due_date) AS payment_term_days, month(i.issue_date) AS issue_month,
      (isodow(i.issue_date) - 1) AS issue_day_of_week, m.segment AS merchant_segment, m.industry AS merchant_industry,
      c.segment AS customer_segment, c.industry AS customer_industry,
      CASE WHEN {relation} >= 0 THEN {relation} END AS customer_relationship_days_at_cutoff,
      (i.cents - y.paid_cents) / 100.0 AS outstanding_amount,
      (i.cents - y.paid_cents) / 100.0 / nullif(i.amount::DOUBLE, 0) AS outstanding_ratio,
      h.n > 0 AS has_prior_history, h.n AS prior_invoice_count, h.paid AS prior_paid_count, h.written_off AS prior_written_off_count,
      h.paid / nullif(h.n, 0) AS prior_payment_rate, h.delay / nullif(h.paid, 0) AS prior_avg_delay_days,
      h.cents / nullif(h.n, 0) / 100.0 AS prior_avg_amount, coalesce(h.cents, 0) / 100.0 AS prior_total_amount, h.top / 100.0 AS prior_max_amount,
      h.promises::BIGINT AS prior_promise_count, h.kept / nullif(h.promises, 0) AS prior_promise_kept_rate,
      h.escalations / nullif(h.n, 0) AS prior_escalation_touches_avg,
      {fdays('s.last_issue::TIMESTAMP', 'q.cutoff')} AS prior_days_since_last_invoice,
      CASE WHEN {months} > 0 THEN s.issued / {months} END AS customer_invoice_frequency,
      h.paid90 / nullif(h.n90, 0) AS recent_90d_payment_rate, h.late90 / nullif(h.n90, 0) AS recent_90d_late_rate,
      h.paid180 / nullif(h.n180, 0) AS recent_180d_payment_rate, h.delay180 / nullif(h.paid180, 0) AS recent_180d_avg_delay_days,
      h.kept180 / nullif(h.promises180, 0) AS recent_180d_ptp_keep_rate
      FROM pts_{name} q JOIN invoices i ON i.id = q.invoice_id JOIN customers c ON c.id = i.customer_id JOIN merchants m ON m.id = c.merchant_id
      JOIN hist_{name} h USING (qid) JOIN issued_{name} s USING (qid) JOIN paidto_{name} y USING (qid)""")


feature_views("recovery", "SELECT id AS qid, id AS invoice_id, due_date::TIMESTAMP AS cutoff, invoice_number, due_date, issue_date, status, paid_at FROM past", "past")
feature_views("live", "SELECT id AS qid, id AS invoice_id, due_date::TIMESTAMP AS cutoff, invoice_number, due_date, issue_date, status FROM live", "invoices")
feature_views("promise", """SELECT p.id AS qid, p.invoice_id, p.T AS cutoff, p.id AS promise_id, p.T, p.promised_date, p.source,
  (p.status = 'kept')::INT AS kept FROM promise_cut p WHERE p.status IN ('kept', 'broken') AND p.invoice_id IN (SELECT id FROM past)""", "past")
feature_views("livepromise", """SELECT p.id AS qid, p.invoice_id, p.created_at + to_hours((p.id % 24)::INT) AS cutoff, p.id AS promise_id,
  p.created_at + to_hours((p.id % 24)::INT) AS T, p.promised_date, p.source FROM promises p WHERE p.status = 'open'""", "invoices")

_INT = {"payment_term_days", "issue_month", "issue_day_of_week", "prior_invoice_count", "prior_paid_count",
        "prior_written_off_count", "prior_promise_count"}


def feature_columns(table: str = "") -> str:
    dot = f"{table}." if table else ""
    out = []
    for c in P.NUMERIC_FEATURES:
        if c == "has_prior_history":
            out.append(f"{dot}{c}")
        elif c in _INT:
            out.append(f"{dot}{c}::BIGINT AS {c}")
        else:
            out.append(f"{r(f'({dot}{c})')} AS {c}")
    return ", ".join([*out, *[f"{dot}{c}" for c in P.CATEGORICAL_FEATURES]])
