"""Queries on sources, point-in-time features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import cents, money, plus_days, to_ntz
from duewise.operators import features as FE
from duewise.operators import history as H
from duewise.queries.registry import query
from duewise.queries.sqlviews import day, feature_columns, fdays, r, sql, ts
from duewise.sources import tables as S

_IDS = "invoice_id, customer_id, merchant_id"


@query("O001_load_normalise", sql(f"""
SELECT 'invoices' AS table_name, count(*) AS n, {r('sum(cents) / 100.0', 2)} AS total,
  {ts('max(due_date)::TIMESTAMP').replace('max(due_date)::TIMESTAMP', 'max(due_date::TIMESTAMP)')} AS latest FROM invoices
UNION ALL SELECT 'payments', count(*), {r('sum(cents) / 100.0', 2)}, {ts('max(payment_date::TIMESTAMP)')} FROM payments
UNION ALL SELECT 'customers', count(*), 0.0, {ts('max(relationship_start_date::TIMESTAMP)')} FROM customers
UNION ALL SELECT 'actions', count(*), 0.0, {ts('max(timestamp)')} FROM actions
UNION ALL SELECT 'promises', count(*), {r('sum(promised_cents) / 100.0', 2)}, {ts('max(created_at)')} FROM promises
UNION ALL SELECT 'merchants', count(*), 0.0, {ts('max(relationship_start_date::TIMESTAMP)')} FROM merchants"""), digits=2)
def load_normalise(x):
    raw = S.normalise_raw(x.d)
    measures = {
        "invoices": (F.sum(cents(x.d.invoices.amount)), "due_date"), "payments": (None, "payment_date"),
        "customers": (None, "relationship_start_date"), "actions": (None, "timestamp"), "promises": (None, "created_at"),
        "merchants": (None, "relationship_start_date"),
    }
    out = None
    for name, (_, stamp) in measures.items():
        amount = {"invoices": "amount", "payments": "amount", "promises": "promised_amount"}.get(name)
        total = F.sum((F.round(F.col(amount) * 100)).cast("bigint")) / 100.0 if amount else F.lit(0.0)
        part = raw[name].agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), total.alias("total"),
            F.max(to_ntz(F.col(stamp))).alias("latest"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("O002_organic_history", sql("SELECT id, status FROM past"))
def organic(x):
    return S.organic_history(x.d.invoices, x.d.payments).select("id", "status")


@query("O003_live_pool", sql(f"SELECT id, invoice_number, {r('cents / 100.0', 2)} AS amount FROM live"), digits=2)
def live(x):
    return S.live_pool(x.d.invoices).select("id", "invoice_number", "amount")


@query("O020_resolved_before", sql("""SELECT invoice_id, coalesce(resolved_at < due_date::TIMESTAMP + to_days(60), false) AS known_after_60d,
  coalesce(resolved_at < due_date::TIMESTAMP + to_days(151), false) AS known_after_151d FROM facts_invoices"""))
def resolved_before(x):
    due = to_ntz(F.col("due_date"))
    known = lambda n: F.coalesce(H.resolved_at() < plus_days(due, n), F.lit(False))
    return x.d.invoices.select(
        F.col("id").alias("invoice_id"), known(60).alias("known_after_60d"), known(151).alias("known_after_151d")
    )


_STATIC = ["amount", "amount_log1p", "payment_term_days", "issue_month", "issue_day_of_week", "outstanding_amount",
           "outstanding_ratio", "customer_relationship_days_at_cutoff", *P.CATEGORICAL_FEATURES]


@query("O021_static_features", sql(f"""SELECT invoice_id, {r('amount')} AS amount, {r('amount_log1p')} AS amount_log1p,
  payment_term_days::BIGINT AS payment_term_days, issue_month::BIGINT AS issue_month, issue_day_of_week::BIGINT AS issue_day_of_week,
  {r('outstanding_amount')} AS outstanding_amount, {r('outstanding_ratio')} AS outstanding_ratio,
  {r('customer_relationship_days_at_cutoff')} AS customer_relationship_days_at_cutoff,
  merchant_segment, merchant_industry, customer_segment, customer_industry FROM feat_live"""))
def static(x):
    rows = FE.star(S.live_pool(x.d.invoices).withColumnRenamed("id", "invoice_id"), x.d.customers, x.d.merchants)
    rows = rows.withColumns({"cutoff": to_ntz(F.col("due_date")), "query_id": F.col("invoice_id")})
    paid = FE.paid_as_of(rows, x.d.payments)
    return FE.static_features(rows.join(paid, "query_id", "left")).select("invoice_id", *_STATIC)


@query("O022_recovery_label", sql(f"""SELECT id, CASE WHEN status = 'paid' AND {fdays('due_date::TIMESTAMP', 'paid_at')} <= 60
  THEN 1 ELSE 0 END::BIGINT AS recovery_label FROM past"""))
def recovery_label(x):
    return S.organic_history(x.d.invoices, x.d.payments).select("id", FE.recovery_label().alias("recovery_label"))


@query("O023_eventually_paid", sql("SELECT id, (status = 'paid')::BIGINT AS eventually_paid FROM past"))
def eventually(x):
    return S.organic_history(x.d.invoices, x.d.payments).select("id", FE.eventually_paid().alias("eventually_paid"))


@query("O024_root_cause_label", sql("""SELECT id, (true_root_cause = 'cash_flow_stress')::BIGINT AS root_cause_label
  FROM past WHERE true_root_cause <> 'dispute'"""))
def cause_label(x):
    rows = S.organic_history(x.d.invoices, x.d.payments).filter(~F.col("true_root_cause").eqNullSafe("dispute"))
    return rows.select("id", FE.root_cause_label().alias("root_cause_label"))


@query("O025_kept_label", sql("SELECT id, (status = 'kept')::BIGINT AS kept FROM promises WHERE status IN ('kept', 'broken')"))
def kept_label(x):
    closed = x.d.promises.filter(F.col("status").isin("kept", "broken"))
    return closed.select("id", (F.col("status") == "kept").cast("int").alias("kept"))


def _live_history(x):
    facts = FE.stored_facts(x.d, x.d.invoices)
    points = H.query_points(S.live_pool(facts), to_ntz(F.col("due_date")))
    return H.known_history(points, facts, midnight=True, own_may_be_known=False)


@query("O050_prior_resolved_join", sql("""SELECT qid AS invoice_id, n AS n_prior, coalesce(cents, 0)::BIGINT AS prior_cents FROM hist_live"""))
def prior_resolved(x):
    return _live_history(x).select("invoice_id", F.col("h_n").alias("n_prior"), F.col("h_cents").alias("prior_cents"))


@query("O051_prior_issued_join", sql(f"SELECT qid AS invoice_id, issued::BIGINT AS n_issued, {day('last_issue')} AS last_issue FROM issued_live"))
def prior_issued(x):
    return _live_history(x).select("invoice_id", F.col("h_issued").alias("n_issued"), F.col("h_last_issue").alias("last_issue"))


@query("O052_star_enrichment", sql("""SELECT i.id AS invoice_id, m.id AS merchant_id, c.segment AS customer_segment, c.industry AS customer_industry,
  m.segment AS merchant_segment, m.industry AS merchant_industry
  FROM invoices i JOIN customers c ON c.id = i.customer_id JOIN merchants m ON m.id = c.merchant_id"""))
def star(x):
    rows = FE.star(x.d.invoices.withColumnRenamed("id", "invoice_id"), x.d.customers, x.d.merchants)
    return rows.select("invoice_id", "merchant_id", *P.CATEGORICAL_FEATURES)


@query("O053_prior_promises_actions", sql("""SELECT qid AS invoice_id, promises::BIGINT AS promises, coalesce(kept, 0)::BIGINT AS kept,
  coalesce(escalations, 0)::BIGINT AS escalations FROM hist_live"""))
def prior_touches(x):
    touches = [F.col(f"h_{c}").alias(c) for c in ("promises", "kept", "escalations")]
    return _live_history(x).select("invoice_id", *touches)


@query("O054_paid_as_of_cutoff", sql(f"SELECT qid AS invoice_id, {r('paid_cents / 100.0', 2)} AS paid FROM paidto_live WHERE paid_cents > 0"), digits=2)
def paid_as_of(x):
    rows = S.live_pool(x.d.invoices).select(
        F.col("id").alias("query_id"), F.col("id").alias("invoice_id"), to_ntz(F.col("due_date")).alias("cutoff")
    )
    return FE.paid_as_of(rows, x.d.payments).select(F.col("query_id").alias("invoice_id"), money(F.col("paid_cents")).alias("paid"))


@query("O055_promise_cutoff", sql(f"SELECT id, {ts('T')} AS T, is_fallback FROM promise_cut"))
def cutoff(x):
    return FE.promise_cutoffs(x.d.promises, x.d.actions).select("id", "T", "is_fallback")


@query("O055_promise_cutoff_fallbacks", sql("SELECT count(*) AS n, count(*) FILTER (is_fallback) AS n_fallback FROM promise_cut"))
def cutoff_fallbacks(x):
    return FE.promise_cutoffs(x.d.promises, x.d.actions).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_fallback").alias("n_fallback")
    )


@query("O056_archetype_join", sql("SELECT i.id AS invoice_id, c.archetype, c.true_recovery_probability FROM past i JOIN customers c ON c.id = i.customer_id"))
def archetype_join(x):
    past = S.organic_history(x.d.invoices, x.d.payments)
    return FE.with_archetype(past, x.d.customers).select(F.col("id").alias("invoice_id"), "archetype", "true_recovery_probability")


_ROLLING = P.NUMERIC_FEATURES[8:19]
_CADENCE = ["prior_days_since_last_invoice", "customer_invoice_frequency"]
_SHORT = ["recent_90d_payment_rate", "recent_90d_late_rate"]
_LONG = ["recent_180d_payment_rate", "recent_180d_avg_delay_days", "recent_180d_ptp_keep_rate"]


def _some(names):
    ints = {"prior_invoice_count", "prior_paid_count", "prior_written_off_count", "prior_promise_count"}
    shape = lambda c: c if c == "has_prior_history" else f"{c}::BIGINT AS {c}" if c in ints else f"{r(c)} AS {c}"
    return ", ".join(shape(c) for c in names)


@query("O070_rolling_history", sql(f"SELECT invoice_id, {_some(_ROLLING)} FROM feat_recovery"))
def rolling(x):
    return FE.recovery_features(x.d).select("invoice_id", *_ROLLING)


@query("O071_cadence", sql(f"SELECT invoice_id, {_some(_CADENCE)} FROM feat_recovery"))
def cadence(x):
    return FE.recovery_features(x.d).select("invoice_id", *_CADENCE)


@query("O072_recent_90_days", sql(f"SELECT invoice_id, {_some(_SHORT)} FROM feat_recovery"))
def recent_short(x):
    return FE.recovery_features(x.d).select("invoice_id", *_SHORT)


@query("O073_recent_180_days", sql(f"SELECT invoice_id, {_some(_LONG)} FROM feat_recovery"))
def recent_long(x):
    return FE.recovery_features(x.d).select("invoice_id", *_LONG)


@query("O074_recovery_features", sql(f"""SELECT {_IDS}, invoice_number, {day('due_date')} AS due_date, {day('issue_date')} AS issue_date,
  status, {ts('paid_at')} AS paid_at, {feature_columns()} FROM feat_recovery"""))
def recovery(x):
    return FE.recovery_features(x.d)


@query("O075_live_features", sql(f"""SELECT {_IDS}, invoice_number, {day('due_date')} AS due_date, {day('issue_date')} AS issue_date,
  status, {feature_columns()} FROM feat_live"""))
def live_table(x):
    return FE.live_features(x.d)


@query("O076_promise_features", sql(f"""SELECT {_IDS}, promise_id, {ts('T')} AS T, {day('promised_date')} AS promised_date, source,
  kept::BIGINT AS kept, {feature_columns()} FROM feat_promise"""))
def promise_table(x):
    return FE.promise_features(x.d)


def live_promises(x):
    """Open promises with their event time: some hours after the day they were made."""
    return x.d.promises.filter("status = 'open'").withColumn(
        "T", F.col("created_at") + F.make_dt_interval(F.lit(0), (F.col("id") % 24).cast("int"))
    )


@query("O077_live_promise_features", sql(f"""SELECT {_IDS}, promise_id, {ts('T')} AS T, {day('promised_date')} AS promised_date, source,
  {feature_columns()} FROM feat_livepromise"""))
def live_promise_table(x):
    return FE.live_promise_features(x.d, live_promises(x))


@query("O078_root_cause_table", sql(f"""SELECT f.invoice_id, f.customer_id, f.merchant_id, f.invoice_number, {day('f.due_date')} AS due_date,
  {day('f.issue_date')} AS issue_date, f.status, {ts('f.paid_at')} AS paid_at, {feature_columns('f')},
  (i.true_root_cause = 'cash_flow_stress')::BIGINT AS root_cause_label
  FROM feat_recovery f JOIN invoices i ON i.id = f.invoice_id WHERE i.true_root_cause <> 'dispute'"""))
def cause_table(x):
    return FE.root_cause_table(x.d)


_curve = f"""SELECT archetype, grouping(archetype)::BIGINT AS pooled, count(*) AS n,
  count(*) FILTER (status = 'written_off') / count(*) AS written_off_rate,
  {', '.join(f"count(*) FILTER (status = 'paid' AND {fdays('due_date::TIMESTAMP', 'paid_at')} <= {m}) / count(*) AS paid_by_{m}" for m in P.DAY_MARKS)}
  FROM (SELECT p.*, c.archetype FROM past p JOIN customers c ON c.id = p.customer_id) GROUP BY GROUPING SETS ((), (archetype))"""


@query("O079_resolution_curve", sql(f"""SELECT archetype, pooled, n, {r('written_off_rate')} AS written_off_rate,
  {', '.join(f'{r(f"paid_by_{m}")} AS paid_by_{m}' for m in P.DAY_MARKS)} FROM ({_curve})"""))
def curve(x):
    return FE.resolution_curve(x.d)


@query("O080_class_balance", sql(f"""SELECT archetype, n, {r('paid_by_60')} AS rate, paid_by_60 BETWEEN 0.15 AND 0.85 AS passed,
  pooled = 1 AS gates FROM ({_curve})"""))
def balance(x):
    return FE.class_balance(FE.resolution_curve(x.d))


@query("O080_kept_rate_by_archetype", sql(f"""SELECT c.archetype, count(*) AS n, {r('avg(kept)')} AS kept_rate
  FROM pts_promise p JOIN invoices i ON i.id = p.invoice_id JOIN customers c ON c.id = i.customer_id GROUP BY 1"""))
def kept_rate(x):
    past = S.organic_history(x.d.invoices, x.d.payments).select(F.col("id").alias("invoice_id"), "customer_id")
    closed = x.d.promises.filter(F.col("status").isin("kept", "broken"))
    rows = FE.with_archetype(closed.join(past, "invoice_id"), x.d.customers)
    return rows.groupBy("archetype").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("status") == "kept").cast("int")).alias("kept_rate")
    )


@query("O120_divergence_top", sql(f"""SELECT customer_id, {r('gap')} AS divergence FROM (
  SELECT customer_id, abs(prior_payment_rate - recent_90d_payment_rate) AS gap FROM feat_recovery)
  WHERE gap IS NOT NULL ORDER BY gap DESC, customer_id LIMIT 1"""))
def divergence(x):
    return FE.largest_divergence(FE.recovery_features(x.d))


@query("O120_busiest_customer", sql("""SELECT archetype, customer_id, n FROM (SELECT archetype, customer_id, n,
  row_number() OVER (PARTITION BY archetype ORDER BY n DESC, customer_id) AS rn FROM (
  SELECT c.archetype, p.customer_id, count(*) AS n FROM past p JOIN customers c ON c.id = p.customer_id GROUP BY 1, 2)) WHERE rn = 1"""))
def busiest(x):
    return FE.busiest_customer(S.organic_history(x.d.invoices, x.d.payments), x.d.customers)
