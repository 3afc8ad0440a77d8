"""Queries on data quality, logs, reads and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from duewise import params as P
from duewise.operators import attribution as A
from duewise.operators import audit
from duewise.operators import features as FE
from duewise.operators import quality as Q
from duewise.operators import reads
from duewise.operators.sampling import assign_arms
from duewise.plans import decisions as PD
from duewise.plans.experiment import population
from duewise.queries.decisions import decisions
from duewise.queries.experiment import _cube_cols, _cuped
from duewise.queries.experiment import rows as experiment_rows
from duewise.queries.registry import query
from duewise.queries.retrieval import corpus
from duewise.queries.sqlviews import AS_OF, day, r, rr, sql, ts, view
from duewise.session import materialise, new_path
from duewise.sources import keyed, sinks

# Data quality

_orphans = {
    "customers.merchant_id": "customers c LEFT JOIN merchants p ON p.id = c.merchant_id WHERE p.id IS NULL",
    "invoices.merchant_id": "invoices i LEFT JOIN customers c ON c.id = i.customer_id LEFT JOIN merchants p ON p.id = c.merchant_id WHERE p.id IS NULL",
    "invoices.customer_id": "invoices i LEFT JOIN customers p ON p.id = i.customer_id WHERE p.id IS NULL",
    "payments.invoice_id": "payments c LEFT JOIN invoices p ON p.id = c.invoice_id WHERE p.id IS NULL",
    "payment_promises.invoice_id": "promises c LEFT JOIN invoices p ON p.id = c.invoice_id WHERE p.id IS NULL",
    "interactions.customer_id": "interactions c LEFT JOIN customers p ON p.id = c.customer_id WHERE p.id IS NULL",
    "interactions.invoice_id (where set)": "interactions c LEFT JOIN invoices p ON p.id = c.invoice_id WHERE p.id IS NULL AND c.invoice_id IS NOT NULL",
    "recovery_actions.invoice_id": "actions c LEFT JOIN invoices p ON p.id = c.invoice_id WHERE p.id IS NULL",
    "account_state.invoice_id": "account_state c LEFT JOIN invoices p ON p.id = c.invoice_id WHERE p.id IS NULL",
    "account_state.merchant_id": "account_state s LEFT JOIN invoices i ON i.id = s.invoice_id LEFT JOIN customers c ON c.id = i.customer_id LEFT JOIN merchants p ON p.id = c.merchant_id WHERE p.id IS NULL",
    "account_state.customer_id": "account_state s LEFT JOIN invoices i ON i.id = s.invoice_id LEFT JOIN customers p ON p.id = i.customer_id WHERE p.id IS NULL",
    "invoices without account_state": "invoices i LEFT JOIN account_state p ON p.invoice_id = i.id WHERE p.invoice_id IS NULL",
}
_rows = lambda rules: " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS violations FROM {body}" for n, body in rules.items())
_temporal = {
    "due_date before issue_date": "invoices WHERE due_date < issue_date",
    "paid without paid_at": "invoices WHERE status = 'paid' AND paid_at IS NULL",
    "paid_at without paid": "invoices WHERE status <> 'paid' AND paid_at IS NOT NULL",
    "payment before issue_date": "payments y JOIN invoices i ON i.id = y.invoice_id WHERE y.payment_date < i.issue_date",
    "payment in the future": f"payments WHERE payment_date > {AS_OF}::DATE",
}
_owned = "invoices i JOIN customers c ON c.id = i.customer_id LEFT JOIN (SELECT invoice_id, sum(cents) AS paid FROM payments GROUP BY 1) y ON y.invoice_id = i.id"
_business = {
    "premature write-off": f"invoices WHERE status = 'written_off' AND due_date > {AS_OF}::DATE - 150",
    "paid invoice with other payment total": f"{_owned} WHERE i.status = 'paid' AND (paid IS NULL OR abs(paid - i.cents) > 1)",
    "false alarm without payment": f"{_owned} WHERE c.archetype = 'already_paid_false_alarm' AND paid IS NULL",
    "false alarm not open": f"{_owned} WHERE c.archetype = 'already_paid_false_alarm' AND i.status <> 'open'",
}
_business_sql = _rows(_business) + " UNION ALL SELECT 'dispute rate out of band', (NOT avg((true_root_cause = 'dispute')::INT) BETWEEN 0.03 AND 0.09)::BIGINT FROM invoices"
_duplicates = {"duplicate invoice_number": "(SELECT invoice_number FROM invoices GROUP BY 1 HAVING count(*) > 1)"}
_missing = {
    "missing archetype": "customers WHERE archetype IS NULL", "missing true_recovery_probability": "customers WHERE true_recovery_probability IS NULL",
    "missing true_root_cause": "invoices WHERE true_root_cause IS NULL",
}
_bounds = {
    "amount out of bounds": "invoices WHERE amount < 5000 OR amount > 500000", "negative action cost": "actions WHERE cost < 0",
    "negative payment": "payments WHERE amount < 0",
}
_shares = " UNION ALL ".join(
    f"SELECT 'archetype share {a}' AS rule, (n = 0 OR NOT n BETWEEN total * {v[0] * 0.5} AND total * {v[0] * 1.5})::BIGINT AS violations FROM (SELECT count(*) FILTER (archetype = '{a}') AS n, count(*) AS total FROM customers)"
    for a, v in P.ARCHETYPES.items()
)
_groups = {
    "referential_integrity_and_orphans": _rows(_orphans), "temporal_consistency": _rows(_temporal), "business_rules": _business_sql,
    "duplicates": _rows(_duplicates), "missing_values": _rows(_missing), "amount_and_date_bounds": _rows(_bounds), "archetypes_present": _shares,
}


@query("O059_orphan_checks", sql(_rows(_orphans)))
def orphan_checks(x):
    return Q.referential(x.d)


@query("O150_temporal_rules", sql(_rows(_temporal)))
def temporal(x):
    return Q.temporal(x.d, x.as_of)


@query("O151_business_rules", sql(_business_sql))
def business(x):
    return Q.business(x.d, x.as_of)


@query("O152_duplicates", sql(_rows(_duplicates)))
def duplicates(x):
    return Q.duplicates(x.d)


@query("O153_missing_values", sql(_rows(_missing)))
def missing(x):
    return Q.missing(x.d, x.as_of)


@query("O154_bounds", sql(_rows(_bounds)))
def bounds(x):
    return Q.bounds(x.d, x.as_of)


@query("O155_category_shares", sql(_shares))
def shares(x):
    return Q.archetype_shares(x.d, x.as_of)


@query("O156_rule_report", sql(" UNION ALL ".join(f"SELECT rule, violations, '{g}' AS rule_group, violations = 0 AS passed FROM ({body})" for g, body in _groups.items())))
def report(x):
    return Q.all_rules(x.d, x.as_of)


_domain = lambda values: ", ".join(f"'{v}'" for v in values)


@query("O158_enum_domains", sql(_rows({
    "invoices.status": f"invoices WHERE status NOT IN ({_domain(P.DOMAINS['invoice_status'])})",
    "payment_promises.status": f"promises WHERE status NOT IN ({_domain(P.DOMAINS['promise_status'])})",
    "payments.status": f"payments WHERE status NOT IN ({_domain(P.DOMAINS['payment_status'])})",
    "recovery_actions.action_type": f"actions WHERE action_type NOT IN ({_domain(P.DOMAINS['action_type'])})",
    "recovery_actions.policy_result": "actions WHERE false",
    "account_state.current_state": f"account_state WHERE current_state NOT IN ({_domain(P.DOMAINS['account_state'])})",
    "account_state.next_action": f"account_state WHERE next_action NOT IN ({_domain(P.DOMAINS['action_type'])})",
})))
def enums(x):
    return Q.enum_domains(x.d)


_all = lambda name, source: f"SELECT '{name}' AS metric, 'all' AS value, count(*)::DOUBLE AS amount FROM {source}"
_by = lambda name, source, c: f"SELECT '{name}', {c}, count(*)::DOUBLE FROM {source} GROUP BY {c}"


@query("O098_dataset_summary", sql(" UNION ALL ".join([
    _all("merchants", "merchants"), _all("customers", "customers"), _all("invoices_total", "invoices"), _by("invoices_by_status", "invoices", "status"),
    _by("customers_by_archetype", "customers", "archetype"), _by("invoices_by_root_cause", "invoices", "true_root_cause"), _all("payments", "payments"),
    _all("promises", "promises"), _by("promises_by_status", "promises", "status"), _all("interactions", "interactions"), _all("recovery_actions", "actions"),
    f"SELECT 'total_invoice_value', 'all', {r('sum(cents) / 100.0', 2)} FROM invoices", f"SELECT 'total_revenue_at_risk', 'all', {r('sum(revenue_at_risk)', 2)} FROM account_state",
])), digits=2)
def summary(x):
    return Q.dataset_summary(x.d)


@query("O099_fingerprint", sql("""SELECT md5((SELECT sum(('0x' || substr(md5(concat_ws('|', invoice_number, amount::VARCHAR, issue_date::VARCHAR, due_date::VARCHAR, status, true_root_cause)), 1, 15))::BIGINT::HUGEINT)::VARCHAR FROM invoices)
  || '#' || (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT archetype || '=' || count(*) AS t FROM customers GROUP BY archetype))
  || '#' || (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT status || '=' || count(*) AS t FROM promises GROUP BY status))) AS fingerprint"""))
def fingerprint(x):
    return Q.fingerprint(x.d)


# Stored logs

view("newest_log", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY timestamp DESC, created_at DESC, id DESC) AS rn FROM decision_logs) WHERE rn = 1")
view("newest_scored", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY timestamp DESC, created_at DESC, id DESC) AS rn FROM decision_logs WHERE recovery_probability IS NOT NULL) WHERE rn = 1")


@query("O105_latest_log", sql(f"SELECT invoice_id, id, decision, reason, {ts('timestamp')} AS timestamp FROM newest_log"))
def latest(x):
    return audit.latest_log(x.d.decision_logs)


@query("O106_score_fallback", sql(f"""SELECT n.invoice_id, n.decision, n.reason, {ts('n.timestamp')} AS timestamp,
  {r('coalesce(n.recovery_probability, s.recovery_probability)', 4)} AS recovery_probability, coalesce(CASE WHEN n.recovery_probability IS NULL THEN s.trigger_type END, n.trigger_type) AS trigger_type,
  CASE WHEN n.recovery_probability IS NULL THEN {ts('s.timestamp')} END AS assessed_at FROM newest_log n LEFT JOIN newest_scored s ON s.invoice_id = n.invoice_id"""), digits=4)
def trace(x):
    return audit.decision_trace(x.d.decision_logs).select(
        "invoice_id", "decision", "reason", "timestamp", F.get_json_object("model_scores", "$.recovery_probability").cast("double").alias("recovery_probability"),
        F.get_json_object("evidence", "$.trigger_event.event_type").alias("trigger_type"), "assessed_at",
    )


_note = "recovered as part of a randomized control-group experiment, not a live transaction"
view("entries", f"""SELECT invoice_id, timestamp, 'decision' AS type, decision || ' -- ' || reason AS summary, trigger_type, policy_result, is_actually_paid AS is_paid, error, state AS path FROM decision_logs
  UNION ALL SELECT invoice_id, payment_date::TIMESTAMP, 'payment', 'Payment of Rs.' || format('{{:,.2f}}', amount::DOUBLE) ||
  CASE WHEN method = '{P.SIMULATED_PAYMENT_METHOD}' THEN ' -- {_note}' ELSE ' via ' || method END, NULL, NULL, false, NULL, NULL FROM payments""")
view("rounds", """SELECT *, CASE WHEN type = 'payment' THEN 'Payment' WHEN is_paid THEN 'Safety closure' WHEN error IS NOT NULL THEN 'Execution failure'
  WHEN policy_result = 'blocked' THEN 'Policy block' WHEN policy_result = 'escalated' THEN 'Escalated' WHEN trigger_type = 'promise.created' THEN 'Promise created'
  WHEN trigger_type IN ('promise.broken', 'review.timeout') THEN 'Reassessment' WHEN trigger_type = 'customer.responded' THEN 'Customer response' ELSE 'Decision' END AS round FROM entries""")
_timeline = sql(f"SELECT invoice_id, {ts('timestamp')} AS timestamp, type, summary, path, round FROM rounds")


@query("O107_timeline", _timeline)
def timeline(x):
    return audit.timeline(x.d.decision_logs, x.d.payments).select("invoice_id", "timestamp", "type", "summary", "path", "round")


@query("O108_round_classification", sql("SELECT round, count(*) AS n FROM rounds GROUP BY 1"))
def rounds(x):
    return audit.timeline(x.d.decision_logs, x.d.payments).groupBy("round").agg(F.count(F.lit(1)).alias("n"))


@query("O136_log_paths", sql("""SELECT id, trigger_type AS trigger_event_type, policy_result, is_actually_paid AS is_paid, error, state AS state_transition_path FROM decision_logs"""))
def log_paths(x):
    return audit.parsed_logs(x.d.decision_logs).select("id", "trigger_event_type", "policy_result", "is_paid", "error", "state_transition_path")


_new_closing = P.CLOSING_REASON.replace("'", "''")
_old_closing = P.OLD_CLOSING_REASON.replace("'", "''")


@query("O043_reason_rewrite", sql(f"""SELECT id, CASE WHEN reason = '{_old_closing}' THEN '{_new_closing}'
  ELSE regexp_replace(reason, '^(\\w+) failed after (\\d+) attempt\\(s\\): .+$', '\\1 failed after \\2 attempt(s), fell back to wait') END AS reason FROM decision_logs"""))
def rewrite(x):
    return audit.rewrite_reasons(x.d.decision_logs).select("id", "reason")


@query("O134_decision_log_json", sql(f"""SELECT invoice_id, final_action AS decision, {r('base_probability', 4)} AS recovery_probability,
  (CASE WHEN is_disputed THEN 4 ELSE 6 END)::BIGINT AS n_candidates, cause AS cause, proposed AS proposed_action, policy_result AS result, reason, {ts(AS_OF)} AS timestamp FROM decided"""), digits=4)
def log_json(x):
    logs = audit.batch_decision_logs(decisions(x), x.as_of)
    g = F.get_json_object
    return logs.select(
        "invoice_id", "decision", g("model_scores", "$.recovery_probability").cast("double").alias("recovery_probability"),
        F.json_array_length(g("model_scores", "$.candidate_actions")).alias("n_candidates"), g("model_scores", "$.root_cause.predicted_label").alias("cause"),
        g("policy_checks", "$.proposed_action").alias("proposed_action"), g("policy_checks", "$.result").alias("result"), "reason", "timestamp",
    )


@query("O135_label_and_reason", sql("""SELECT id, coalesce(CASE WHEN l % 3 = 0 THEN decision END, CASE WHEN l % 3 = 1 THEN state END, 'rejected') AS decision,
  coalesce(error, CASE WHEN l % 3 = 0 THEN policy_result END, CASE WHEN l % 3 = 1 AND starts_with(trigger_type, 'promise.') THEN 'promise recorded -- account moved to ' || state END,
    'no assessment this round') AS reason
  FROM (SELECT *, hour(timestamp) AS l FROM decision_logs)"""))
def label_reason(x):
    shape = F.hour("timestamp") % 3
    logs = audit.parsed_logs(x.d.decision_logs)
    rows = logs.select(
        "id", "error", F.when(shape == 0, F.col("decision")).alias("selected_action"), F.when(shape == 1, F.col("state_transition_path")[0]).alias("next_state"),
        F.when(shape == 0, F.col("policy_result")).alias("policy_reason"), F.col("trigger_event_type").alias("event_type"),
    )
    return rows.select("id", audit.decision_label().alias("decision"), audit.decision_reason().alias("reason"))


_sent = "final_action NOT IN ('wait', 'stop')"
_fails = "invoice_id % 4 = 0"


@query("O137_failed_action_fallback", sql(f"""SELECT invoice_id, CASE WHEN {_sent} AND {_fails} THEN 'wait' ELSE final_action END AS selected_action,
  CASE WHEN {_sent} AND {_fails} THEN final_action || ' failed after 2 attempt(s), fell back to wait' END AS error,
  CASE WHEN {_sent} THEN CASE WHEN {_fails} THEN 1.0 ELSE 0.0 END END::DOUBLE AS retry_count FROM decided"""))
def fallback(x):
    done = decisions(x).select("invoice_id", F.col("final_action").alias("selected_action"))
    failed = F.col("invoice_id") % 4 == 0
    results = x.d.invoices.select(F.col("id").alias("invoice_id")).select(
        "invoice_id", (~failed).alias("success"), F.when(failed, 2).otherwise(1).alias("attempts")
    )
    out = audit.failed_action_fallback(done, results)
    return out.withColumn("retry_count", F.col("retry_count").cast("double"))


@query("O131_minor_units", sql("SELECT id, cents AS minor_units FROM invoices"))
def minor_units(x):
    return x.d.invoices.select("id", F.round(F.col("amount") * 100, 0).cast("bigint").alias("minor_units"))


# Reads

view("arm_of", "SELECT invoice_id, treatment_group FROM arms")
view("listed", """SELECT i.id AS invoice_id, i.invoice_number, c.company_name AS customer_name, c.segment, i.cents / 100.0 AS amount, i.due_date, s.current_state, s.recoverability_score, s.next_action, a.treatment_group
  FROM invoices i JOIN customers c ON c.id = i.customer_id JOIN account_state s ON s.invoice_id = i.id LEFT JOIN arm_of a ON a.invoice_id = i.id
  WHERE EXISTS (SELECT 1 FROM decision_logs l WHERE l.invoice_id = i.id)""")
_listed = f"invoice_id, invoice_number, customer_name, segment, {r('amount', 2)} AS amount, {day('due_date')} AS due_date, current_state, {r('recoverability_score', 2)} AS recoverability_score, next_action, treatment_group"


def listed(x):
    return reads.scored_invoices(x.d, assign_arms(population(x.d, x.as_of)))


@query("O042_invoice_filters", sql(f"SELECT {_listed} FROM listed WHERE current_state = 'wait' AND segment = 'BUILDING' AND invoice_number ILIKE '%inv-%1%'"), digits=2)
def filters(x):
    # A percent sign typed by a user is a literal, so the two-part pattern is two filters.
    rows = reads.filtered(listed(x), state="wait", segment="BUILDING", number_part="inv-")
    return reads.filtered(rows, number_part="1")


@query("O057_scored_invoices", sql(f"SELECT {_listed} FROM listed"), digits=2)
def scored_invoices(x):
    return listed(x)


@query("O109_invoice_page", sql(f"SELECT {_listed} FROM (SELECT * FROM listed ORDER BY due_date, invoice_id LIMIT 50 OFFSET 100)"), digits=2)
def invoice_page(x):
    return reads.page(listed(x), limit=50, offset=100)


@query("O173_one_invoice", sql(f"SELECT {_listed} FROM listed WHERE invoice_id = (SELECT min(invoice_id) FROM listed)"), digits=2)
def one_invoice(x):
    rows = listed(x)
    return reads.one_invoice(rows, rows.agg(F.min("invoice_id")).scalar())


@query("O173_invoice_traces", sql(f"""SELECT l.invoice_id, l.invoice_number, l.customer_name, l.current_state, n.decision, n.reason,
  {r('coalesce(n.recovery_probability, s.recovery_probability)', 2)} AS recovery_probability FROM listed l JOIN newest_log n ON n.invoice_id = l.invoice_id
  LEFT JOIN newest_scored s ON s.invoice_id = l.invoice_id"""), digits=2)
def traces(x):
    found = audit.decision_trace(x.d.decision_logs).select(
        "invoice_id", "decision", "reason", F.get_json_object("model_scores", "$.recovery_probability").cast("double").alias("recovery_probability")
    )
    return listed(x).select("invoice_id", "invoice_number", "customer_name", "current_state").join(found, "invoice_id")


@query("O173_metrics_read", sql(f"""SELECT s.strategy, {r('s.net_expected_recovered', 2)} AS net_expected_recovered, c.nt AS treatment_n, c.nc AS control_n, {r('c.net', 2)} AS incremental_net_recovery
  FROM summary s, cube c WHERE c.g1 = 1 AND c.g2 = 1"""), digits=2)
def metrics_read(x):
    snapshot = PD.evaluation_snapshot(PD.strategy_summary(PD.strategies(decisions(x))))
    pooled = A.slice_cube(experiment_rows(x), "segment", [[]]).select(F.struct("treatment_n", "control_n", "incremental_net_recovery")).scalar()
    return snapshot.select("strategy", "net_expected_recovered", pooled.alias("p")).select("strategy", "net_expected_recovered", "p.*")


_read_slices = f"SELECT 'slice' AS part, segment, {_cube_cols} FROM cube"
_read_diagnostics = f"""SELECT 'archetype' AS part, archetype, {_cube_cols} FROM arch_cube WHERE slice_action = 'escalate' UNION ALL BY NAME
  SELECT 'warning' AS part, c.slice_action AS action, {r('c.increment', 4)} AS pooled, {r('coalesce(s.total, 0)', 4)} AS stratified FROM cube c
  LEFT JOIN (SELECT slice_action, sum(increment) AS total FROM arch_cube GROUP BY 1) s ON s.slice_action = c.slice_action
  WHERE c.g1 = 1 AND c.g2 = 0 AND abs(c.increment) >= {P.SIMPSON_FLOOR} AND abs(coalesce(s.total, 0)) >= {P.SIMPSON_FLOOR} AND (c.increment < 0) <> (coalesce(s.total, 0) < 0)"""
_read_adjusted = _cuped.replace("SELECT segment", "SELECT 'cuped' AS part, segment", 1) + " WHERE g1 = 1 AND g2 = 1"


def read_attribution(x, **parts):
    """The slices as a run stored them, and the parts a reader asks for."""
    records = experiment_rows(x)
    return A.attribution_read(materialise(A.slice_cube(records), "slices"), records, **parts)


@query("O173_attribution_read", sql(_read_slices), digits=4)
def attribution_read(x):
    return read_attribution(x)


@query("O173_attribution_diagnostics", sql(f"{_read_slices} UNION ALL BY NAME {_read_diagnostics}"), digits=4)
def attribution_diagnostics(x):
    return read_attribution(x, diagnostics=True)


@query("O173_attribution_adjusted", sql(f"{_read_slices} UNION ALL BY NAME {_read_adjusted}"), digits=4)
def attribution_adjusted(x):
    return read_attribution(x, adjusted=True)


# Sinks: write, then read back


@query("O005_append_logs", sql("SELECT final_action AS decision, 2 * count(*) AS n FROM decided GROUP BY 1"))
def append_logs(x):
    path = new_path(x.spark, "decision-logs")
    logs = audit.batch_decision_logs(decisions(x), x.as_of).withColumn("log_date", F.to_date("timestamp"))
    sinks.append(logs, path, ["log_date"])
    sinks.append(x.spark.read.parquet(path), path, ["log_date"])
    return x.spark.read.parquet(path).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("O006_upsert_account_state", sql(f"""SELECT coalesce(n.invoice_id, s.invoice_id) AS invoice_id, coalesce(n.next_state, s.current_state) AS current_state,
  {r('coalesce(n.base_probability, s.recoverability_score)', 2)} AS recoverability_score, coalesce(n.final_action, s.next_action) AS next_action,
  {ts('s.updated_at')} AS updated_at FROM account_state s FULL JOIN next_states n ON n.invoice_id = s.invoice_id"""), digits=2)
def upsert_state(x):
    path = new_path(x.spark, "account-state")
    keyed.create(x.d.account_state, path, ["invoice_id"])
    keyed.upsert(PD.account_updates(decisions(x)), path, ["invoice_id"])
    return keyed.read(x.spark, path).select("invoice_id", "current_state", "recoverability_score", "next_action", "updated_at")


@query("O007_rebuild_corpus", sql("SELECT status, segment, count(*) AS n FROM case_rows GROUP BY 1, 2"))
def rebuild_corpus(x):
    path = new_path(x.spark, "case-corpus")
    for _ in range(2):
        sinks.overwrite(corpus(x), path)
    return x.spark.read.parquet(path).groupBy("status", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("O008_replace_slices", sql(f"""SELECT '{P.EXPERIMENT_ID}' AS experiment_id, segment, slice_action AS action, nt AS treatment_n, {r('net', 2)} AS incremental_net_recovery FROM cube
  UNION ALL SELECT 'other', segment, slice_action, nt, {r('net', 2)} FROM cube WHERE g2 = 1"""), digits=2)
def replace_slices(x):
    path = new_path(x.spark, "slices")
    cube = A.slice_cube(experiment_rows(x))
    sinks.overwrite_partitions(cube.filter("action IS NULL").withColumn("experiment_id", F.lit("other")), path, ["experiment_id"])
    for _ in range(2):
        sinks.overwrite_partitions(cube.withColumn("experiment_id", F.lit(P.EXPERIMENT_ID)), path, ["experiment_id"])
    return x.spark.read.parquet(path).select("experiment_id", "segment", "action", "treatment_n", "incremental_net_recovery")


@query("O009_evaluation_snapshot", sql(f"SELECT strategy, n_invoices, {rr('net_expected_recovered', 2)} FROM summary"), digits=2)
def store_snapshot(x):
    path = new_path(x.spark, "evaluation")
    sinks.overwrite(PD.evaluation_snapshot(PD.strategy_summary(PD.strategies(decisions(x)))), path)
    return x.spark.read.parquet(path).select("strategy", "n_invoices", "net_expected_recovered")


@query("O010_feature_snapshots", sql(f"""SELECT invoice_id, customer_id, {ts('due_date::TIMESTAMP')} AS feature_timestamp, {r('amount', 2)} AS amount,
  prior_promise_count::BIGINT AS prior_promise_count, {r('customer_invoice_frequency', 2)} AS customer_invoice_frequency, 'recovery-v1' AS model_version FROM feat_recovery"""), digits=2)
def snapshots(x):
    path = new_path(x.spark, "feature-snapshots")
    sinks.append(sinks.feature_snapshots(FE.recovery_features(x.d), "recovery-v1", "due_date"), path)
    g = F.get_json_object
    return x.spark.read.parquet(path).select(
        "invoice_id", "customer_id", "feature_timestamp", g("payment_features", "$.amount").cast("double").alias("amount"),
        g("promise_features", "$.prior_promise_count").cast("bigint").alias("prior_promise_count"),
        g("behavior_features", "$.customer_invoice_frequency").cast("double").alias("customer_invoice_frequency"), "model_version",
    )


view("one_open", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY id) AS rn FROM promises WHERE status = 'open') WHERE rn = 1")
view("new_terms", f"SELECT id AS invoice_id, {AS_OF}::DATE + 14 AS promised_date FROM live WHERE id % 3 = 0")


@query("O011_upsert_open_promise", sql(f"""SELECT id::DOUBLE AS id, invoice_id, {day('promised_date')} AS promised_date, status FROM promises WHERE status <> 'open'
  UNION ALL SELECT o.id::DOUBLE, coalesce(o.invoice_id, n.invoice_id), {day('coalesce(n.promised_date, o.promised_date)')}, 'open' FROM one_open o FULL JOIN new_terms n ON n.invoice_id = o.invoice_id"""))
def upsert_promise(x):
    # The stored table keeps at most one open promise per invoice.
    opened = x.d.promises.filter("status = 'open'")
    rest = [c for c in opened.columns if c != "invoice_id"]
    one = opened.groupBy("invoice_id").agg(F.min_by(F.struct(*rest), "id").alias("p")).select("invoice_id", "p.*")
    stored = x.d.promises.filter("status <> 'open'").unionByName(one)
    created = x.d.invoices.filter("status = 'open' AND id % 3 = 0").select(
        F.lit(None).cast("bigint").alias("id"), F.col("id").alias("invoice_id"), F.col("amount").alias("promised_amount"),
        F.date_add(F.to_date(x.as_of), 14).alias("promised_date"), F.lit("voice").alias("source"), F.lit(0.5).alias("confidence_score"),
        x.as_of.alias("created_at"),
    )
    path = new_path(x.spark, "promises")
    keyed.create(stored, path, ["invoice_id"])
    keyed.upsert(created, path, ["invoice_id"], sinks.merged_open_promises)
    return keyed.read(x.spark, path).select(F.col("id").cast("double").alias("id"), "invoice_id", "promised_date", "status")
