"""Declared schema of every domain table."""

TABLES = {
    "merchants": "id BIGINT, industry STRING, segment STRING, relationship_start_date DATE",
    "customers": (
        "id BIGINT, merchant_id BIGINT, company_name STRING, industry STRING, segment STRING, "
        "relationship_start_date DATE, archetype STRING, true_recovery_probability DOUBLE, "
        "true_promise_keep_probability DOUBLE"
    ),
    "invoices": (
        "id BIGINT, customer_id BIGINT, invoice_number STRING, amount DECIMAL(12,2), issue_date DATE, due_date DATE, "
        "status STRING, paid_at TIMESTAMP_NTZ, true_root_cause STRING"
    ),
    "payments": "invoice_id BIGINT, amount DECIMAL(12,2), payment_date DATE, method STRING, status STRING",
    "payment_promises": (
        "id BIGINT, invoice_id BIGINT, promised_amount DECIMAL(12,2), promised_date DATE, source STRING, "
        "confidence_score DOUBLE, status STRING, created_at TIMESTAMP_NTZ"
    ),
    "recovery_actions": (
        "id BIGINT, invoice_id BIGINT, action_type STRING, expected_value DOUBLE, cost DECIMAL(10,2), "
        "policy_result STRING, result STRING, timestamp TIMESTAMP_NTZ"
    ),
    "interactions": (
        "id STRING, customer_id BIGINT, invoice_id BIGINT, channel STRING, content STRING, intent STRING, "
        "outcome STRING, cost DECIMAL(10,2), timestamp TIMESTAMP_NTZ"
    ),
    "account_state": (
        "invoice_id BIGINT, current_state STRING, recoverability_score DOUBLE, promise_score DOUBLE, "
        "expected_payment_date DATE, revenue_at_risk DOUBLE, next_action STRING, updated_at TIMESTAMP_NTZ"
    ),
    "decision_logs": (
        "id STRING, invoice_id BIGINT, decision STRING, model_scores STRING, evidence STRING, policy_checks STRING, "
        "reason STRING, timestamp TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ"
    ),
    "attribution_records": (
        "invoice_id BIGINT, treatment_group STRING, baseline_predicted_recovery DECIMAL(12,2), "
        "observed_recovery DECIMAL(12,2), incremental_recovery DECIMAL(12,2), action STRING, "
        "counterfactual_action STRING"
    ),
    "account_events": (
        "event_id BIGINT, event_type STRING, invoice_id BIGINT, occurred_at TIMESTAMP_NTZ, "
        "payload MAP<STRING,STRING>"
    ),
}

HIDDEN_TRUTH = ["archetype", "true_recovery_probability", "true_promise_keep_probability"]
