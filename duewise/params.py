"""Fixed values. They must equal the published business constants for results to match."""

# Point-in-time features and labels
SEED = 42
HORIZON_DAYS = 60
RECENT_SHORT_DAYS = 90
RECENT_LONG_DAYS = 180
WRITE_OFF_KNOWN_AFTER_DAYS = 150
PROMISE_LEAD_FALLBACK_DAYS = 9
SIMULATED_PAYMENT_METHOD = "attribution_simulation"
DAY_MARKS = [30, 60, 90, 120, 150]
CLASS_BALANCE_LOW, CLASS_BALANCE_HIGH = 0.15, 0.85

# Splits
TIME_SPLIT_TRAIN_MONTHS, TIME_SPLIT_TEST_MONTHS = 9, 2
CUSTOMER_TRAIN_FRACTION, CUSTOMER_VALIDATION_FRACTION = 0.8, 0.15
CALIBRATION_FRACTION = 0.15
MIN_ARCHETYPE_ROWS = 30

# Probability bounds
PROBABILITY_FLOOR, PROBABILITY_CEILING = 0.01, 0.99

# Economics: action -> (cost, uplift, friction base), in candidate order; stop is never proposed
ACTIONS = {
    "wait": (0.0, 0.0, 0.0),
    "email": (5.0, 0.03, 2.0),
    "whatsapp": (10.0, 0.075, 4.0),
    "payment_link": (2.0, 0.06, 2.0),
    "voice": (200.0, 0.10, 20.0),
    "escalate": (650.0, 0.14, 80.0),
    "stop": (0.0, 0.0, 0.0),
}
CANDIDATE_ACTIONS = ["wait", "email", "whatsapp", "payment_link", "voice", "escalate"]
DISPUTE_EXCLUDED = ["voice", "escalate"]
CONTACT_ACTIONS = ["email", "whatsapp", "payment_link", "voice", "escalate"]
FRICTION_GROWTH = 0.5
MATERIALITY_FLOOR, MATERIALITY_FRACTION = 50.0, 0.01
LARGE_ESCALATE_AMOUNT, LARGE_ESCALATE_UPLIFT = 100_000.0, 0.02
CAUSE_CONFIDENCE = 0.6
CAUSE_NUDGE = {
    ("cash_flow_stress", "payment_link"): 0.03,
    ("oversight", "email"): 0.02,
    ("oversight", "whatsapp"): 0.02,
}

# Policy
MAX_CONTACTS = 5
COOLDOWN_DAYS = 3
MIN_PURSUIT_VALUE = 2000.0
HUMAN_APPROVAL_AMOUNT = 200_000.0
BUSINESS_OFFSET_MINUTES = 330
BUSINESS_START_HOUR, BUSINESS_END_HOUR = 9, 19
SUNDAY = 6

# Retrieval
MIN_CANDIDATES = 30
RRF_K = 60
TOP_K = 5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# Attribution
TREATMENT_FRACTION = 0.5
EXPERIMENT_ID = "day5_attribution_v1"
SIMPSON_FLOOR = 1000.0
Z_THRESHOLD = 1.96
LOW_N = 15
HORIZON_CANDIDATES = [30, 45, 60, 90]

# Evaluation
BASELINE_STRATEGY, ENGINE_STRATEGY = "Baseline (email everyone)", "Decision engine"
HIGH_ESCALATE_ARCHETYPE = "chronic_late"
LOW_ESCALATE_ARCHETYPES = ["reliable_payer", "strategic_enterprise", "already_paid_false_alarm"]

# Archetype -> (population share, organic recovery probability, promise keep probability)
ARCHETYPES = {
    "reliable_payer": (0.20, 0.95, 0.95),
    "slightly_late": (0.20, 0.85, 0.80),
    "chronic_late": (0.15, 0.55, 0.45),
    "promise_keeper": (0.10, 0.60, 0.90),
    "promise_breaker": (0.10, 0.50, 0.20),
    "strategic_enterprise": (0.10, 0.90, 0.75),
    "cash_constrained": (0.10, 0.45, 0.55),
    "already_paid_false_alarm": (0.05, 1.0, 0.0),
}
SHARE_TOLERANCE = 0.5
DISPUTE_RATE = 0.06
AMOUNT_MIN, AMOUNT_MAX = 5_000.0, 500_000.0

# Closed domains of the label columns
DOMAINS = {
    "invoice_status": ["open", "disputed", "promised", "paid", "written_off"],
    "promise_status": ["open", "kept", "broken"],
    "payment_status": ["completed", "failed", "reversed"],
    "action_type": list(ACTIONS),
    "policy_result": ["allowed", "blocked", "escalated"],
    "account_state": [
        "overdue", "assessment", "wait", "remind", "escalate", "promise", "monitoring", "kept", "broken",
        "reassess", "closed", "closed_paid", "closed_abandoned", "dispute_review",
    ],
    "treatment_group": ["acted", "control"],
}
EVENT_TYPES = [
    "invoice.overdue", "promise.created", "promise.broken", "payment.received", "payment.partial",
    "customer.responded", "action.failed", "review.timeout",
]
ACTION_STATE = {
    "wait": "wait", "email": "remind", "whatsapp": "remind", "payment_link": "remind", "voice": "remind",
    "escalate": "escalate",
}
REVIEW_TIMEOUT_STATES = ["wait", "remind", "escalate", "kept"]
BROKEN_PROMISE_STATES = ["promise"]

# Texts
REASON_PAID = "already paid -- ledger not yet reconciled"
REASON_DISPUTE = "disputed invoice -- collections pressure blocked pending resolution"
REASON_SMALL = "expected recovery value too small to justify continued tracking"
REASON_MAX_CONTACTS = f"max contact attempts ({MAX_CONTACTS}) reached"
REASON_HOURS = "outside business hours for this channel"
REASON_APPROVAL = f"amount >= Rs.{HUMAN_APPROVAL_AMOUNT:,.0f} -- requires human approval before escalation"
REASON_ALLOWED = "no policy constraints triggered"
CLOSING_MARKER = "randomized control-group experiment"
CLOSING_REASON = (
    f"Invoice recovered as part of a {CLOSING_MARKER}, not a fresh decision-engine assessment -- the entries "
    "above reflect the last real decision made before this payment was recorded."
)
OLD_CLOSING_REASON = (
    "Invoice recovered via the Day-5 attribution experiment's randomized-holdout simulation, not a fresh "
    "decision-engine assessment -- the entries above reflect the last real decision made before this payment "
    "was recorded."
)
SYNTHETIC_PAYMENT_NOTES = {
    "attribution_simulation": "recovered as part of a randomized control-group experiment, not a live transaction",
    "scenario_rehearsal": "injected for this demo rehearsal, not a live transaction",
}

# Feature columns
CATEGORICAL_FEATURES = ["merchant_segment", "merchant_industry", "customer_segment", "customer_industry"]
NUMERIC_FEATURES = [
    "amount", "amount_log1p", "payment_term_days", "issue_month", "issue_day_of_week",
    "customer_relationship_days_at_cutoff", "outstanding_amount", "outstanding_ratio", "has_prior_history",
    "prior_invoice_count", "prior_paid_count", "prior_written_off_count", "prior_payment_rate",
    "prior_avg_delay_days", "prior_avg_amount", "prior_total_amount", "prior_max_amount", "prior_promise_count",
    "prior_promise_kept_rate", "prior_escalation_touches_avg", "prior_days_since_last_invoice",
    "customer_invoice_frequency", "recent_90d_payment_rate", "recent_90d_late_rate", "recent_180d_payment_rate",
    "recent_180d_avg_delay_days", "recent_180d_ptp_keep_rate",
]
PAYMENT_SNAPSHOT = [
    "amount", "amount_log1p", "payment_term_days", "outstanding_amount", "outstanding_ratio", "prior_avg_amount",
    "prior_total_amount", "prior_max_amount", "prior_payment_rate", "prior_paid_count", "prior_written_off_count",
    "prior_avg_delay_days", "recent_90d_payment_rate", "recent_90d_late_rate", "recent_180d_payment_rate",
    "recent_180d_avg_delay_days",
]
PROMISE_SNAPSHOT = ["prior_promise_count", "prior_promise_kept_rate", "recent_180d_ptp_keep_rate", "source"]
BEHAVIOR_SNAPSHOT = [
    "issue_month", "issue_day_of_week", "merchant_segment", "merchant_industry", "customer_segment",
    "customer_industry", "customer_relationship_days_at_cutoff", "has_prior_history", "prior_invoice_count",
    "prior_escalation_touches_avg", "prior_days_since_last_invoice", "customer_invoice_frequency",
]
