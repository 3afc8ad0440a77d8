"""The randomised-holdout run from live invoices to slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.operators import attribution as A
from duewise.operators.context import decision_context
from duewise.operators.economics import counterfactual, decide, with_cause
from duewise.operators.sampling import assign_arms
from duewise.plans.decisions import ScoreFn
from duewise.sources.tables import Domain, live_pool


def population(d: Domain, as_of: Column) -> DataFrame:
    """Open invoices with paid and disputed flags, contact context and customer segment."""
    live = live_pool(d.invoices).withColumnRenamed("id", "invoice_id")
    rows = decision_context(live, d.payments, d.actions, as_of)
    return rows.join(d.customers.select(F.col("id").alias("customer_id"), "segment"), "customer_id")


def arms(d: Domain, score: ScoreFn, as_of: Column, now_utc: Column, seed: int = P.SEED) -> DataFrame:
    """Eligible invoices with their arm, the engine's action and the clean counterfactual."""
    assigned = assign_arms(population(d, as_of), seed)
    scored = with_cause(score(assigned)).withColumn("amount", F.col("amount").cast("double"))
    decided = decide(scored, now_utc)
    kept = decided.select(
        "invoice_id", "customer_id", "segment", "due_date", "amount", "base_probability", "treatment_group",
        F.when(F.col("treatment_group") == "acted", F.col("final_action")).alias("action"),
    )
    return counterfactual(kept, now_utc)


def outcomes(assigned: DataFrame, draw: ScoreFn, as_of: Column, horizon: int = P.HORIZON_DAYS) -> DataFrame:
    """``draw`` adds the given outcome columns."""
    return A.gate_at_horizon(draw(assigned), horizon, as_of)


def experiment_rows(d: Domain, score: ScoreFn, draw: ScoreFn, as_of: Column, now_utc: Column) -> DataFrame:
    records = A.attribution_records(outcomes(arms(d, score, as_of, now_utc), draw, as_of))
    return A.load_attribution(records, d)
