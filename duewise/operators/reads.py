"""Read queries over stored state: invoice list, one invoice, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.sources.tables import Domain

MAX_PAGE = 500


def scored_invoices(d: Domain, records: DataFrame | None = None) -> DataFrame:
    """Invoices that were ever scored, with their account state and experiment arm if any."""
    scored = d.decision_logs.select(F.col("invoice_id")).distinct()
    state = d.account_state.select("invoice_id", "current_state", "recoverability_score", "next_action")
    names = d.customers.select(F.col("id").alias("customer_id"), F.col("company_name").alias("customer_name"), "segment")
    rows = (
        d.invoices.withColumnRenamed("id", "invoice_id").join(scored, "invoice_id", "left_semi")
        .join(names, "customer_id").join(state, "invoice_id")
    )
    if records is not None:
        rows = rows.join(records.select("invoice_id", "treatment_group"), "invoice_id", "left")
    else:
        rows = rows.withColumn("treatment_group", F.lit(None).cast("string"))
    return rows.select(
        "invoice_id", "invoice_number", "customer_name", "segment", F.col("amount").cast("double").alias("amount"), "due_date",
        "current_state", "recoverability_score", "next_action", "treatment_group",
    )


def filtered(rows: DataFrame, state: str | None = None, segment: str | None = None, number_part: str | None = None) -> DataFrame:
    """List predicates; an unknown state is an error, not an empty list."""
    if state is not None:
        if state not in P.DOMAINS["account_state"]:
            raise ValueError(f"Unknown current_state: {state!r}")
        rows = rows.filter(F.col("current_state") == state)
    if segment is not None:
        rows = rows.filter(F.col("segment") == segment)
    if number_part is not None:
        escaped = number_part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        rows = rows.filter(F.col("invoice_number").ilike(f"%{escaped}%"))
    return rows


def page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 0 < limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset not negative")
    return rows.orderBy("due_date", "invoice_id").offset(offset).limit(limit)


def one_invoice(rows: DataFrame, invoice_id) -> DataFrame:
    return rows.filter(F.col("invoice_id") == invoice_id)
