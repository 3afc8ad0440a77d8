"""Decision context of live invoices from the ledger and the contact history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.functions.expr import cents, floor_days, money, to_ntz


def paid_totals(payments: DataFrame, as_of: Column) -> DataFrame:
    """Ledger total per invoice up to ``as_of``, whatever the payment status."""
    return payments.filter(to_ntz(F.col("payment_date")) <= as_of).groupBy("invoice_id").agg(
        F.sum(cents(F.col("amount"))).alias("paid_cents")
    )


def contact_totals(actions: DataFrame) -> DataFrame:
    return actions.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("contacts"), F.max("timestamp").alias("last_contact")
    )


def is_disputed() -> Column:
    return F.col("true_root_cause").eqNullSafe("dispute")


def decision_context(invoices: DataFrame, payments: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """``invoices`` keyed by ``invoice_id``. Both sides of each join are one row per invoice."""
    rows = invoices.join(paid_totals(payments, as_of), "invoice_id", "left").join(
        contact_totals(actions), "invoice_id", "left"
    )
    paid = F.coalesce(F.col("paid_cents"), F.lit(0))
    return rows.withColumns({
        "paid_total": money(paid),
        "is_actually_paid": paid >= cents(F.col("amount")),
        "is_disputed": is_disputed(),
        "prior_contact_count": F.coalesce(F.col("contacts"), F.lit(0)),
        "days_since_last_contact": floor_days(F.col("last_contact"), as_of).cast("double"),
    }).drop("paid_cents", "contacts", "last_contact", "true_root_cause")
