"""Case and query texts, and their tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _front(amount: Column, term: Column, segment: Column, industry: Column, rate: Column) -> Column:
    percent = F.bround(rate * 100).cast("bigint").cast("string")
    history = F.when(rate.isNull(), F.lit("no prior payment history")).otherwise(
        F.concat(F.lit("prior payment rate "), percent, F.lit("%"))
    )
    return F.concat(
        segment, F.lit(" segment, "), industry, F.lit(" industry customer. Invoice amount Rs."),
        F.format_number(F.bround(amount), 0), F.lit(", "), term.cast("bigint").cast("string"),
        F.lit("-day payment terms. "), history, F.lit("."),
    )


def case_text() -> Column:
    """Needs amount, payment_term_days, customer segment and industry, prior rate, action_types, status, delay_days."""
    done = F.when(F.size("action_types") > 0, F.array_join("action_types", ", ")).otherwise(F.lit("no follow-up action taken"))
    late = F.concat(F.lit("paid "), F.col("delay_days").cast("bigint").cast("string"), F.lit(" days late"))
    outcome = F.when(F.col("status") != "paid", "written off, never recovered").when(F.col("delay_days") > 0, late).otherwise("paid on time")
    front = _front(
        F.col("amount"), F.col("payment_term_days"), F.col("customer_segment"), F.col("customer_industry"), F.col("prior_payment_rate")
    )
    return F.concat(front, F.lit(" Actions taken: "), done, F.lit(". Outcome: "), outcome, F.lit("."))


def query_text(days_overdue: Column | None = None) -> Column:
    front = _front(
        F.col("amount"), F.col("payment_term_days"), F.col("customer_segment"), F.col("customer_industry"), F.col("prior_payment_rate")
    )
    if days_overdue is None:
        return front
    return F.concat(front, F.lit(" Currently "), days_overdue.cast("bigint").cast("string"), F.lit(" days overdue."))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
