"""The case corpus: one text and metadata row per resolved invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise.functions.expr import floor_days, to_ntz
from duewise.functions.text import case_text, query_text


def ordered_actions(actions: DataFrame) -> DataFrame:
    """Distinct action types per invoice by first time. At most one row per type reaches the list."""
    first = actions.groupBy("invoice_id", "action_type").agg(F.min(F.struct("timestamp", "id")).alias("first"))
    return first.groupBy("invoice_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "action_type"))).alias("a")
    ).select("invoice_id", F.col("a.action_type").alias("action_types"))


def corpus_rows(features: DataFrame, actions: DataFrame) -> DataFrame:
    delay = floor_days(to_ntz(F.col("due_date")), F.col("paid_at"))
    rows = features.join(ordered_actions(actions), "invoice_id", "left").withColumns({
        "action_types": F.coalesce("action_types", F.array().cast("array<string>")),
        "delay_days": F.when(F.col("status") == "paid", delay).cast("double"),
    })
    return rows.select(
        "invoice_id", "customer_id", "merchant_id", case_text().alias("case_text"), "status", "delay_days", "amount",
        F.col("customer_segment").alias("segment"), F.col("customer_industry").alias("industry"), "action_types",
    )


def case_queries(features: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Retrieval queries from feature rows; with ``as_of`` the text says how long the invoice is overdue."""
    overdue = None if as_of is None else floor_days(to_ntz(F.col("due_date")), as_of)
    return features.select(
        F.col("invoice_id").alias("query_id"), query_text(overdue).alias("text"), "amount",
        F.col("customer_segment").alias("segment"), F.col("customer_industry").alias("industry"),
    )
