"""Reading domain tables, and the normalised analysis form of the raw ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import to_ntz
from duewise.sources.schema import HIDDEN_TRUTH, TABLES


DOMAIN_TABLES = (
    "merchants", "customers", "invoices", "payments", "promises", "actions", "interactions", "account_state",
    "decision_logs", "account_events",
)


class Domain:
    """The domain tables of one dataset. A table is opened when first asked for."""

    def __init__(self, loader: Callable[[str], DataFrame]):
        self._loader = loader
        self._open: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DOMAIN_TABLES:
            raise AttributeError(name)
        if name not in self._open:
            self._open[name] = self._loader(name)
        return self._open[name]


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TABLES[name]).format(fmt).load(f"{root}/{name}")


def read_domain(spark: SparkSession, root: str, fmt: str = "parquet") -> Domain:
    """One dataset folder with one folder per table; the schema is declared, never inferred."""
    names = {"promises": "payment_promises", "actions": "recovery_actions"}
    return Domain(lambda table: read_table(spark, root, names.get(table, table), fmt))


def visible_customers(customers: DataFrame) -> DataFrame:
    """Customers without hidden truth; everything but diagnostics starts from this."""
    return customers.drop(*HIDDEN_TRUTH)


def normalise_raw(d: Domain) -> dict[str, DataFrame]:
    """Raw tables in analysis form: timestamps without zone, money as DOUBLE, lower-case labels."""
    money = lambda c: F.col(c).cast("double").alias(c)
    stamp = lambda c: to_ntz(F.col(c)).alias(c)
    return {
        "invoices": d.invoices.select(
            "id", "customer_id", "invoice_number", money("amount"), stamp("issue_date"), stamp("due_date"),
            F.lower("status").alias("status"), stamp("paid_at"),
        ),
        "customers": visible_customers(d.customers).withColumn("relationship_start_date", stamp("relationship_start_date")),
        "merchants": d.merchants,
        "payments": d.payments.select("invoice_id", money("amount"), stamp("payment_date"), "method", "status"),
        "promises": d.promises.withColumn("status", F.lower("status")).drop("confidence_score"),
        "actions": d.actions.select("id", "invoice_id", F.lower("action_type").alias("action_type"), stamp("timestamp")),
    }


def organic_history(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Resolved invoices, minus those resolved by the experiment's own ledger write-back."""
    simulated = payments.filter(F.col("method") == P.SIMULATED_PAYMENT_METHOD).select(F.col("invoice_id").alias("id"))
    return invoices.filter(F.col("status").isin("paid", "written_off")).join(simulated, "id", "left_anti")


def live_pool(invoices: DataFrame) -> DataFrame:
    return invoices.filter(F.col("status") == "open")
