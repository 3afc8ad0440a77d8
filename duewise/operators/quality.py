"""Data-quality rules. Each function gives one row per rule: ``rule`` and ``violations``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import cents, hash_prefix, lookup
from duewise.sources.tables import Domain


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def tallied(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Several rules of one table in a single scan; each is an aggregate that gives its violations."""
    hits = df.agg(*[total.cast("bigint").alias(f"r{i}") for i, total in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(rules)])
    return hits.select(F.inline(pairs))


def counted(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Row rules of one table: how many rows meet each condition."""
    return tallied(df, {name: F.count_if(cond) for name, cond in rules.items()})


def one_rule(name: str, rows: DataFrame, weight: str | None = None) -> DataFrame:
    total = F.coalesce(F.sum(weight), F.lit(0)) if weight else F.count(F.lit(1))
    return rows.agg(F.lit(name).alias("rule"), total.cast("bigint").alias("violations"))


def orphans(children: dict[str, tuple[DataFrame, str]], parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows without a parent, one rule per child, in one join. Children are counted per key first, so a hot key is one row in it."""
    keyed = _union([
        child.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(rule))
        for rule, (child, key) in children.items()
    ])
    known = parent.select(F.col(parent_key).alias("parent_k"))
    match = F.col("k") == F.col("parent_k")
    if len(children) == 1:
        lost = keyed.join(known, match, "left_anti")
    else:  # an anti join would be planned once a child, below the union
        lost = keyed.join(known, match, "left").filter("parent_k IS NULL")
    return tallied(lost, {rule: F.coalesce(F.sum(F.when(F.col("rule") == rule, F.col("n"))), F.lit(0)) for rule in children})


def referential(d: Domain) -> DataFrame:
    """Twelve orphan rules over four parents: one join each."""
    owners = d.customers.select(F.col("id").alias("customer_id"), "merchant_id")
    with_owner = lambda df: df.join(owners, "customer_id", "left")
    states = d.account_state.join(d.invoices.select(F.col("id").alias("invoice_id"), "customer_id"), "invoice_id", "left")
    touched = d.interactions.filter(F.col("invoice_id").isNotNull())
    return _union([
        orphans({
            "customers.merchant_id": (d.customers, "merchant_id"), "invoices.merchant_id": (with_owner(d.invoices), "merchant_id"),
            "account_state.merchant_id": (with_owner(states), "merchant_id"),
        }, d.merchants),
        orphans({
            "invoices.customer_id": (d.invoices, "customer_id"), "interactions.customer_id": (d.interactions, "customer_id"),
            "account_state.customer_id": (states, "customer_id"),
        }, d.customers),
        orphans({
            "payments.invoice_id": (d.payments, "invoice_id"), "payment_promises.invoice_id": (d.promises, "invoice_id"),
            "interactions.invoice_id (where set)": (touched, "invoice_id"), "recovery_actions.invoice_id": (d.actions, "invoice_id"),
            "account_state.invoice_id": (d.account_state, "invoice_id"),
        }, d.invoices),
        orphans({"invoices without account_state": (d.invoices, "id")}, d.account_state, "invoice_id"),
    ])


def table_rules(d: Domain, as_of: Column) -> dict[str, tuple[DataFrame, dict[str, dict[str, Column]]]]:
    """Rules that need one table only: table, then rule group, then rule with its aggregate."""
    paid = F.col("status") == "paid"
    total = F.count(F.lit(1))
    disputed = F.coalesce(F.try_divide(F.count_if(F.col("true_root_cause") == "dispute"), total), F.lit(0.0))  # of no invoices: 0, out of band
    low, high = 1 - P.SHARE_TOLERANCE, 1 + P.SHARE_TOLERANCE

    def share(name: str, target: float) -> Column:
        """No customers at all, or a share far from its target."""
        n, want = F.count_if(F.col("archetype") == name), total * target
        return ((n == 0) | ~n.between(want * low, want * high)).cast("bigint")

    return {
        "invoices": (d.invoices, {
            "temporal_consistency": {
                "due_date before issue_date": F.count_if(F.col("due_date") < F.col("issue_date")),
                "paid without paid_at": F.count_if(paid & F.col("paid_at").isNull()),
                "paid_at without paid": F.count_if(~paid & F.col("paid_at").isNotNull()),
            },
            "business_rules": {"dispute rate out of band": (~disputed.between(P.DISPUTE_RATE * low, P.DISPUTE_RATE * high)).cast("bigint")},
            "missing_values": {"missing true_root_cause": F.count_if(F.col("true_root_cause").isNull())},
            "amount_and_date_bounds": {"amount out of bounds": F.count_if(~F.col("amount").cast("double").between(P.AMOUNT_MIN, P.AMOUNT_MAX))},
        }),
        "payments": (d.payments, {
            "temporal_consistency": {"payment in the future": F.count_if(F.col("payment_date") > F.to_date(as_of))},
            "amount_and_date_bounds": {"negative payment": F.count_if(F.col("amount") < 0)},
        }),
        "actions": (d.actions, {"amount_and_date_bounds": {"negative action cost": F.count_if(F.col("cost") < 0)}}),
        "customers": (d.customers, {
            "missing_values": {
                "missing archetype": F.count_if(F.col("archetype").isNull()),
                "missing true_recovery_probability": F.count_if(F.col("true_recovery_probability").isNull()),
            },
            "archetypes_present": {f"archetype share {a}": share(a, v[0]) for a, v in P.ARCHETYPES.items()},
        }),
    }


def one_group(d: Domain, as_of: Column, group: str) -> DataFrame:
    """The single-table rules of one group."""
    return _union([tallied(df, groups[group]) for df, groups in table_rules(d, as_of).values() if group in groups])


def early_payments(d: Domain) -> DataFrame:
    early = d.payments.groupBy("invoice_id", "payment_date").agg(F.count(F.lit(1)).alias("n")).join(
        d.invoices.select(F.col("id").alias("invoice_id"), "issue_date"), "invoice_id"
    )
    return one_rule("payment before issue_date", early.filter("payment_date < issue_date"), "n")


def temporal(d: Domain, as_of: Column) -> DataFrame:
    return _union([one_group(d, as_of, "temporal_consistency"), early_payments(d)])


def ledger_rules(d: Domain, as_of: Column) -> DataFrame:
    """Rules on invoices next to what was paid on them and their customer's archetype."""
    totals = d.payments.groupBy("invoice_id").agg(F.sum(cents(F.col("amount"))).alias("paid"))
    owner = d.customers.select(F.col("id").alias("customer_id"), "archetype")
    rows = d.invoices.join(totals, d.invoices["id"] == totals["invoice_id"], "left").join(owner, "customer_id", "left")
    alarm = F.coalesce(F.col("archetype") == "already_paid_false_alarm", F.lit(False))
    limit = F.date_sub(F.to_date(as_of), P.WRITE_OFF_KNOWN_AFTER_DAYS)
    off = F.col("paid").isNull() | (F.abs(F.col("paid") - cents(F.col("amount"))) > 1)
    return counted(rows, {
        "premature write-off": (F.col("status") == "written_off") & (F.col("due_date") > limit),
        "paid invoice with other payment total": (F.col("status") == "paid") & off,
        "false alarm without payment": alarm & F.col("paid").isNull(),
        "false alarm not open": alarm & (F.col("status") != "open"),
    })


def business(d: Domain, as_of: Column) -> DataFrame:
    return _union([ledger_rules(d, as_of), one_group(d, as_of, "business_rules")])


def duplicates(d: Domain) -> DataFrame:
    twice = d.invoices.groupBy("invoice_number").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return one_rule("duplicate invoice_number", twice)


def missing(d: Domain, as_of: Column) -> DataFrame:
    return one_group(d, as_of, "missing_values")


def bounds(d: Domain, as_of: Column) -> DataFrame:
    return one_group(d, as_of, "amount_and_date_bounds")


def archetype_shares(d: Domain, as_of: Column) -> DataFrame:
    """One rule per archetype: no customers at all, or a share far from its target."""
    return one_group(d, as_of, "archetypes_present")


def enum_domains(d: Domain) -> DataFrame:
    """Label columns hold only values of their closed domain."""
    outside = lambda c, domain: F.col(c).isNotNull() & ~F.col(c).isin(P.DOMAINS[domain])
    return _union([
        counted(d.invoices, {"invoices.status": outside("status", "invoice_status")}),
        counted(d.promises, {"payment_promises.status": outside("status", "promise_status")}),
        counted(d.payments, {"payments.status": outside("status", "payment_status")}),
        counted(d.actions, {
            "recovery_actions.action_type": outside("action_type", "action_type"),
            "recovery_actions.policy_result": outside("policy_result", "policy_result"),
        }),
        counted(d.account_state, {
            "account_state.current_state": outside("current_state", "account_state"),
            "account_state.next_action": outside("next_action", "action_type"),
        }),
    ])


def all_rules(d: Domain, as_of: Column) -> DataFrame:
    """Every rule with its group and verdict. The rules that need one table share its scan, whatever their group."""
    parts, group_of = [], {}
    for df, groups in table_rules(d, as_of).values():
        group_of |= {rule: group for group, rules in groups.items() for rule in rules}
        parts.append(tallied(df, {rule: total for rules in groups.values() for rule, total in rules.items()}))
    grouped = [_union(parts).withColumn("rule_group", lookup(F.col("rule"), group_of))]
    joined = {
        "referential_integrity_and_orphans": referential(d), "temporal_consistency": early_payments(d),
        "business_rules": ledger_rules(d, as_of), "duplicates": duplicates(d),
    }
    grouped += [df.withColumn("rule_group", F.lit(name)) for name, df in joined.items()]
    return _union(grouped).withColumn("passed", F.col("violations") == 0)


def dataset_summary(d: Domain) -> DataFrame:
    """Counts per table and label, total invoice value and revenue at risk."""
    size = lambda name, df: df.agg(F.lit(name).alias("metric"), F.lit("all").alias("value"), F.count(F.lit(1)).cast("double").alias("amount"))

    def by(name: str, df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("amount")).select(
            F.lit(name).alias("metric"), "value", "amount"
        )

    total = lambda name, df, value: df.agg(F.lit(name).alias("metric"), F.lit("all").alias("value"), F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("amount"))
    return _union([
        size("merchants", d.merchants), size("customers", d.customers), size("invoices_total", d.invoices),
        by("invoices_by_status", d.invoices, "status"), by("customers_by_archetype", d.customers, "archetype"),
        by("invoices_by_root_cause", d.invoices, "true_root_cause"), size("payments", d.payments), size("promises", d.promises),
        by("promises_by_status", d.promises, "status"), size("interactions", d.interactions), size("recovery_actions", d.actions),
        total("total_invoice_value", d.invoices, cents(F.col("amount")) / 100.0), total("total_revenue_at_risk", d.account_state, F.col("revenue_at_risk")),
    ])


def fingerprint(d: Domain) -> DataFrame:
    """Order-free hash of the business columns and two count tables: a sum of row hashes needs no sort and no big group."""
    row = F.concat_ws("|", "invoice_number", F.col("amount").cast("string"), F.col("issue_date").cast("string"), F.col("due_date").cast("string"), "status", "true_root_cause")
    inv = d.invoices.agg(F.sum(hash_prefix(row, 15).cast("decimal(38,0)")).cast("string").alias("h"))

    def counts(df: DataFrame, column: str) -> Column:
        per = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", column, "n"))), ",")).scalar()

    text = F.concat_ws("#", "h", counts(d.customers, "archetype"), counts(d.promises, "status"))
    return inv.select(F.md5(text).alias("fingerprint"))
