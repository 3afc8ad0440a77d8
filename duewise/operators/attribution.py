"""Holdout attribution: slice cube, noise calibration, Simpson check, CUPED."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import cents, lookup, ratio, rnd
from duewise.operators.prefix import before, chunked_prefix
from duewise.session import materialise
from duewise.sources.tables import Domain


def _acted() -> Column:
    return F.col("treatment_group") == "acted"


def _control() -> Column:
    return F.col("treatment_group") == "control"


def gate_at_horizon(draws: DataFrame, horizon: Column | int, as_of: Column) -> DataFrame:
    """Observed outcome inside the horizon. ``draws``: due_date, amount, recovered_ever, true_delay_days."""
    ever = F.col("recovered_ever")
    recovered = F.coalesce(ever & (F.col("true_delay_days") <= horizon), F.lit(False))
    date = F.when(ever, F.date_add("due_date", F.col("true_delay_days")))
    return draws.select(
        "*", recovered.alias("recovered"), F.when(recovered, F.col("amount")).otherwise(0.0).alias("recovered_amount"),
        date.alias("recovery_date"),
        F.when(recovered, F.least(date, F.date_sub(F.to_date(as_of), 1))).alias("ledger_payment_date"),
    )


def horizon_sensitivity(draws: DataFrame, as_of: Column) -> DataFrame:
    """Control recovery for several horizons from the same draws."""
    each = draws.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in P.HORIZON_CANDIDATES])))
    return gate_at_horizon(each, F.col("horizon"), as_of).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("recovered").cast("int")).alias("recovery_rate")
    )


def attribution_records(outcomes: DataFrame) -> DataFrame:
    """Action only for the acted arm, counterfactual only for control; the per-row increment is never known."""
    return outcomes.select(
        "invoice_id", "treatment_group",
        rnd(F.col("base_probability") * F.col("amount"), 2).cast("decimal(12,2)").alias("baseline_predicted_recovery"),
        rnd(F.col("recovered_amount"), 2).cast("decimal(12,2)").alias("observed_recovery"),
        F.lit(None).cast("decimal(12,2)").alias("incremental_recovery"),
        F.when(_acted(), F.col("action")).alias("action"),
        F.when(_control(), F.col("counterfactual_action")).alias("counterfactual_action"),
    )


def load_attribution(records: DataFrame, d: Domain) -> DataFrame:
    """Records with amount, segment and (for diagnostics only) archetype."""
    inv = d.invoices.select(F.col("id").alias("invoice_id"), "customer_id", F.col("amount").cast("double").alias("amount"))
    cust = d.customers.select(F.col("id").alias("customer_id"), "segment", "archetype")
    rows = records.join(inv, "invoice_id", "left").join(cust, "customer_id", "left")
    return rows.withColumns({
        "observed_recovery": F.col("observed_recovery").cast("double"),
        "baseline_predicted_recovery": F.col("baseline_predicted_recovery").cast("double"),
        "recovered": F.col("observed_recovery") > 0,
    })


def write_back(outcomes: DataFrame, payments: DataFrame) -> DataFrame:
    """Ledger payment per recovered invoice for what completed payments do not cover yet."""
    done = payments.filter(F.col("status") == "completed").groupBy("invoice_id").agg(F.sum(cents(F.col("amount"))).alias("done"))
    rows = outcomes.filter("recovered").join(done, "invoice_id", "left")
    open_cents = F.floor(F.col("recovered_amount") * 100.0 + 0.5) - F.coalesce(F.col("done"), F.lit(0))
    return rows.withColumn("open_cents", open_cents).filter("open_cents > 0").select(
        "invoice_id", (F.col("open_cents") / 100.0).cast("decimal(12,2)").alias("amount"),
        F.col("ledger_payment_date").alias("payment_date"), F.lit(P.SIMULATED_PAYMENT_METHOD).alias("method"),
        F.lit("completed").alias("status"),
    )


def _sliced(df: DataFrame) -> DataFrame:
    return df.withColumn("slice_action", F.when(_acted(), F.col("action")).otherwise(F.col("counterfactual_action")))


def _cells(df: DataFrame, dim: str, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """Grouping sets over (dim, slice_action); cells grouped by a NULL value are no cells."""
    out = df.groupingSets(sets, dim, "slice_action").agg(
        F.grouping(dim).alias("g_dim"), F.grouping("slice_action").alias("g_action"), *aggs
    )
    real = ((F.col("g_dim") == 1) | F.col(dim).isNotNull()) & ((F.col("g_action") == 1) | F.col("slice_action").isNotNull())
    return out.filter(real)


def slice_cube(df: DataFrame, dim: str = "segment", sets: list[list[str]] | None = None) -> DataFrame:
    """All slices in one pass: pooled, per ``dim``, per action, and both. NULL in a key column means all."""
    sets = sets or [[], [dim], ["slice_action"], [dim, "slice_action"]]
    cost = lookup(F.col("action"), {a: v[0] for a, v in P.ACTIONS.items()})
    drag = lookup(F.col("action"), {a: v[2] for a, v in P.ACTIONS.items()})
    total = lambda c, arm: F.coalesce(F.sum(F.when(arm, c)), F.lit(0.0))
    got, amount = F.col("observed_recovery"), F.col("amount")
    cells = _cells(_sliced(df), dim, sets, [
        F.count_if(_acted()).alias("treatment_n"), F.count_if(_control()).alias("control_n"),
        total(got, _acted()).alias("treatment_recovered_amount"), total(got, _control()).alias("control_recovered_amount"),
        total(amount, _acted()).alias("t_amount"), total(amount, _control()).alias("c_amount"),
        total(cost, _acted()).alias("treatment_cost"), total(drag, _acted()).alias("treatment_friction"),
        F.count_if(_acted() & F.col("recovered")).alias("t_hits"), F.count_if(_control() & F.col("recovered")).alias("c_hits"),
    ])
    cells = cells.filter((F.col("g_action") == 1) | (F.col("treatment_n") > 0))
    rate = lambda top, bottom: F.coalesce(ratio(F.col(top), F.col(bottom)), F.lit(0.0))
    rated = cells.withColumns({
        "treatment_recovery_rate": rate("treatment_recovered_amount", "t_amount"),
        "control_recovery_rate": rate("control_recovered_amount", "c_amount"),
        "treatment_count_recovery_rate": ratio(F.col("t_hits"), F.col("treatment_n")),
        "control_count_recovery_rate": ratio(F.col("c_hits"), F.col("control_n")),
    })
    increment = F.col("treatment_recovered_amount") - F.col("control_recovery_rate") * F.col("t_amount")
    p1, p2 = F.col("treatment_count_recovery_rate"), F.col("control_count_recovery_rate")
    se = F.sqrt(p1 * (1 - p1) / F.col("treatment_n") + p2 * (1 - p2) / F.col("control_n"))
    both = p1.isNotNull() & p2.isNotNull()
    return rated.select(
        F.col(dim), F.col("slice_action").alias("action"), "treatment_n", "control_n",
        "treatment_recovery_rate", "control_recovery_rate",
        (F.col("treatment_recovery_rate") - F.col("control_recovery_rate")).alias("incremental_recovery_rate"),
        "treatment_recovered_amount", "control_recovered_amount", increment.alias("incremental_recovered_amount"),
        "treatment_cost", "treatment_friction",
        (increment - F.col("treatment_cost") - F.col("treatment_friction")).alias("incremental_net_recovery"),
        "treatment_count_recovery_rate", "control_count_recovery_rate",
        F.when(both, se).alias("recovery_rate_diff_se"),
        F.when(both, F.when(se > 0, (p1 - p2) / se).otherwise(0.0)).alias("recovery_rate_diff_z"),
    )


def action_by_archetype(df: DataFrame) -> DataFrame:
    """Diagnostic: every action's effect inside each archetype."""
    cube = slice_cube(df.filter("archetype IS NOT NULL"), "archetype", [["archetype", "slice_action"]])
    return cube.filter("treatment_n > 0")


def simpson_check(df: DataFrame, by_archetype: DataFrame | None = None) -> DataFrame:
    """Actions whose pooled increment and archetype-stratified sum disagree in sign, both material."""
    pooled = slice_cube(df, "segment", [["slice_action"]]).select("action", F.col("incremental_recovered_amount").alias("pooled"))
    strata = (action_by_archetype(df) if by_archetype is None else by_archetype).groupBy("action").agg(F.sum("incremental_recovered_amount").alias("stratified"))
    big = lambda c: F.abs(F.col(c)) >= P.SIMPSON_FLOOR
    flip = (F.col("pooled") < 0) != (F.col("stratified") < 0)
    rows = pooled.join(strata, "action", "left").fillna(0.0, ["stratified"])
    return rows.withColumn("sign_flip", big("pooled") & big("stratified") & flip)


def amount_by_archetype(df: DataFrame, percents: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """Exact amount distribution per archetype. Percentiles come from ranks of distinct amounts, not from one big buffer."""
    rows = df.select("archetype", F.floor(F.col("amount") * 100.0 + 0.5).alias("v")).filter("archetype IS NOT NULL")
    basic = rows.groupBy("archetype").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("v") / 100.0).alias("mean"), (F.stddev_samp("v") / 100.0).alias("std"),
        (F.min("v") / 100.0).alias("min"), (F.max("v") / 100.0).alias("max"),
    )
    counted = rows.groupBy("archetype", "v").agg(F.count(F.lit(1)).alias("k"))
    placed = chunked_prefix(counted.withColumn("chunk", F.floor(F.col("v") / 10_000)), ["archetype"], "v", "chunk", ["k"])
    spots = F.array(*[F.struct(F.lit(p).alias("p"), ((F.col("n") - 1) * p / 100.0).alias("at")) for p in percents])
    wanted = basic.select("archetype", F.inline(spots))
    start = F.col(before("k"))
    holds = lambda i: (start <= i) & (i < start + F.col("k"))
    low, high = F.floor("at"), F.ceil("at")
    # A handful of wanted ranks per archetype meets the distinct amounts; only rows that hold one survive.
    met = placed.join(wanted, "archetype").filter(holds(low) | holds(high))
    by_rank = met.groupBy("archetype", "p", "at").agg(
        F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b")
    )
    value = (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))) / 100.0
    wide = by_rank.groupBy("archetype").agg(*[F.max(F.when(F.col("p") == p, value)).alias(f"p{p}") for p in percents])
    return basic.join(wide, "archetype")


# CUPED


def _metrics(df: DataFrame) -> DataFrame:
    """Covariate and outcome of both metrics, one row per metric."""
    pred = F.col("baseline_predicted_recovery")
    pairs = F.array(
        F.struct(F.lit("count").alias("metric"), (pred / F.col("amount")).alias("x"), F.col("recovered").cast("double").alias("y")),
        F.struct(F.lit("amount").alias("metric"), pred.alias("x"), F.col("observed_recovery").alias("y")),
    )
    return df.select("*", F.inline(pairs))


def cuped_theta(df: DataFrame) -> DataFrame:
    """One global adjustment per metric, fitted over both arms together.

    A covariate that does not vary explains nothing: theta is 0 and the correlation NULL, so adjusted figures are the raw ones.
    """
    moments = _metrics(df).groupBy("metric").agg(
        F.covar_samp("x", "y").alias("cov"), F.var_samp("x").alias("var_x"), F.var_samp("y").alias("var_y"), F.avg("x").alias("x_mean")
    )
    theta = F.coalesce(ratio(F.col("cov"), F.col("var_x")), F.lit(0.0))
    corr = ratio(F.col("cov"), F.sqrt("var_x") * F.sqrt("var_y"))
    return moments.select("metric", theta.alias("theta"), corr.alias("corr"), "x_mean")


def cuped_slices(df: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """Raw and adjusted effect side by side per slice and metric; slices with an empty arm give no row.

    One pass over the rows: mean and variance of the adjusted outcome follow from the moments of x and y in each arm, so only
    the cells meet theta.
    """
    sets = sets or [[], ["segment"], ["slice_action"], ["segment", "slice_action"]]
    rows = _metrics(_sliced(df))
    arm = lambda c, who: F.when(who, F.col(c))
    aggs = [F.count_if(_acted()).alias("treatment_n"), F.count_if(_control()).alias("control_n")]
    for side, who in (("t", _acted()), ("c", _control())):
        for c in ("x", "y"):
            aggs += [F.avg(arm(c, who)).alias(f"{c}_{side}"), F.var_samp(arm(c, who)).alias(f"var_{c}_{side}")]
        aggs.append(F.covar_samp(arm("x", who), arm("y", who)).alias(f"cov_{side}"))
    keyed = [["metric", *s] for s in sets]
    cells = rows.groupingSets(keyed, "metric", "segment", "slice_action").agg(
        F.grouping("segment").alias("g_dim"), F.grouping("slice_action").alias("g_action"), *aggs
    )
    cells = cells.join(cuped_theta(df), "metric")
    theta = F.col("theta")
    for side in ("t", "c"):
        spread = F.col(f"var_y_{side}") + theta * theta * F.col(f"var_x_{side}") - 2 * theta * F.col(f"cov_{side}")
        cells = cells.withColumn(f"adj_{side}", F.col(f"y_{side}") - theta * (F.col(f"x_{side}") - F.col("x_mean"))).withColumn(f"var_adj_{side}", spread)
    real = ((F.col("g_dim") == 1) | F.col("segment").isNotNull()) & ((F.col("g_action") == 1) | F.col("slice_action").isNotNull())
    nt, nc = F.col("treatment_n"), F.col("control_n")

    def welch(c: str) -> Column:
        variance = F.col(f"var_{c}_t") / nt + F.col(f"var_{c}_c") / nc
        return F.when((nt >= 2) & (nc >= 2) & (variance > 0), F.sqrt(variance))

    out = cells.filter(real & (nt > 0) & (nc > 0)).select(
        "segment", F.col("slice_action").alias("action"), "metric", "treatment_n", "control_n",
        (F.col("y_t") - F.col("y_c")).alias("raw_effect"), welch("y").alias("raw_se"),
        (F.col("adj_t") - F.col("adj_c")).alias("cuped_effect"), welch("adj").alias("cuped_se"), "theta", "corr",
    )
    return out.withColumn("se_reduction_pct", (1 - F.col("cuped_se") / F.col("raw_se")) * 100)


# Reads


def attribution_read(slices: DataFrame, records: DataFrame, diagnostics: bool = False, adjusted: bool = False, action: str = "escalate") -> DataFrame:
    """Stored ``slices`` as rows of ``part`` slice; further parts, with columns of their own, only where asked for.

    ``diagnostics`` adds the effect of ``action`` inside each archetype (part archetype) and the sliced actions whose pooled and
    stratified effects disagree in sign (part warning). ``adjusted`` adds both pooled CUPED metrics (part cuped) beside the raw
    ones. Both are computed from ``records`` at the time of the read and never stored; no slice changes with them.
    """
    parts = [slices.withColumn("part", F.lit("slice"))]
    if diagnostics:
        # Archetypes times actions: a few dozen cells, which both diagnostics read.
        cells = materialise(action_by_archetype(records), "archetype-cells")
        parts.append(cells.filter(F.col("action") == action).withColumn("part", F.lit("archetype")))
        sliced = slices.filter("segment IS NULL AND action IS NOT NULL").select("action")
        flips = simpson_check(records, cells).filter("sign_flip").join(sliced, "action", "left_semi")
        parts.append(flips.select(F.lit("warning").alias("part"), "action", "pooled", "stratified"))
    if adjusted:
        parts.append(cuped_slices(records, [[]]).withColumn("part", F.lit("cuped")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# Dashboard roll-ups


def dashboard(cube: DataFrame) -> DataFrame:
    """Flags per slice: too few rows to read, and beyond the noise threshold."""
    z = F.col("recovery_rate_diff_z")
    return cube.select(
        "segment", "action", "treatment_n", "control_n", "incremental_net_recovery",
        (F.col("treatment_count_recovery_rate") - F.col("control_count_recovery_rate")).alias("count_increment"),
        (F.least("treatment_n", "control_n") < P.LOW_N).alias("low_n"),
        F.coalesce(F.abs(z) >= P.Z_THRESHOLD, F.lit(False)).alias("beyond_noise"),
    )


def channel_totals(cube: DataFrame) -> DataFrame:
    """How many action channels net positive, out of how many."""
    channels = cube.filter("segment IS NULL AND action IS NOT NULL")
    return channels.agg(
        F.count_if(F.col("incremental_net_recovery") > 0).alias("positive_channels"), F.count(F.lit(1)).alias("channels")
    )


def headline(summary: DataFrame) -> DataFrame:
    """Net improvement and recovery-rate gap in points of the engine over the baseline."""
    of = lambda c, who: F.max(F.when(F.col("strategy") == who, F.col(c)))
    gap = lambda c: of(c, P.ENGINE_STRATEGY) - of(c, P.BASELINE_STRATEGY)
    return summary.agg(
        gap("net_expected_recovered").alias("net_improvement"), (gap("recovery_rate") * 100).alias("recovery_delta_points")
    )
