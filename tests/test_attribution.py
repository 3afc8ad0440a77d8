"""Slice cube, noise, Simpson check, CUPED, gating and assignment on hand-built rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from duewise.functions.expr import ntz
from duewise.operators import attribution as A
from duewise.operators.sampling import assign_arms, customer_split, time_split

SCHEMA = (
    "treatment_group STRING, action STRING, counterfactual_action STRING, segment STRING, archetype STRING, amount DOUBLE, "
    "observed_recovery DOUBLE, recovered BOOLEAN, baseline_predicted_recovery DOUBLE"
)


def row(group, action, hit, amount=10_000.0, segment="SMB", archetype="a", x=0.5):
    acted = group == "acted"
    return (group, action if acted else None, None if acted else action, segment, archetype, amount, amount if hit else 0.0, hit, x * amount)


def cube(spark, rows):
    return {(r.segment, r.action): r for r in A.slice_cube(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_equal_rates_give_no_increment(spark):
    rows = [row(g, "email", hit) for g in ("acted", "control") for hit in (True, False)]
    pooled = cube(spark, rows)[None, None]
    assert pooled.incremental_recovered_amount == 0 and pooled.recovery_rate_diff_z == 0
    assert pooled.incremental_net_recovery == pytest.approx(-2 * (5 + 2))


def test_amount_and_count_rates_differ_for_uneven_amounts(spark):
    rows = [row("acted", "email", True, 1_000.0), row("acted", "email", False, 9_000.0), row("control", "email", False), row("control", "email", True)]
    pooled = cube(spark, rows)[None, None]
    assert pooled.treatment_recovery_rate == pytest.approx(0.1) and pooled.treatment_count_recovery_rate == 0.5


def test_action_slices_match_control_by_counterfactual(spark):
    rows = [row("acted", "voice", True), row("control", "voice", False), row("control", "email", True), row("control", None, True)]
    got = cube(spark, rows)
    assert got[None, "voice"].control_n == 1 and got[None, None].control_n == 3
    assert (None, "email") not in got, "no slice for an action nobody was given"


def test_noise_by_hand_and_undefined_when_an_arm_is_empty(spark):
    rows = [row("acted", "email", i < 6) for i in range(10)] + [row("control", "email", i < 4) for i in range(10)]
    pooled = cube(spark, rows)[None, None]
    se = math.sqrt(0.6 * 0.4 / 10 + 0.4 * 0.6 / 10)
    assert pooled.recovery_rate_diff_se == pytest.approx(se) and pooled.recovery_rate_diff_z == pytest.approx(0.2 / se)
    alone = cube(spark, [row("acted", "email", True)])[None, None]
    assert alone.recovery_rate_diff_se is None and alone.control_count_recovery_rate is None and alone.control_recovery_rate == 0


@pytest.mark.parametrize("scale, flagged", [(10_000.0, True), (1.0, False)])
def test_sign_flip_is_flagged_only_when_material(spark, scale, flagged):
    # Acted rows sit in the archetype that rarely recovers: pooled looks bad, each archetype looks good.
    rows = [row("acted", "voice", i < 3, scale, archetype="low") for i in range(10)] + [row("acted", "voice", True, scale, archetype="high")]
    rows += [row("control", "voice", False, scale, archetype="low")] + [row("control", "voice", i < 9, scale, archetype="high") for i in range(10)]
    got = A.simpson_check(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.pooled < 0 < got.stratified and got.sign_flip is flagged


def test_read_gives_further_parts_only_where_asked(spark):
    flip = [row("acted", "escalate", i < 2, archetype="a") for i in range(10)] + [row("control", "escalate", i < 1, archetype="a") for i in range(10)]
    flip += [row("acted", "escalate", True, archetype="b")] + [row("control", "escalate", i < 36, archetype="b") for i in range(40)]
    calm = [row(g, "email", i < n, archetype=None) for g, n in (("acted", 6), ("control", 3)) for i in range(10)]
    records = spark.createDataFrame(flip + calm, SCHEMA)
    slices = A.slice_cube(records)
    plain = A.attribution_read(slices, records)
    assert plain.columns == [*slices.columns, "part"] and plain.drop("part").exceptAll(slices).isEmpty()
    assert plain.filter("segment IS NULL AND action IS NULL").count() == 1
    found = A.attribution_read(slices, records, diagnostics=True).collect()
    assert {(r.part, r.archetype) for r in found if r.part == "archetype"} == {("archetype", "a"), ("archetype", "b")}
    warned = [r for r in found if r.part == "warning"]
    assert [r.action for r in warned] == ["escalate"] and warned[0].pooled < 0 < warned[0].stratified
    assert "theta" not in found[0] and sum(r.part == "slice" for r in found) == slices.count()
    # An action without a stored slice gives no warning.
    assert A.attribution_read(slices.filter("action IS NULL"), records, diagnostics=True).filter("part = 'warning'").isEmpty()
    adjusted = A.attribution_read(slices, records, adjusted=True)
    assert "archetype" not in adjusted.columns and {r.metric for r in adjusted.filter("part = 'cuped'").collect()} == {"count", "amount"}
    assert adjusted.filter("part = 'cuped' AND (raw_effect IS NULL OR cuped_effect IS NULL)").isEmpty()
    nothing = A.attribution_read(slices.limit(0), records.limit(0), diagnostics=True, adjusted=True)
    assert nothing.isEmpty()


def cuped_rows(correlated, effect=0.1, n=4000):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        x = rng.uniform(0.1, 0.9)
        p = (0.6 * x + 0.1 if correlated else 0.4) + (effect if i % 2 else 0.0)
        rows.append(row("acted" if i % 2 else "control", "email", rng.random() < p, x=x))
    return rows


@pytest.mark.parametrize("correlated", [True, False])
def test_cuped_finds_the_effect_and_never_hurts(spark, correlated):
    df = spark.createDataFrame(cuped_rows(correlated), SCHEMA)
    got = {r.metric: r for r in A.cuped_slices(df, [[]]).collect()}["count"]
    assert got.raw_effect == pytest.approx(0.1, abs=0.04) and got.cuped_effect == pytest.approx(0.1, abs=0.04)
    assert got.cuped_se < got.raw_se if correlated else got.se_reduction_pct == pytest.approx(0, abs=1)


def test_constant_covariate_adjusts_nothing(spark):
    rows = [row(g, "email", i < n) for g, n in (("acted", 6), ("control", 3)) for i in range(10)]
    for got in A.cuped_slices(spark.createDataFrame(rows, SCHEMA), [[]]).collect():
        assert got.theta == 0 and got.corr is None and got.cuped_effect == pytest.approx(got.raw_effect) and got.cuped_se == pytest.approx(got.raw_se)


def test_cuped_needs_both_arms(spark):
    df = spark.createDataFrame([row("acted", "email", True), row("acted", "email", False, x=0.1)], SCHEMA)
    assert A.cuped_slices(df).count() == 0


def test_exact_percentiles_follow_linear_interpolation(spark):
    import numpy as np

    rng = random.Random(1)
    values = [round(rng.lognormvariate(9, 1), 2) for _ in range(501)] + [500.0] * 200
    df = spark.createDataFrame([row("acted", "email", True, v) for v in values], SCHEMA)
    got = A.amount_by_archetype(df).first()
    for p in (10, 25, 50, 75, 90):
        assert got[f"p{p}"] == pytest.approx(np.percentile(values, p), abs=0.006)
    assert got["std"] == pytest.approx(np.std(values, ddof=1))


DRAWS = "due_date DATE, amount DOUBLE, recovered_ever BOOLEAN, true_delay_days INT"
AS_OF = "2026-08-27 12:00:00"


@pytest.mark.parametrize("due, ever, delay, want", [
    (dt.date(2026, 6, 1), True, 10, (True, 10_000.0, dt.date(2026, 6, 11), dt.date(2026, 6, 11))),
    (dt.date(2026, 6, 1), True, 61, (False, 0.0, dt.date(2026, 8, 1), None)),
    (dt.date(2026, 8, 1), True, 60, (True, 10_000.0, dt.date(2026, 9, 30), dt.date(2026, 8, 26))),
    (dt.date(2026, 6, 1), False, None, (False, 0.0, None, None)),
])
def test_horizon_gate(spark, due, ever, delay, want):
    rows = spark.createDataFrame([(due, 10_000.0, ever, delay)], DRAWS)
    got = A.gate_at_horizon(rows, 60, ntz(AS_OF)).first()
    assert (got.recovered, got.recovered_amount, got.recovery_date, got.ledger_payment_date) == want


def test_assignment_is_reproducible_balanced_and_skips_ineligible(spark):
    rows = [(i, ["A", "A", "A", "B"][i % 4], i % 10 == 0, i % 15 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "invoice_id BIGINT, segment STRING, is_disputed BOOLEAN, is_actually_paid BOOLEAN")
    one, two = assign_arms(df), assign_arms(df.repartition(7))
    assert one.exceptAll(two).isEmpty()
    sizes = {(r.segment, r.treatment_group): r["count"] for r in one.groupBy("segment", "treatment_group").count().collect()}
    for segment in "AB":
        assert abs(sizes[segment, "acted"] - sizes[segment, "control"]) <= 1
    assert one.count() == sum(1 for r in rows if not r[2] and not r[3]) and one.filter("is_disputed OR is_actually_paid").isEmpty()
    assert not one.select("invoice_id", "treatment_group").exceptAll(assign_arms(df, seed=43).select("invoice_id", "treatment_group")).isEmpty()


def split_rows(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(str(i), f"c{i % 30}", start + dt.timedelta(days=int(i * 329 / 299)), int(i % 3 == 0)) for i in range(300)]
    return spark.createDataFrame(rows, "id STRING, customer_id STRING, date TIMESTAMP_NTZ, label INT")


def test_time_split_is_disjoint_and_ordered(spark):
    got = time_split(split_rows(spark), "date", "label", "id")
    assert got.count() == 300 and got.select("id").distinct().count() == 300
    edge = {r.split: r for r in got.groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("*").alias("n"), F.avg("label").alias("y")).collect()}
    assert edge["fit"].hi < edge["validation"].lo <= edge["validation"].hi < edge["test"].lo and edge["calibration"].hi < edge["validation"].lo
    assert edge["calibration"].y == pytest.approx(edge["fit"].y, abs=0.03)


def test_customer_split_shares_no_customer(spark):
    got = customer_split(split_rows(spark))
    assert got.groupBy("customer_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()
    sizes = {r.split: r.n for r in got.groupBy("split").agg(F.countDistinct("customer_id").alias("n")).collect()}
    assert sizes == {"fit": 20, "validation": 4, "test": 6}
