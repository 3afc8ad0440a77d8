"""What the plans of the main jobs must and must not contain."""

import pytest

from duewise.queries.catalog import SPECS
from duewise.session import new_path
from duewise.sources import driver_tables
from duewise.sources.tables import live_pool, read_domain

SF = "/root/testdata/sf0.001"
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(spark, key):
    return SPECS[key].run(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [
    "O074_recovery_features", "O075_live_features", "O076_promise_features", "O034_policy", "O081_strategy_summary", "O084_slice_cube",
    "O091_cuped_slices", "O093_classification_metrics", "O114_assignment", "O117_time_split", "O156_rule_report", "O162_state_replay", "O164_broken_promises",
])
def test_no_python_rows_and_no_pairs(spark, key):
    text = plan(spark, key)
    for node in PYTHON + PAIRS:
        assert node not in text, node


def test_semi_and_anti_joins_stay(spark):
    assert "LeftSemi" in plan(spark, "O057_scored_invoices")
    assert "LeftAnti" in plan(spark, "O002_organic_history")
    assert "LeftAnti" in plan(spark, "O059_orphan_checks")


def test_scans_read_only_needed_columns_and_push_filters(spark):
    root = new_path(spark, "domain")
    driver_tables.invoices(spark, SF).write.parquet(f"{root}/invoices")
    live = live_pool(read_domain(spark, root).invoices).select("id", "amount")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = live._jdf.queryExecution().explainString(mode)
    assert "EqualTo(status,open)" in text
    assert "customer_id" not in text.split("ReadSchema")[1].split("\n")[0]


def test_decision_adds_no_shuffle_to_its_context(spark):
    context, decided = plan(spark, "O058_decision_context"), plan(spark, "O034_policy")
    assert decided.count("Exchange hashpartitioning") <= context.count("Exchange hashpartitioning")


def test_rule_report_joins_a_parent_once_and_shares_scans(spark):
    report = plan(spark, "O156_rule_report")
    apart = sum(plan(spark, k).count("Scan parquet") for k in (
        "O059_orphan_checks", "O150_temporal_rules", "O151_business_rules", "O152_duplicates", "O153_missing_values", "O154_bounds", "O155_category_shares",
    ))
    assert report.count("Scan parquet") <= 0.9 * apart
    assert report.count("LeftAnti") == 1 and report.count("isnull(parent_k") == 3
