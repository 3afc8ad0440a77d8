"""Metrics against their definitions, and a small training round trip."""

import math
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from duewise import params as P
from duewise.operators import metrics as M
from duewise.plans import training as TR
from duewise.session import new_path
from duewise.sources import sinks


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "y INT, p DOUBLE")


def auc(pairs):
    pos, neg = [p for y, p in pairs if y], [p for y, p in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    total, out, seen = sum(y for y, _ in pairs), 0.0, 0.0
    for cut in sorted({p for _, p in pairs}, reverse=True):
        flagged = [y for y, p in pairs if p >= cut]
        recall = sum(flagged) / total
        out += (recall - seen) * sum(flagged) / len(flagged)
        seen = recall
    return out


@pytest.mark.parametrize("grid", [7, 1000])
def test_metrics_with_ties(spark, grid):
    rng = random.Random(grid)
    pairs = [(int(rng.random() < 0.4), rng.randrange(1, grid) / grid) for _ in range(400)]
    got = M.classification_metrics(scored(spark, pairs)).first()
    assert got.roc_auc == pytest.approx(auc(pairs)) and got.pr_auc == pytest.approx(average_precision(pairs))
    assert got.brier == pytest.approx(sum((y - p) ** 2 for y, p in pairs) / 400)
    assert got.log_loss == pytest.approx(-sum(math.log(p if y else 1 - p) for y, p in pairs) / 400)


def test_metrics_per_key(spark):
    df = scored(spark, [(1, 0.9), (0, 0.1), (1, 0.2), (0, 0.8)]).withColumn("k", F.when(F.col("p").isin(0.9, 0.1), "good").otherwise("bad"))
    assert {r.k: r.roc_auc for r in M.classification_metrics(df, ["k"]).collect()} == {"good": 1.0, "bad": 0.0}


def test_bins_are_left_closed_and_the_last_takes_one(spark):
    got = M.reliability_table(scored(spark, [(1, 0.1), (1, 1.0), (0, 0.95)])).orderBy("bin").collect()
    assert [r.n for r in got] == [0, 1, 0, 0, 0, 0, 0, 0, 0, 2] and got[0].mean_predicted is None


def test_broken_class_on_empty_denominators(spark):
    got = M.broken_class_metrics(scored(spark, [(1, 0.9)])).first()
    assert (got.precision, got.recall, got.f1) == (0.0, 0.0, 0.0)
    got = M.broken_class_metrics(scored(spark, [(0, 0.2), (0, 0.8), (1, 0.3)])).first()
    assert (got.precision, got.recall, got.f1) == (0.5, 0.5, 0.5)


def table(spark, n=900):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        rate = None if i % 9 == 0 else rng.random()
        y = int(rng.random() < (0.2 if rate is None else 0.1 + 0.8 * rate))
        rows.append((i, i % 40, rate, ["a", "b"][i % 2], y))
    base = spark.createDataFrame(rows, "invoice_id BIGINT, customer_id BIGINT, prior_payment_rate DOUBLE, c STRING, recovery_label INT")
    extra = {c: F.lit(1.0) for c in P.NUMERIC_FEATURES if c != "prior_payment_rate"}
    cats = {c: F.col("c") for c in P.CATEGORICAL_FEATURES}
    return base.withColumns({**extra, **cats, "issue_date": F.date_add(F.lit("2024-01-01").cast("date"), (F.col("invoice_id") / 3).cast("int"))})


def test_training_round_trip(spark):
    model, rows = TR.train("recovery", table(spark), rounds=8)
    test = TR.calibrated(model, rows.filter("split = 'test'"))
    assert test.agg(F.min("p") >= P.PROBABILITY_FLOOR, F.max("p") <= P.PROBABILITY_CEILING).first() == (True, True)
    report = {(r.kind, r.split): r for r in TR.experiment_report(model, rows).collect()}
    assert report["raw", "test"].roc_auc > 0.6 and ("calibrated", "fit") in report
    assert TR.top_importances(model, rows).first().feature.startswith("prior_payment_rate")
    root = new_path(spark, "models")
    TR.save(model, root)
    again = TR.load("recovery", root)
    a = TR.score(model, table(spark)).select("invoice_id", "p")
    assert a.exceptAll(TR.score(again, table(spark)).select("invoice_id", "p")).isEmpty()
    unseen = table(spark, 5).withColumn("customer_industry", F.lit("never seen"))
    assert TR.score(model, unseen).filter("p IS NULL").isEmpty()


def test_rows_are_scored_once_and_stored_without_helper_columns(spark):
    path = new_path(spark, "scored")
    model, rows = TR.train("recovery", table(spark, 300), rounds=2, path=path)
    assert rows.count() == 300 and rows.inputFiles() and all(path in f for f in rows.inputFiles())
    assert set(rows.columns) == {*table(spark, 1).columns, "split", "features", "raw"}
    again = TR.raw_score(model.trees, rows.withColumnRenamed("raw", "kept"))
    assert again.filter("raw <> kept").isEmpty()


def test_customer_split_model(spark):
    model, rows = TR.train("recovery", table(spark), rounds=3, by="customer")
    assert {r.split for r in rows.select("split").distinct().collect()} == {"fit", "validation", "test"}


def test_a_number_without_any_value_is_constant(spark):
    names = ["recent_90d_payment_rate", "recent_90d_late_rate"]
    bare = table(spark).withColumns({c: F.lit(None).cast("double") for c in names})
    assert TR.without_values(TR.numeric_inputs(bare)) == [c for c in P.NUMERIC_FEATURES if c in names]
    model, rows = TR.train("recovery", bare, rounds=4)
    width = len(P.CATEGORICAL_FEATURES) + 2 * len(P.NUMERIC_FEATURES)
    assert {len(r.features) for r in rows.select("features").take(5)} == {width}
    root = new_path(spark, "models")
    TR.save(model, root)
    loaded = TR.load("recovery", root)
    later = bare.withColumns({c: F.lit(0.5) for c in names})
    seen = TR.feature_matrix(loaded.prepare, later).agg(*[F.count_if(F.col(f"{c}_im") != 0) for c in names]).first()
    assert tuple(seen) == (0, 0) and TR.score(loaded, later).filter("p IS NULL").isEmpty()


def test_platt_calibration_is_monotone(spark):
    rows = spark.range(400).select(
        (F.col("id") / 400.0).alias("raw"), (F.col("id") % 10 < F.col("id") / 40).cast("int").alias("kept"), F.lit("calibration").alias("split")
    )
    calibrator = TR.fit_calibrator(rows, "kept", "platt")
    out = TR.calibrated(TR.Trained("promise", None, None, calibrator), rows).orderBy("raw")
    p = [r.p for r in out.collect()]
    assert p == sorted(p) and p[0] < 0.3 < 0.7 < p[-1]


def test_best_round_waits_for_the_patience():
    assert TR.best_round([3, 2, 1], 2) == (3, False)
    assert TR.best_round([3, 1, 2, 2, 0], 2) == (2, True)  # the later low comes after the patience
    assert TR.best_round([3, 1, 2, 0.5, 2, 2], 2) == (4, True)
    assert TR.best_round([1, 1, 1], 5) == (1, False)


def test_kept_rounds_have_the_lowest_validation_loss(spark):
    model, rows = TR.train("recovery", table(spark), rounds=24, patience=3)
    kept, _ = TR.best_round(model.losses, 3)
    assert model.trees.getNumTrees == kept and model.losses[kept - 1] == min(model.losses[: kept + 3])
    matrix = rows.filter("split = 'validation'").select("features", F.col("recovery_label").cast("double").alias("recovery_label"))
    assert model.trees.evaluateEachIteration(matrix) == pytest.approx(model.losses[:kept])


def test_without_validation_rows_all_rounds_stay(spark):
    rows = spark.range(40).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") > 20).cast("int").alias("y"), F.lit("fit").alias("split"))
    trees, losses = TR.fit_trees(rows, "y", rounds=5)
    assert trees.getNumTrees == 5 and losses == []


def test_a_text_has_one_vector_in_any_frame(spark):
    texts = spark.createDataFrame([(1, "late invoice paid"), (2, "invoice disputed"), (3, "late late"), (4, ""), (5, None)], "id INT, t STRING")
    root = new_path(spark, "text")
    TR.fit_text_model(texts, "t").save(root)
    model = PipelineModel.load(root)
    whole = {r.id: r.embedding for r in TR.text_vectors(model, texts, "t").collect()}
    alone = {r.id: r.embedding for i in (1, 2, 3, 4, 5) for r in TR.text_vectors(model, texts.where(f"id = {i}"), "t").collect()}
    assert whole == alone and all(len(v) == 384 for v in whole.values())
    assert [round(sum(x * x for x in whole[i]), 5) for i in (1, 2, 3, 4, 5)] == [1, 1, 1, 0, 0]


def test_job_leaves_everything_to_read_back(spark):
    root = new_path(spark, "job")
    rows = table(spark).withColumns({"merchant_id": F.lit(1), "due_date": F.col("issue_date")})
    texts = spark.createDataFrame([("paid late",)], "t STRING")
    assert not sinks.is_written(spark, f"{root}/rounds")
    TR.training_job({"recovery": rows}, texts, "t", root, rounds=4)
    assert sinks.is_written(spark, f"{root}/rounds")
    assert {(r.by, r.kind, r.split) for r in spark.read.json(f"{root}/metrics").collect()} == {
        (b, k, s) for b in ("time", "customer") for k in ("raw", "calibrated") for s in ("fit", "test")
    }
    assert spark.read.parquet(f"{root}/importances").count() == 20 and spark.read.parquet(f"{root}/snapshots").count() == 900
    scored = spark.read.parquet(f"{root}/time/recovery/scored")
    loaded = TR.load("recovery", f"{root}/time")
    again = TR.raw_score(loaded.trees, scored.drop("raw"))
    assert again.select("invoice_id", "raw").exceptAll(scored.select("invoice_id", "raw")).isEmpty()


def test_a_part_of_the_job_runs_alone(spark, monkeypatch):
    """Text vectors need no trees, and one model none of the others."""
    from types import SimpleNamespace

    from duewise.queries import models as Q

    rows = table(spark).withColumns({"merchant_id": F.lit(1), "due_date": F.col("issue_date")})
    x = SimpleNamespace(spark=spark, sf_dir=new_path(spark, "own"))
    fitted, fit = [], TR.fit_trees
    monkeypatch.setattr(TR, "ROUNDS", 4)
    monkeypatch.setattr(TR, "fit_trees", lambda *a, **k: fitted.append(a[1]) or fit(*a, **k))
    monkeypatch.setattr(Q, "corpus", lambda x: spark.createDataFrame([("paid late",), ("late",)], "case_text STRING"))
    monkeypatch.setattr(Q, "labelled_table", lambda x, name: rows)
    assert Q.text_model(x) is not None and fitted == []
    _, scored = Q.trained(x, "recovery")
    assert fitted == ["recovery_label"] and scored.count() == 900
    assert {r.by for r in Q.saved(x, "metrics", [("recovery", "time")]).collect()} == {"time"} and len(fitted) == 1
    assert Q.saved(x, "rounds", Q.MODELS[:2]).count() == 2 and len(fitted) == 2


def test_text_vectors_compute_the_corpus_once(spark, monkeypatch):
    """The model is fitted on the corpus that it gives vectors of."""
    from types import SimpleNamespace

    from duewise.queries import models as Q

    made, rows = [], spark.createDataFrame([(1, "paid late"), (2, "late"), (2, "late"), (3, None)], "invoice_id BIGINT, case_text STRING")
    monkeypatch.setattr(Q, "corpus", lambda x: made.append(1) or rows)
    got = Q.vectors(SimpleNamespace(spark=spark, sf_dir=new_path(spark, "own"))).collect()
    assert sorted((r.invoice_id, r.dims) for r in got) == [(1, 384), (2, 384), (2, 384), (3, 384)] and len(made) == 1


def test_boosting_reads_fit_rows_that_lie_together_from_all_partitions(spark, monkeypatch):
    rows = spark.range(0, 6000, numPartitions=1).select(
        array_to_vector(F.array((F.col("id") % 17).cast("double"), (F.col("id") % 5).cast("double"))).alias("features"),
        (F.col("id") % 17 > 8).cast("int").alias("y"), F.when(F.col("id") < 4000, "fit").otherwise("validation").alias("split"),
    )
    seen = []

    class Seen(TR.GBTClassifier):
        def fit(self, df):
            seen.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
            return super().fit(df)

    monkeypatch.setattr(TR, "GBTClassifier", Seen)
    trees, losses = TR.fit_trees(rows, "y", rounds=3)
    assert len(losses) == 3 and trees.getNumTrees >= 1
    assert all(sum(n) == 4000 and len(n) >= 4 and max(n) <= 2 * 4000 / len(n) for n in seen)
