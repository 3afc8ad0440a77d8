"""Queries on trained models. What depends on the learner is checked by rows only; beside it stand checks of what does not."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duewise import params as P
from duewise.operators import corpus as C
from duewise.operators import features as FE
from duewise.operators import metrics as M
from duewise.operators.retrieval import hybrid_retrieve
from duewise.plans import decisions as PD
from duewise.plans import training as TR
from duewise.queries.decisions import decisions
from duewise.queries.features import live_promises
from duewise.queries.modelling import split_views
from duewise.queries.registry import query
from duewise.queries.retrieval import _disputed, corpus, corpus_vectors, live_queries
from duewise.queries.sqlviews import day, r, sql, view
from duewise.session import materialise, new_path, shared_dir
from duewise.sources import keyed, sinks

view("cause_rows", """SELECT id AS invoice_id, customer_id, issue_date, (true_root_cause = 'cash_flow_stress')::BIGINT AS root_cause_label
  FROM past WHERE true_root_cause <> 'dispute'""")
split_views("root_cause", "cause_rows", "issue_date", "root_cause_label", "invoice_id")
view("report_rows", """SELECT 'recovery' AS model, 'time' AS "by", split, recovery_label AS y FROM split_recovery
  UNION ALL SELECT 'promise', 'time', split, kept FROM split_promise
  UNION ALL SELECT 'root_cause', 'time', split, root_cause_label FROM split_root_cause
  UNION ALL SELECT 'recovery', 'customer', split, recovery_label FROM split_customer""")
view("reported", f"""SELECT model, "by", kind, split, count(*) AS n, {r('avg(y)')} AS positive_rate FROM report_rows, (VALUES ('raw'), ('calibrated')) k(kind)
  WHERE split IN ('fit', 'test') GROUP BY ALL""")


def labelled_table(x, name):
    if name == "recovery":
        return FE.recovery_features(x.d).withColumn("recovery_label", FE.recovery_label())
    return FE.promise_features(x.d) if name == "promise" else FE.root_cause_table(x.d)


#: Name and split of every model.
MODELS = [("recovery", "time"), ("recovery", "customer"), ("promise", "time"), ("root_cause", "time")]


def job_root(x) -> str:
    """The folder of the training job's parts. A part runs once for each dataset and application, when a query first reads it."""
    return f"{shared_dir(x.spark)}/training-{zlib.crc32(x.sf_dir.encode()):08x}-{x.spark.sparkContext.applicationId}"


def stored_table(x, name):
    """The labelled table of a model, written once."""
    path = f"{job_root(x)}/tables/{name}"
    if not sinks.is_written(x.spark, path):
        labelled_table(x, name).write.mode("overwrite").parquet(path)
    return x.spark.read.parquet(path)


def model_root(x, name, by) -> str:
    """The folder of one model and split, trained, judged and saved."""
    root = f"{job_root(x)}/{by}-{name}"
    if not sinks.is_written(x.spark, f"{root}/rounds"):
        TR.models_job({name: stored_table(x, name)}, root, [(name, by)])
    return root


def trained(x, name, by="time"):
    """A saved model and its scored rows."""
    root = f"{model_root(x, name, by)}/{by}"
    return TR.load(name, root), x.spark.read.parquet(f"{root}/{name}/scored")


def stored_corpus(x):
    """The case corpus, written once: the text model is fitted on it and gives vectors of it."""
    path = f"{job_root(x)}/tables/corpus"
    if not sinks.is_written(x.spark, path):
        corpus(x).write.mode("overwrite").parquet(path)
    return x.spark.read.parquet(path)


def text_model(x):
    root = f"{job_root(x)}/text"
    if not sinks.is_written(x.spark, f"{root}/done"):
        TR.text_job(stored_corpus(x), "case_text", root)
        x.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{root}/done")  # a model is several folders; this one says that all are there
    return PipelineModel.load(f"{root}/text")


def snapshots(x):
    root = job_root(x)
    if not sinks.is_written(x.spark, f"{root}/snapshots"):
        TR.snapshots_job({name: stored_table(x, name) for name in TR.MODELS}, root)
    return x.spark.read.parquet(f"{root}/snapshots")


def saved(x, part, models=MODELS):
    """``metrics``, ``importances`` or ``rounds`` of some models."""
    read = x.spark.read.json if part == "metrics" else x.spark.read.parquet
    out = [read(f"{model_root(x, name, by)}/{part}") for name, by in models]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("O130_text_vectors", sql("SELECT id AS invoice_id, 384::BIGINT AS dims, 1.0::DOUBLE AS squared_norm FROM past"), digits=5)
def vectors(x):
    rows = TR.text_vectors(text_model(x), stored_corpus(x).select("invoice_id", "case_text"), "case_text")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return rows.select("invoice_id", F.size("embedding").alias("dims"), norm.alias("squared_norm"))


@query("O140_feature_matrix", sql(f"SELECT invoice_id, {len(P.CATEGORICAL_FEATURES) + 2 * len(P.NUMERIC_FEATURES)}::BIGINT AS n_features, split FROM split_recovery"))
def matrix(x):
    _, scored = trained(x, "recovery")
    return scored.select("invoice_id", F.size(vector_to_array("features")).alias("n_features"), "split")


@query("O141_boosted_trees")
def trees(x):
    model, scored = trained(x, "recovery")
    return TR.top_importances(model, scored).withColumn("rounds", F.lit(model.trees.getNumTrees))


@query("O141_chosen_rounds", sql(f"""SELECT DISTINCT model, "by", true AS is_lowest, true AS waited, 10::BIGINT AS importances FROM report_rows"""))
def chosen_rounds(x):
    """The kept round has the lowest loss of all that were judged, and the rounds went on for the patience after it or to the limit."""
    losses, rounds = F.col("losses"), F.col("rounds")
    before = F.slice(losses, 1, rounds + TR.PATIENCE)
    fair = saved(x, "importances").where("importance BETWEEN 0 AND 1").groupBy("model", "by").agg(F.count(F.lit(1)).alias("importances"))
    return saved(x, "rounds").join(fair, ["model", "by"]).select(
        "model", "by", (losses[rounds - 1] == F.array_min(before)).alias("is_lowest"),
        (F.size(losses) >= F.least(rounds + TR.PATIENCE, F.lit(TR.ROUNDS))).alias("waited"), "importances",
    )


@query("O142_isotonic_calibration")
def isotonic(x):
    model, scored = trained(x, "recovery")
    test = TR.calibrated(model, scored.filter("split = 'test'"))
    return M.reliability_table(TR.as_scored(test, "recovery_label", "p"))


@query("O142_calibrated_slice", sql(f"""SELECT 10::BIGINT AS bins, count(*) AS n, {r('avg(recovery_label)')} AS observed_rate FROM split_recovery WHERE split = 'test'"""))
def calibrated_slice(x):
    table = isotonic(x)
    rate = F.sum(F.coalesce(F.col("observed_rate"), F.lit(0.0)) * F.col("n")) / F.sum("n")
    return table.agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n"), rate.alias("observed_rate"))


@query("O143_platt_calibration")
def platt(x):
    model, scored = trained(x, "promise")
    test = TR.calibrated(model, scored.filter("split = 'test'"))
    return M.broken_class_metrics(TR.as_scored(test, "kept", "p"))


@query("O143_calibrated_promises", sql("SELECT promise_id, true AS in_bounds, true AS on_side FROM split_promise WHERE split = 'test'"))
def calibrated_promises(x):
    """Calibrated probabilities are in their bounds and on the side of one half that the fitted line gives."""
    model, scored = trained(x, "promise")
    test = TR.calibrated(model, scored.filter("split = 'test'"))
    at = model.calibrator.coefficients[0] * F.col("raw") + model.calibrator.intercept
    side = (F.col("p") >= 0.5) == (at >= 0)
    return test.select("promise_id", F.col("p").between(P.PROBABILITY_FLOOR, P.PROBABILITY_CEILING).alias("in_bounds"), side.alias("on_side"))


def live_scores(x):
    """Both models on one pass over the live features."""
    recovery, _ = trained(x, "recovery")
    cause, _ = trained(x, "root_cause")
    live = materialise(FE.live_features(x.d), "live")
    once = TR.score(recovery, live).withColumnRenamed("p", "recovery_probability")
    return TR.score(cause, once).select("invoice_id", "recovery_probability", F.col("p").alias("cash_flow_probability"))


@query("O144_batch_scoring")
def scoring(x):
    return live_scores(x)


@query("O144_scores_in_bounds", sql("SELECT id AS invoice_id, true AS recovery, true AS cash_flow FROM live"))
def scores_in_bounds(x):
    fair = lambda c: F.col(c).between(P.PROBABILITY_FLOOR, P.PROBABILITY_CEILING)
    return live_scores(x).select("invoice_id", fair("recovery_probability").alias("recovery"), fair("cash_flow_probability").alias("cash_flow"))


@query("O145_experiment_report")
def report(x):
    """Metrics of the recovery model on both splits, with its largest importances as one list."""
    recovery = [m for m in MODELS if m[0] == "recovery"]
    top = saved(x, "importances", recovery).groupBy("model", "by").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False), lambda v: v["feature"]).alias("top_features")
    )
    return saved(x, "metrics", recovery).join(top, ["model", "by"])


@query("O145_report_rows", sql("""SELECT "by", kind, split, n, positive_rate FROM reported WHERE model = 'recovery'"""))
def report_rows(x):
    return report(x).select("by", "kind", "split", "n", "positive_rate")


@query("O146_train_all_models")
def train_all(x):
    return saved(x, "metrics")


@query("O146_report_rows", sql("""SELECT model, "by", kind, split, n, positive_rate FROM reported"""))
def all_report_rows(x):
    return saved(x, "metrics").select("model", "by", "kind", "split", "n", "positive_rate")


@query("O146_saved_snapshots", sql("""SELECT 'recovery-v1' AS model_version, count(*) AS n, count(DISTINCT invoice_id) AS invoices FROM split_recovery
  UNION ALL SELECT 'promise-v1', count(*), count(DISTINCT invoice_id) FROM feat_promise
  UNION ALL SELECT 'root_cause-v1', count(*), count(DISTINCT invoice_id) FROM cause_rows"""))
def saved_snapshots(x):
    return snapshots(x).groupBy("model_version").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("invoice_id").alias("invoices"))


@query("O012_model_artifacts", sql("SELECT count(*) AS n, 0::BIGINT AS changed FROM split_recovery"))
def artifacts(x):
    model, scored = trained(x, "recovery")
    root = new_path(x.spark, "models")
    TR.save(model, root)
    again = TR.load("recovery", root)
    before = TR.calibrated(model, scored).select("invoice_id", "p")
    after = TR.calibrated(again, TR.raw_score(again.trees, scored.drop("raw"))).select("invoice_id", F.col("p").alias("p_loaded"))
    return before.join(after, "invoice_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") != F.col("p_loaded")).alias("changed")
    )


def stored_promises(x):
    """The stored table keeps at most one open promise per invoice, the first."""
    opened = x.d.promises.filter("status = 'open'")
    rest = [c for c in opened.columns if c != "invoice_id"]
    one = opened.groupBy("invoice_id").agg(F.min_by(F.struct(*rest), "id").alias("p")).select("invoice_id", "p.*")
    return x.d.promises.filter("status <> 'open'").unionByName(one)


@query("O167_promise_path", sql(f"""SELECT id, invoice_id, status, {day('promised_date')} AS promised_date, promised_amount::DOUBLE AS promised_amount, false AS scored
  FROM promises WHERE status <> 'open' UNION ALL
  SELECT min(id), invoice_id, 'open', {day('arg_max(promised_date, (created_at, id))')}, arg_max(promised_amount, (created_at, id))::DOUBLE, true
  FROM promises WHERE status = 'open' GROUP BY invoice_id"""), digits=2)
def promise_path(x):
    """New promises are scored at their event time and merged into the one open promise of their invoice, which keeps its id."""
    model, _ = trained(x, "promise")
    new = live_promises(x)
    p = TR.score(model, FE.live_promise_features(x.d, new)).select("promise_id", F.col("p").alias("score"))
    made = new.join(p, new["id"] == p["promise_id"]).select(
        "id", "invoice_id", "promised_amount", "promised_date", "source", F.col("score").alias("confidence_score"), "created_at"
    )
    last = sinks.newest_per_key(made, ["invoice_id"], F.struct("created_at", "id"))
    path = new_path(x.spark, "promises")
    keyed.create(stored_promises(x), path, ["invoice_id"])
    keyed.upsert(last, path, ["invoice_id"], sinks.merged_open_promises)
    fair = F.coalesce(F.col("confidence_score").between(P.PROBABILITY_FLOOR, P.PROBABILITY_CEILING), F.lit(False)) & (F.col("status") == "open")
    return keyed.read(x.spark, path).select("id", "invoice_id", "status", "promised_date", "promised_amount", fair.alias("scored"))


@query("O170_live_decision_pass", sql("""SELECT d.invoice_id, d.proposed AS proposed_action, d.final_action, d.policy_result, d.cause AS root_cause_label,
  (SELECT 1) IS NOT NULL AS decided, c.cases FROM decided d LEFT JOIN (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS cases FROM top_live GROUP BY 1) c ON c.query_id = d.invoice_id"""))
def live_pass(x):
    found = hybrid_retrieve(live_queries(x), corpus_vectors(x))
    cases = found.groupBy(F.col("query_id").alias("invoice_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("c"))
    rows = decisions(x).join(cases.select("invoice_id", F.col("c.doc_id").alias("cases")), "invoice_id", "left")
    return rows.select(
        "invoice_id", "proposed_action", "final_action", "policy_result", "root_cause_label", F.lit(True).alias("decided"), "cases"
    )


def scored_decisions(x):
    scores = live_scores(x).withColumnRenamed("recovery_probability", "base_probability")
    return PD.live_decisions(x.d, lambda rows: rows.join(scores, "invoice_id"), x.as_of, x.now_utc)


@query("O170_scored_decision_pass")
def scored_pass(x):
    """The same pass on model scores instead of the given columns."""
    return PD.distributions(scored_decisions(x))


@query("O170_scored_cases", sql("""SELECT l.id AS invoice_id, 1::BIGINT AS decisions, true AS known_action, coalesce(c.n, 0) AS cases
  FROM live l LEFT JOIN (SELECT query_id, count(*) AS n FROM top_live GROUP BY 1) c ON c.query_id = l.id"""))
def scored_cases(x):
    """The scored pass with cases found in the text model's space: how many decisions and cases each invoice has."""
    model = text_model(x)
    cases = TR.text_vectors(model, _disputed(x, stored_corpus(x), "invoice_id"), "case_text")
    asked = TR.text_vectors(model, _disputed(x, C.case_queries(FE.live_features(x.d), x.as_of), "query_id"), "text")
    found = hybrid_retrieve(
        materialise(asked, "queries"), materialise(cases.drop("action_types", "status", "delay_days", "customer_id", "merchant_id"), "corpus")
    )
    held = found.groupBy(F.col("query_id").alias("invoice_id")).agg(F.count(F.lit(1)).alias("cases"))
    known = F.bool_and(F.col("final_action").isin(*P.ACTION_STATE, "stop"))
    made = scored_decisions(x).groupBy("invoice_id").agg(F.count(F.lit(1)).alias("decisions"), known.alias("known_action"))
    return made.join(held, "invoice_id", "left").select("invoice_id", "decisions", "known_action", F.coalesce("cases", F.lit(0)).alias("cases"))
