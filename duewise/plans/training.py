"""Model training, calibration and scoring with pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDF, Imputer, Normalizer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import clip_probability, rnd
from duewise.functions.text import tokens
from duewise.operators import metrics as M
from duewise.operators.sampling import customer_split, time_split
from duewise.session import materialise, new_path, shared_dir
from duewise.sources import sinks

ROUNDS, DEPTH, STEP, PATIENCE = 300, 4, 0.05, 20
FIRST_ROUNDS = 60
SCORE_DIGITS = 6

# The three models: label column, date column of the time split, row key, calibration, extra categorical columns.
MODELS = {
    "recovery": ("recovery_label", "issue_date", "invoice_id", "isotonic", []),
    "promise": ("kept", "T", "promise_id", "platt", ["source"]),
    "root_cause": ("root_cause_label", "issue_date", "invoice_id", "isotonic", []),
}


@dataclass
class Trained:
    name: str
    prepare: PipelineModel
    trees: GBTClassificationModel
    calibrator: IsotonicRegressionModel | LogisticRegressionModel
    losses: list[float] = field(default_factory=list)  # of the validation rows, by round


def numeric_inputs(df: DataFrame) -> DataFrame:
    """Numeric features as DOUBLE next to an indicator of each missing value."""
    names = P.NUMERIC_FEATURES
    return df.select(
        "*", *[F.col(c).cast("double").alias(f"{c}_in") for c in names], *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in names]
    )


def without_values(numbered: DataFrame) -> list[str]:
    """Numeric features that no row has a value of, found in one pass."""
    held = lambda c: F.count_if(F.col(f"{c}_in").isNotNull() & ~F.isnan(f"{c}_in"))
    counts = numbered.agg(*[held(c).alias(c) for c in P.NUMERIC_FEATURES]).first()
    return [c for c in P.NUMERIC_FEATURES if not counts[c]]


def prepare_stages(categorical: list[str], blank: list[str]) -> Pipeline:
    """Feature matrix: indexed categories, imputed numbers, missing indicators.

    A number in ``blank`` has no median to impute, so it is 0 in every row, later ones included: the trees never saw a value of it.
    """
    names = P.NUMERIC_FEATURES
    known = [c for c in names if c not in blank]
    stages = [StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep")]
    if known:
        stages.append(Imputer(inputCols=[f"{c}_in" for c in known], outputCols=[f"{c}_im" for c in known], strategy="median"))
    if blank:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(f'0.0D AS {c}_im' for c in blank)} FROM __THIS__"))
    parts = [f"{c}_ix" for c in categorical] + [f"{c}_im" for c in names] + [f"{c}_missing" for c in names]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def feature_matrix(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(numeric_inputs(df))


def without_helpers(matrix: DataFrame) -> DataFrame:
    """Without the columns that only make up ``features``, which holds their values."""
    names = [f"{c}_{part}" for c in P.NUMERIC_FEATURES for part in ("in", "im", "missing")]
    return matrix.drop(*names, *[f"{c}_ix" for c in matrix.columns])


def raw_score(trees: GBTClassificationModel, matrix: DataFrame) -> DataFrame:
    scored = trees.transform(matrix).withColumn("raw", vector_to_array("probability")[1])
    return scored.drop("probability", "rawPrediction", "prediction")


def best_round(losses: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Rounds to keep, and whether ``patience`` rounds without a lower loss have gone by since the best one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def spread(rows: DataFrame, label: str) -> DataFrame:
    """The rows, stored in files of equal length: a split's rows lie together, and each round passes over them several times.

    Their order in a file follows from their values alone, as MLlib draws its sample for the bins by place.
    """
    by = F.xxhash64(vector_to_array("features"), label)
    return materialise(rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(by), "fit-rows")


def fit_trees(
    matrix: DataFrame, label: str, rounds: int = ROUNDS, bins: int = 64, patience: int = PATIENCE,
) -> tuple[GBTClassificationModel, list[float]]:
    """Boosted trees on the fit rows, up to the round with the lowest loss on the validation rows, and that loss by round.

    The ensemble is judged round by round and grows, in doublings up to ``rounds``, until ``patience`` rounds bring nothing better;
    then one of the best length is fitted, whose trees are the first ones of the longer. Without validation rows all rounds stay.
    """
    matrix.sparkSession.sparkContext.setCheckpointDir(shared_dir(matrix.sparkSession))
    rows = matrix.select("features", F.col(label).cast("double").alias(label), "split")
    fit, validation = spread(rows.filter("split = 'fit'").drop("split"), label), rows.filter("split = 'validation'").drop("split")
    grown = lambda n: GBTClassifier(
        labelCol=label, maxDepth=DEPTH, maxIter=n, stepSize=STEP, seed=P.SEED, maxBins=bins, checkpointInterval=10,
    ).fit(fit)
    if validation.isEmpty():
        return grown(rounds), []
    n = min(rounds, FIRST_ROUNDS)
    while True:
        trees = grown(n)
        losses = trees.evaluateEachIteration(validation)
        best, settled = best_round(losses, patience)
        if settled or n == rounds:
            return (trees if best == n else grown(best)), losses
        n = min(rounds, 2 * n)


def fit_calibrator(scored: DataFrame, label: str, method: str):
    """Fitted on the calibration slice only. Equal scores enter as one weighted point, at most 10**6 of them, stored as a fit reads them twice."""
    slice_ = scored.filter("split = 'calibration'")
    if method == "isotonic":
        points = slice_.groupBy(rnd(F.col("raw"), SCORE_DIGITS).alias("raw")).agg(
            F.avg(F.col(label).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
        )
        return IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(materialise(points, "points"))
    rows = slice_.select(array_to_vector(F.array("raw")).alias("x"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(
        featuresCol="x", labelCol="label", regParam=1.0 / max(rows.count(), 1), elasticNetParam=0.0, standardization=False,
        probabilityCol="calibrated_vector",
    ).fit(rows)


def calibrated(trained: Trained, scored: DataFrame) -> DataFrame:
    """Adds ``p``, calibrated and clipped in DOUBLE."""
    if isinstance(trained.calibrator, IsotonicRegressionModel):
        out = trained.calibrator.transform(scored)
        p = F.col("calibrated")
    else:
        out = trained.calibrator.transform(scored.withColumn("x", array_to_vector(F.array("raw"))))
        p = vector_to_array("calibrated_vector")[1]
    return out.withColumn("p", clip_probability(p, P.PROBABILITY_FLOOR, P.PROBABILITY_CEILING)).drop(
        "calibrated", "calibrated_vector", "rawPrediction", "prediction", "x"
    )


def train(
    name: str, table: DataFrame, rounds: int = ROUNDS, by: str = "time", patience: int = PATIENCE, path: str | None = None,
) -> tuple[Trained, DataFrame]:
    """One model from its labelled table. Also gives the split and raw-scored table, stored at ``path``: rows are scored once."""
    label, date, key, method, extra = MODELS[name]
    split = time_split(table, date, label, key) if by == "time" else customer_split(table)
    stored = materialise(split, f"{name}-split")
    fit_rows = numeric_inputs(stored.filter("split = 'fit'"))
    prepare = prepare_stages([*P.CATEGORICAL_FEATURES, *extra], without_values(fit_rows)).fit(fit_rows)
    matrix = feature_matrix(prepare, stored)
    widest = max((len(v) for s in prepare.stages if isinstance(s, StringIndexerModel) for v in s.labelsArray), default=0)
    trees, losses = fit_trees(matrix, label, rounds, bins=max(64, widest + 1), patience=patience)
    path = path or new_path(table.sparkSession, f"{name}-scored")
    raw_score(trees, without_helpers(matrix)).write.mode("overwrite").parquet(path)
    scored = table.sparkSession.read.parquet(path)
    calibration = scored if by == "time" else scored.withColumn("split", F.when(F.col("split") == "validation", "calibration").otherwise(F.col("split")))
    return Trained(name, prepare, trees, fit_calibrator(calibration, label, method), losses), scored


def score(trained: Trained, features: DataFrame) -> DataFrame:
    """Calibrated probability ``p`` for feature rows."""
    names = features.columns
    return calibrated(trained, raw_score(trained.trees, feature_matrix(trained.prepare, features))).select(*names, "p")


def as_scored(rows: DataFrame, label: str, p: str) -> DataFrame:
    return rows.select("split", F.col(label).cast("int").alias("y"), F.col(p).alias("p"))


def experiment_report(trained: Trained, scored: DataFrame) -> DataFrame:
    """Metrics on fit and test rows, raw and calibrated, with the fit-test AUC gap."""
    label = MODELS[trained.name][0]
    used = scored.filter(F.col("split").isin("fit", "test"))
    both = as_scored(used, label, "raw").withColumn("kind", F.lit("raw")).unionByName(
        as_scored(calibrated(trained, used), label, "p").withColumn("kind", F.lit("calibrated"))
    )
    table = M.classification_metrics(both, ["kind", "split"])
    auc = lambda s: F.max(F.when(F.col("split") == s, F.col("roc_auc")))
    gap = table.groupBy("kind").agg((auc("fit") - auc("test")).alias("auc_gap"))
    return table.join(gap, "kind").withColumn("model", F.lit(trained.name))


def top_importances(trained: Trained, matrix: DataFrame, n: int = 10) -> DataFrame:
    """Largest feature importances; their number is fixed by the feature list."""
    attrs = matrix.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group}
    values = sorted(((float(v), names[i]) for i, v in enumerate(trained.trees.featureImportances.toArray())), reverse=True)
    return matrix.sparkSession.createDataFrame([(name, v) for v, name in values[:n]], "feature STRING, importance DOUBLE")


# Artefacts


def save(trained: Trained, root: str) -> None:
    for part in ("prepare", "trees", "calibrator"):
        getattr(trained, part).write().overwrite().save(f"{root}/{trained.name}/{part}")


def load(name: str, root: str) -> Trained:
    kind = IsotonicRegressionModel if MODELS[name][3] == "isotonic" else LogisticRegressionModel
    return Trained(
        name, PipelineModel.load(f"{root}/{name}/prepare"), GBTClassificationModel.load(f"{root}/{name}/trees"), kind.load(f"{root}/{name}/calibrator")
    )


def save_metrics(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").json(path)


# The training job


def training_job(
    tables: dict[str, DataFrame], texts: DataFrame, text: str, root: str, customer_models: tuple[str, ...] = ("recovery",), rounds: int = ROUNDS,
) -> None:
    """Trains, calibrates, evaluates and saves the models of ``tables`` (by name) and one text model fitted on ``texts``.

    Under ``root``: ``<split>/<model>`` with the model's parts and its scored rows, ``metrics``, ``importances``, ``rounds`` (loss by
    round), ``snapshots`` of all feature rows, ``text``. Every model is split by time, ``customer_models`` by customer as well.
    ``rounds`` is written last, so a job whose ``rounds`` are complete is complete, and one that died runs again over its remains.
    The parts can also be run alone, each with a root of its own: ``models_job``, ``snapshots_job`` and ``text_job``.
    """
    text_job(texts, text, root)
    tables = {name: materialise(table, f"{name}-table") for name, table in tables.items()}
    snapshots_job(tables, root)
    models_job(tables, root, [(name, by) for name in tables for by in (("time", "customer") if name in customer_models else ("time",))], rounds)


def text_job(texts: DataFrame, text: str, root: str) -> None:
    fit_text_model(texts, text).write().overwrite().save(f"{root}/text")


def snapshots_job(tables: dict[str, DataFrame], root: str) -> None:
    shots = [sinks.feature_snapshots(table, f"{name}-v1", "T" if MODELS[name][1] == "T" else "due_date") for name, table in tables.items()]
    _union(shots).write.mode("overwrite").parquet(f"{root}/snapshots")


def models_job(tables: dict[str, DataFrame], root: str, models: list[tuple[str, str]], rounds: int = ROUNDS) -> None:
    """``models``: name and split of each; ``tables`` are read several times."""
    spark = next(iter(tables.values())).sparkSession
    reports, importances, kept_rounds = [], [], []
    for name, by in models:
        model, kept = train(name, tables[name], rounds, by, path=f"{root}/{by}/{name}/scored")
        save(model, f"{root}/{by}")
        reports.append(materialise(experiment_report(model, kept).withColumn("by", F.lit(by)), "report"))
        importances.append(top_importances(model, kept).select(F.lit(name).alias("model"), F.lit(by).alias("by"), "feature", "importance"))
        kept_rounds.append((name, by, model.trees.getNumTrees, [float(v) for v in model.losses]))
    every = lambda parts: _union(parts).coalesce(1)
    save_metrics(every(reports), f"{root}/metrics")
    every(importances).write.mode("overwrite").parquet(f"{root}/importances")
    spark.createDataFrame(kept_rounds, "model STRING, by STRING, rounds INT, losses ARRAY<DOUBLE>").coalesce(1).write.mode("overwrite").parquet(f"{root}/rounds")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Text vectors when no embedding model is at hand


def _words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_words", tokens(F.coalesce(F.col(text), F.lit(""))))


def fit_text_model(corpus: DataFrame, text: str, dims: int = 384) -> PipelineModel:
    """Hashed words, weighted by their rarity in ``corpus``, normalised. Fitted once; a text then has one vector in any frame."""
    return Pipeline(stages=[
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims), IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ]).fit(_words(corpus, text).select("_words"))


def text_vectors(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """``embedding`` of each text; a text without words has the zero vector."""
    unit = model.transform(_words(df, text))
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_tfidf", "_unit")
