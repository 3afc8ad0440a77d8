"""Classification metrics as aggregates over distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import ratio
from duewise.operators.prefix import before, chunked_prefix

SCORE_CHUNKS = 65_536


def _by_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and rows per distinct score, with the totals below it. Raw rows never meet in one task."""
    counted = scored.groupBy(*keys, "p").agg(F.sum("y").cast("bigint").alias("pos"), F.count(F.lit(1)).alias("rows"))
    chunked = counted.withColumn("chunk", F.floor(F.col("p") * SCORE_CHUNKS).cast("int"))
    return chunked_prefix(chunked, keys, "p", "chunk", ["pos", "rows"])


def classification_metrics(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """n, positive rate, tie-aware ROC-AUC, average precision (step sum), log loss, Brier. ``scored``: y (0/1), p."""
    keys = list(keys)
    p, y = F.col("p"), F.col("y")
    tiny = 2.220446049250313e-16
    safe = F.least(F.greatest(p, F.lit(tiny)), F.lit(1.0 - tiny))
    basic = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("positives"), F.avg(y).alias("positive_rate"),
        F.avg(-(y * F.ln(safe) + (1 - y) * F.ln(1 - safe))).alias("log_loss"), F.avg((y - p) * (y - p)).alias("brier"),
    )
    curve = _by_score(scored, keys).withColumns({
        "neg": F.col("rows") - F.col("pos"), "neg_below": F.col(before("rows")) - F.col(before("pos")),
    })
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)).alias("wins")
    total = basic.select(*keys, F.col("n").alias("t_n"), F.col("positives").alias("t_pos"))
    joined = curve.join(total, keys) if keys else curve.withColumn("_t", total.select(F.struct("t_n", "t_pos")).scalar()).select("*", "_t.*")
    tp = F.col("t_pos") - F.col(before("pos"))
    flagged = F.col("t_n") - F.col(before("rows"))
    area = joined.groupBy(*keys).agg(wins, F.sum(F.col("pos") * tp / flagged).alias("precision_sum"))
    out = basic.join(area, keys) if keys else basic.withColumn("_a", area.select(F.struct("wins", "precision_sum")).scalar()).select("*", "_a.*")
    pairs = F.col("positives") * (F.col("n") - F.col("positives"))
    return out.select(
        *keys, "n", "positive_rate", ratio(F.col("wins"), pairs).alias("roc_auc"),
        ratio(F.col("precision_sum"), F.col("positives")).alias("pr_auc"), "log_loss", "brier",
    )


def tie_averaged_ranks(scored: DataFrame) -> DataFrame:
    """Average rank of every distinct score."""
    return _by_score(scored, []).select("p", (F.col(before("rows")) + (F.col("rows") + 1) / 2.0).alias("avg_rank"), "rows")


def reliability_table(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins, left-closed, the last one takes 1.0; empty bins stay with NULL rates."""
    each = scored.withColumn("bin", F.least(F.floor(F.col("p") * bins).cast("int"), F.lit(bins - 1)))
    counts = each.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed_rate")
    )
    frame = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "observed_rate")


def archetype_sanity(scored: DataFrame) -> DataFrame:
    """``scored``: archetype, true_recovery_probability, p, y."""
    return scored.groupBy("archetype").agg(
        F.count(F.lit(1)).alias("n"), F.avg("true_recovery_probability").alias("true_organic_probability"),
        F.avg("p").alias("mean_predicted_probability"), F.avg("y").alias("observed_rate"),
    ).orderBy("archetype")


def archetype_sanity_with_fallback(test: DataFrame, full: DataFrame) -> DataFrame:
    """The test slice, or the full set when some archetype has too few test rows. Both are small aggregates."""
    thin = test.groupBy("archetype").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.min("n") < P.MIN_ARCHETYPE_ROWS, F.lit(True)).alias("thin")
    ).scalar()
    both = test.withColumn("full", F.lit(False)).unionByName(full.withColumn("full", F.lit(True)))
    return archetype_sanity(both.filter(F.col("full") == thin).drop("full"))


def broken_class_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and F1 of the broken class; zero where a denominator is empty."""
    broken, flagged = F.col("y") == 0, F.col("p") < threshold
    n = scored.agg(
        F.count_if(broken & flagged).alias("tp"), F.count_if(flagged).alias("flagged"), F.count_if(broken).alias("broken")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    tp = F.col("tp")
    return n.select(
        F.lit(threshold).alias("threshold"), zero(ratio(tp, F.col("flagged"))).alias("precision"),
        zero(ratio(tp, F.col("broken"))).alias("recall"), zero(ratio(2 * tp, F.col("flagged") + F.col("broken"))).alias("f1"),
    )
