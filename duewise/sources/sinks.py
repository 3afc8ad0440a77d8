"""Writers, and the merges that keyed tables use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise import params as P


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Append-only logs; no dedup."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a derived table, for example the case corpus or the two-row evaluation snapshot."""
    df.write.mode("overwrite").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions present in ``df``, for example one experiment's slices."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a written table is there and complete."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def merged(old: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the non-NULL fields of their update; new keys are added. ``updates`` may lack columns."""
    a, b = old.alias("a"), updates.alias("b")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    fresh = set(updates.columns)
    pick = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in fresh else F.col(f"a.{c}") for c in old.columns]
    return a.join(b, match, "full_outer").select(*pick)


def newest_per_key(updates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One update per key, the last one, before a merge."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("u")).select(*keys, "u.*")


def merged_open_promises(promises: DataFrame, created: DataFrame) -> DataFrame:
    """The one open promise per invoice takes the new terms; closed promises stay; a first promise is added.

    ``created``: id, invoice_id, promised_amount, promised_date, source, confidence_score, created_at; one per invoice.
    """
    terms = ["promised_amount", "promised_date", "source", "confidence_score"]
    is_open = promises.filter("status = 'open'")
    closed = promises.filter("status <> 'open'")
    a, b = is_open.alias("a"), created.withColumn("status", F.lit("open")).alias("b")
    pick = [
        F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in terms else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
        for c in promises.columns
    ]
    return closed.unionByName(a.join(b, F.col("a.invoice_id") == F.col("b.invoice_id"), "full_outer").select(*pick))


def feature_snapshots(features: DataFrame, version: str, stamp: str) -> DataFrame:
    """Three JSON buckets per feature row; undefined features are explicit nulls."""
    bucket = lambda names: F.to_json(F.struct(*[c for c in names if c in features.columns]), {"ignoreNullFields": "false"})
    return features.select(
        "merchant_id", "customer_id", "invoice_id", F.col(stamp).cast("timestamp_ntz").alias("feature_timestamp"),
        bucket(P.PAYMENT_SNAPSHOT).alias("payment_features"), bucket(P.PROMISE_SNAPSHOT).alias("promise_features"),
        bucket(P.BEHAVIOR_SNAPSHOT).alias("behavior_features"), F.lit(version).alias("model_version"),
    )
