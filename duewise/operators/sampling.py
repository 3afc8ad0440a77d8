"""Seeded random order, assignment and splits. Same seed, same result; a stratum of any size spreads over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duewise import params as P
from duewise.functions.expr import hash_prefix, plus_days
from duewise.operators.prefix import chunked_rank

CHUNK_HEX_DIGITS = 4


def seeded_key(seed: int | str, *columns: str) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])


def shuffled_rank(df: DataFrame, strata: list[str], key: str, seed: int | str) -> DataFrame:
    """``rank_in_key`` in md5 order inside each stratum and its size ``n_in_key``."""
    text = seeded_key(seed, *strata, key)
    return chunked_rank(df, strata, hash_prefix(text, CHUNK_HEX_DIGITS), [F.md5(text), F.col(key)])


def assign_arms(candidates: DataFrame, seed: int = P.SEED, fraction: float = P.TREATMENT_FRACTION) -> DataFrame:
    """Stratified randomised holdout over eligible invoices: the first share of each segment is acted on."""
    eligible = candidates.filter(~F.col("is_actually_paid") & ~F.col("is_disputed"))
    ranked = shuffled_rank(eligible, ["segment"], "invoice_id", seed)
    acted = F.col("rank_in_key") <= F.bround(F.col("n_in_key") * fraction)
    return ranked.withColumn("treatment_group", F.when(acted, "acted").otherwise("control")).drop("rank_in_key", "n_in_key")


def time_bounds(df: DataFrame, date_col: str) -> Column:
    """Struct of the first date, the test boundary and the validation boundary, as one scalar subquery."""
    months = P.TIME_SPLIT_TRAIN_MONTHS
    lo, hi = F.min(date_col), F.max(date_col)
    whole = lambda a, b: F.floor(F.timestamp_diff("SECOND", a, b) / 86400.0)
    spans = df.agg(lo.alias("lo"), hi.alias("hi")).select("lo", whole(F.col("lo"), F.col("hi")).alias("days"))
    cut = F.bround(F.col("days") * months / (months + P.TIME_SPLIT_TEST_MONTHS)).cast("int")
    spans = spans.select("lo", cut.alias("train_days"))
    last = F.bround(F.col("train_days") / months).cast("int")
    boundary = plus_days(F.col("lo").cast("timestamp_ntz"), F.col("train_days"))
    return spans.select(F.struct(
        F.col("lo").cast("timestamp_ntz").alias("lo"), boundary.alias("boundary"),
        (boundary - F.make_dt_interval(last)).alias("fit_val_boundary"),
    )).scalar()


def time_split(df: DataFrame, date_col: str, label: str, key: str, seed: int = P.SEED) -> DataFrame:
    """Adds ``split``: fit, validation, calibration or test. Calibration is drawn per label from the fit months."""
    stamp = F.col(date_col).cast("timestamp_ntz")
    bounds = time_bounds(df.select(F.col(date_col).cast("timestamp_ntz").alias(date_col)), date_col)
    marked = df.withColumn("_b", bounds)
    part = F.when(stamp >= F.col("_b.boundary"), "test").when(stamp >= F.col("_b.fit_val_boundary"), "validation").otherwise("pool")
    marked = marked.withColumn("_part", part).drop("_b")
    pool = shuffled_rank(marked.filter("_part = 'pool'"), [label], key, seed)
    calibrating = F.col("rank_in_key") <= F.bround(F.col("n_in_key") * P.CALIBRATION_FRACTION)
    pool = pool.withColumn("split", F.when(calibrating, "calibration").otherwise("fit")).drop("rank_in_key", "n_in_key", "_part")
    rest = marked.filter("_part <> 'pool'").withColumnRenamed("_part", "split")
    return pool.unionByName(rest)


def customer_split(df: DataFrame, customer: str = "customer_id", seed: int = P.SEED) -> DataFrame:
    """Adds ``split`` by customer: test, validation or fit; no customer is on two sides."""
    ranked = shuffled_rank(df.select(customer).distinct(), [], customer, seed)
    n_train = F.bround(F.col("n_in_key") * P.CUSTOMER_TRAIN_FRACTION)
    n_val = F.bround(n_train * P.CUSTOMER_VALIDATION_FRACTION)
    rank = F.col("rank_in_key")
    side = ranked.select(customer, F.when(rank > n_train, "test").when(rank <= n_val, "validation").otherwise("fit").alias("split"))
    return df.join(side, customer)


def split_summary(split: DataFrame, date_col: str, customer: str = "customer_id") -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(customer).alias("customers"),
        F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"),
    )


def one_sided_customers(split: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Customers seen only on the train side, and only in test."""
    side = split.groupBy(customer).agg(
        F.max((F.col("split") == "test").cast("int")).alias("in_test"),
        F.max((F.col("split") != "test").cast("int")).alias("in_train"),
    )
    return side.agg(
        F.count_if((F.col("in_train") == 1) & (F.col("in_test") == 0)).alias("train_only"),
        F.count_if((F.col("in_train") == 0) & (F.col("in_test") == 1)).alias("test_only"),
    )
