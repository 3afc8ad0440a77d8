"""Running totals, ranks and lags that split hot keys, against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from duewise.operators import prefix as X


def rows(spark, seed=1, n=500):
    rng = random.Random(seed)
    seen = {(rng.choice(["hot", "hot", "hot", "cold"]), rng.randrange(1000)): rng.randrange(9) for _ in range(n)}
    return spark.createDataFrame([(k, o, v) for (k, o), v in seen.items()], "k STRING, o INT, v BIGINT")


def test_chunked_prefix_equals_one_window(spark):
    df = rows(spark).withColumn("chunk", F.floor(F.col("o") / 50))
    got = X.chunked_prefix(df, ["k"], "o", "chunk", ["v"]).select("k", "o", X.before("v"))
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "o", F.coalesce(F.sum("v").over(w), F.lit(0)).alias(X.before("v")))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_chunked_rank_equals_row_number(spark):
    df = rows(spark, 2)
    got = X.chunked_rank(df, ["k"], F.floor(F.col("v") / 2), [F.col("v"), F.col("o")])
    w = Window.partitionBy("k").orderBy("v", "o")
    want = df.select("*", F.count("*").over(Window.partitionBy("k")).alias("n_in_key"), F.row_number().over(w).cast("bigint").alias("rank_in_key"))
    a = got.select("k", "o", "n_in_key", "rank_in_key")
    b = want.select("k", "o", "n_in_key", "rank_in_key")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_chunked_lag_equals_lag(spark):
    df = rows(spark, 3).withColumn("v", F.when(F.col("v") > 6, None).otherwise(F.col("v")))
    got = X.chunked_lag(df, "k", F.floor(F.col("o") / 10), ["o"], "v", "was").select("k", "o", "was")
    want = df.select("k", "o", F.lag("v").over(Window.partitionBy("k").orderBy("o")).alias("was"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_running_pair_of_largest_values_counts_duplicates(spark):
    data = [("a", 1, 5, 5), ("a", 2, 9, None), ("a", 3, 9, 4), ("a", 4, None, None), ("a", 5, 1, None)]
    df = spark.createDataFrame(data, "k STRING, o INT, top BIGINT, second BIGINT")
    out = X.strict_prefix(df, ["k"], "o", top_two=[("top", "second")]).orderBy("o").collect()
    assert [(r.before_top, r.before_second) for r in out] == [(None, None), (5, 5), (9, 5), (9, 9), (9, 9)]
