"""Dense ranks inside groups of any size: rows are dealt by ranges of the order, so one group fills as many tasks as it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.llm.common import materialise
from duewise.operators.prefix import chunked_rank


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with idx (from 0, by ``order`` inside ``key``, which holds no null) and n (rows of the key), both longs.

    Rows that are equal in key and order get different ranks; which of them comes first is not defined. The dealt rows are
    written before they are counted, so that counts and ranks see the same ranges even if a task runs again.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(key, *order, "_tie").withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, name)
    out = chunked_rank(dealt, [key], F.col("_part"), [F.col(c) for c in [*order, "_tie"]])
    return out.select(*rows.columns, (F.col("rank_in_key") - 1).alias("idx"), F.col("n_in_key").cast("long").alias("n"))
