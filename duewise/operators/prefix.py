"""Running totals that survive hot keys.

A plain running window sends a whole key to one task. Here rows are reduced to one per (key, order value) first, and a
monotone chunk of the order value splits a key over many tasks: chunk totals give the carry, a window inside each
chunk gives the rest. Chunk totals are bounded by the chunk domain (days, hash prefixes, score buckets), not by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def before(name: str) -> str:
    return f"before_{name}"


def strict_prefix(
    rows: DataFrame,
    keys: list[str],
    order: str,
    sums: list[str] = (),
    maxes: list[str] = (),
    top_two: list[tuple[str, str]] = (),
) -> DataFrame:
    """Totals over rows of the same key with a strictly smaller order value.

    Rows must be unique per key and order value, and their number per key must be bounded. ``top_two`` pairs hold the
    largest and second largest value of a row; the running pair is exact, duplicates included.
    """
    by_key = Window.partitionBy(*keys).orderBy(order).rowsBetween(*_BEFORE)
    out = rows.select(
        "*",
        *[F.coalesce(F.sum(c).over(by_key), F.lit(0)).alias(before(c)) for c in sums],
        *[F.max(c).over(by_key).alias(before(c)) for c in maxes],
        *[F.max(first).over(by_key).alias(before(first)) for first, _ in top_two],
    )
    if not top_two:
        return out
    for first, second in top_two:
        seen = F.col(before(first))
        beaten = F.when(seen.isNotNull() & F.col(first).isNotNull(), F.least(seen, F.col(first)))
        out = out.withColumn(f"_{second}", F.greatest(F.col(second), beaten))
    out = out.select("*", *[F.max(f"_{second}").over(by_key).alias(before(second)) for _, second in top_two])
    return out.drop(*[f"_{second}" for _, second in top_two])


def chunked_prefix(rows: DataFrame, keys: list[str], order: str, chunk: str, sums: list[str]) -> DataFrame:
    """``strict_prefix`` of sums for keys with many order values; ``chunk`` must grow with ``order``."""
    totals = rows.groupBy(*keys, chunk).agg(*[F.sum(c).alias(c) for c in sums])
    carry = strict_prefix(totals, keys, chunk, sums=sums).select(
        *keys, chunk, *[F.col(before(c)).alias(f"_carry_{c}") for c in sums]
    )
    inner = strict_prefix(rows, [*keys, chunk], order, sums=sums)
    joined = inner.join(carry, [*keys, chunk])
    return joined.select(
        *rows.columns, *[(F.col(before(c)) + F.col(f"_carry_{c}")).alias(before(c)) for c in sums]
    )


def chunked_rank(df: DataFrame, keys: list[str], chunk: Column, order: list[Column]) -> DataFrame:
    """Exact 1-based ``rank_in_key`` and ``n_in_key``; ``chunk`` must grow with ``order`` and spread a key."""
    marked = df.withColumn("_chunk", chunk)
    counts = marked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    offsets = strict_prefix(counts, keys, "_chunk", sums=["_n"]).select(
        *keys, "_chunk", F.col(before("_n")).alias("_offset"), F.sum("_n").over(whole).alias("n_in_key")
    )
    local = marked.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    return (
        local.join(offsets, [*keys, "_chunk"])
        .withColumn("rank_in_key", F.col("_offset") + F.col("_local"))
        .drop("_chunk", "_local", "_offset")
    )


def chunked_lag(df: DataFrame, key: str, chunk: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Previous row's value per key in ``order``; the first row of a chunk takes the last value of the chunk before."""
    marked = df.withColumn("_chunk", chunk)
    last = marked.groupBy(key, "_chunk").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    carried = last.select(
        key, "_chunk", F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk")).alias("_carry")
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    return (
        marked.withColumn("_prev", F.lag(F.struct(value)).over(inside))
        .join(carried, [key, "_chunk"])
        .withColumn(out, F.coalesce(F.col("_prev"), F.col("_carry"))[value])
        .drop("_chunk", "_prev", "_carry")
    )
