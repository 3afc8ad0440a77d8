"""Column helpers shared by all operators. Everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def rnd(value: Column, digits: int) -> Column:
    """Round half up by floor, with the same arithmetic on every engine; never gives minus zero."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def floor_days(start: Column, end: Column) -> Column:
    """Whole days between two timestamps, rounded down also for negative spans."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(float(MICROS_PER_DAY)))


def to_ntz(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def plus_days(ts: Column, days: Column | int) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return ts + F.make_dt_interval(days)


def cents(money: Column) -> Column:
    """Exact minor units of a DECIMAL(p, 2), as BIGINT, so sums do not depend on row order."""
    return (money * 100).cast("bigint")


def money(minor: Column) -> Column:
    return minor / F.lit(100.0)


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def hash_prefix(text: Column, hex_digits: int) -> Column:
    """Leading hex digits of md5 as BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, hex_digits), 16, 10).cast("bigint")


def clip_probability(p: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(p.cast("double"), F.lit(low)), F.lit(high))


def lookup(key: Column, table: dict[str, object], default: object = None) -> Column:
    """CASE over a short fixed table; stays in generated code, needs no join."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator, so that later filters and projections reuse the computed value.

    Without it the optimizer copies an expensive expression into every place that refers to it. No shuffle.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
