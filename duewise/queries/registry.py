"""Registration of queries: a Spark function over the test tables and, where SQL can say it, its DuckDB check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duewise.functions.expr import ntz, rnd
from duewise.session import prepare
from duewise.sources import driver_tables
from duewise.sources.tables import Domain


class Inputs:
    """What a query sees: the session, the raw tables and the domain tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    @cached_property
    def d(self) -> Domain:
        return driver_tables.load(self.spark, self.sf_dir)

    def raw(self, name: str) -> DataFrame:
        return driver_tables.read_raw(self.spark, self.sf_dir, name)

    @property
    def as_of(self) -> Column:
        return ntz(driver_tables.AS_OF)

    @property
    def now_utc(self) -> Column:
        return ntz(driver_tables.NOW_UTC)

    @property
    def sunday_utc(self) -> Column:
        return ntz(driver_tables.SUNDAY_UTC)


@dataclass
class Spec:
    key: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


SPECS: dict[str, Spec] = {}


def present(df: DataFrame, digits: int) -> DataFrame:
    """Comparable output: rounded DOUBLE, BIGINT counts, ISO texts for dates and times."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            col = rnd(col.cast("double"), digits)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            col = col.cast("bigint")
        elif isinstance(kind, T.DateType):
            col = col.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), ",")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(key: str, oracle: str | None = None, digits: int = 6):
    def add(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(Inputs(spark, sf_dir)), digits)

        if key in SPECS:
            raise ValueError(f"duplicate query {key}")
        SPECS[key] = Spec(key, run, oracle)
        return fn

    return add
