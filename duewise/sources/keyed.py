"""Tables that are updated by key: parquet in buckets of the key, and a manifest that names each bucket's version.

An update reads and writes only the buckets that its keys fall in, into a folder of the new version; the others stay as they are.
Then it writes the new version's manifest, one row for each bucket. A version exists once its manifest is complete, so readers
switch at that moment, and a job that dies before leaves the table as it was. Files that no kept version names are removed apart,
by ``vacuum``. Two writers that start from the same version write the same manifest; the second one fails.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.session import materialise
from duewise.sources.sinks import merged

BUCKETS = 64
_MANIFEST = "bucket int, version long"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    found = [n for n in _names(spark, f"{root}/manifest") if "_SUCCESS" in _names(spark, f"{root}/manifest/{n}")]
    return [int(n.removeprefix("version=")) for n in found]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[int, int]:
    """The version of each bucket; at most as many rows as there are buckets."""
    version = versions(spark, root)[-1] if version is None else version
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/version={version:012d}").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _paths(root: str, named: dict[int, int]) -> list[str]:
    return [f"{root}/data/version={v:012d}/bucket={b}" for b, v in sorted(named.items()) if v >= 0]


def _rows(spark: SparkSession, root: str, named: dict[int, int]) -> DataFrame:
    schema = spark.read.parquet(f"{root}/schema").schema
    paths = _paths(root, named)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return _rows(spark, root, manifest(spark, root, version))


def _write(rows: DataFrame, root: str, keys: list[str], version: int, named: dict[int, int], touched: list[int], mode: str) -> None:
    """Data of the touched buckets, then the manifest that makes the version visible."""
    spark, buckets = rows.sparkSession, len(named)
    data = f"{root}/data/version={version:012d}"
    rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    held = {int(n.removeprefix("bucket=")) for n in _names(spark, data) if n.startswith("bucket=")}
    named = {**named, **{b: version if b in held else -1 for b in touched}}
    commit(spark, root, version, named, mode)


def commit(spark: SparkSession, root: str, version: int, named: dict[int, int], mode: str = "errorifexists") -> None:
    spark.createDataFrame(list(named.items()), _MANIFEST).coalesce(1).write.mode(mode).parquet(f"{root}/manifest/version={version:012d}")


def create(rows: DataFrame, root: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new table with version 0."""
    rows.sparkSession.createDataFrame([], rows.schema).write.parquet(f"{root}/schema")
    _write(rows, root, keys, 0, dict.fromkeys(range(buckets), -1), list(range(buckets)), "errorifexists")


def ensure(rows: DataFrame, root: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """``create`` unless the table is there."""
    if not versions(rows.sparkSession, root):
        rows.sparkSession.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{root}/schema")
        _write(rows, root, keys, 0, dict.fromkeys(range(buckets), -1), list(range(buckets)), "overwrite")


def upsert(
    updates: DataFrame, root: str, keys: list[str], change: Callable[[DataFrame, DataFrame], DataFrame] | None = None, base: int | None = None,
) -> list[int]:
    """Merge ``updates`` in and give the buckets that were written.

    ``change`` makes the new rows of some buckets from the old ones and the updates there; without it the non-NULL fields of an
    update replace those of its row. With ``base`` the update starts from that version and replaces the one after it, so that a
    micro-batch that runs again gives the same table.
    """
    spark = updates.sparkSession
    start = versions(spark, root)[-1] if base is None else base
    named = manifest(spark, root, start)
    updates = materialise(updates, "updates")
    touched = sorted(r[0] for r in updates.select(_bucket(keys, len(named))).distinct().collect())
    old = _rows(spark, root, {b: named[b] for b in touched})
    new = change(old, updates) if change else merged(old, updates, keys)
    _write(new, root, keys, start + 1, named, touched, "errorifexists" if base is None else "overwrite")
    return touched


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove what only versions before the last ``keep`` name, and versions that were never completed before these; gives the folders removed."""
    kept = versions(spark, root)[-keep:]
    used = {os.path.relpath(p, root) for v in kept for p in _paths(root, manifest(spark, root, v))}
    gone = [f"manifest/{n}" for n in _names(spark, f"{root}/manifest") if int(n.removeprefix("version=")) < kept[0]]
    for name in _names(spark, f"{root}/data"):
        if int(name.removeprefix("version=")) <= kept[-1]:
            gone += [p for p in (f"data/{name}/{b}" for b in _names(spark, f"{root}/data/{name}") if b.startswith("bucket=")) if p not in used]
    for path in gone:
        fs, where = _folder(spark, f"{root}/{path}")
        fs.delete(where, True)
    return gone
