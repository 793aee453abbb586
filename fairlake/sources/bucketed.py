"""A versioned table in buckets of its key: a change rewrites only the buckets that it touches."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_POINTER = "version long, schema string, buckets map<int,long>"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def pointers(spark: SparkSession, path: str) -> list[tuple[int, str, dict[int, int]]]:
    """``(version, schema, version that holds each bucket)`` of the versions that are kept, in order; one small row each."""
    if not _system(spark, path).exists(_path(spark, f"{path}/_versions_")):
        return []
    rows = spark.read.schema(_POINTER).parquet(f"{path}/_versions_/*").collect()
    return sorted((r.version, r.schema, dict(r.buckets)) for r in rows)


def _rows(spark: SparkSession, path: str, pointer, only: set[int] | None = None) -> DataFrame:
    _, schema, held = pointer
    parts = [f"{path}/data/version={v}/_bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
    typed = T.StructType.fromJson(json.loads(schema))
    return spark.read.schema(typed).parquet(*parts) if parts else spark.createDataFrame([], typed)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or the newest one up to ``version``."""
    kept = [p for p in pointers(spark, path) if version is None or p[0] <= version]
    if not kept:
        raise ValueError(f"no such version of {path}")
    return _rows(spark, path, kept[-1])


def rewrite(batch: DataFrame, path: str, version: int, key: Sequence[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame],
            buckets: int = BUCKETS) -> set[int]:
    """Writes version ``version``: ``merge(rows of the touched buckets, batch)`` replaces these buckets.

    All other buckets stay where they are; the new version only points to them, so bytes read and written follow the batch, not
    the table. ``merge`` must keep a row's key. It gets None where there is no former version. The pointer is written last: a failed write
    leaves the former version in place, and a repeated one with the same number gives the same table. Returns the touched buckets, at most
    ``buckets`` numbers, which pass the driver. A key's rows lie in one bucket, so ``buckets`` should grow with the table.
    """
    spark = batch.sparkSession
    former = [p for p in pointers(spark, path) if p[0] < version]
    touched = {r[0] for r in batch.select(_bucket(key, buckets).alias("b")).distinct().collect()}
    current = _rows(spark, path, former[-1], touched) if former else None
    merged = merge(current, batch)
    target = f"{path}/data/version={version}"
    merged.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(target)
    files = _system(spark, target).listStatus(_path(spark, target))
    filled = {int(name.split("=")[1]) for f in files if (name := f.getPath().getName()).startswith("_bucket=")}
    held = {b: v for b, v in former[-1][2].items() if b not in touched} if former else {}
    held |= {b: version for b in filled}
    schema = json.dumps(merged.schema.jsonValue())
    pointer = spark.createDataFrame([(version, schema, held)], _POINTER).coalesce(1)
    pointer.write.mode("overwrite").parquet(f"{path}/_versions_/v{version:012d}")
    return touched


def prune(spark: SparkSession, path: str, keep: int) -> int:
    """Removes versions but the newest ``keep``, and the buckets that no kept version points to; returns how many."""
    every = pointers(spark, path)
    old, kept = every[:-keep], every[-keep:]
    needed = {(b, v) for _, _, held in kept for b, v in held.items()}
    gone = {(b, v) for _, _, held in old for b, v in held.items()} - needed
    system = _system(spark, path)
    for version, _, _ in old:
        system.delete(_path(spark, f"{path}/_versions_/v{version:012d}"), True)
    for b, v in sorted(gone):
        system.delete(_path(spark, f"{path}/data/version={v}/_bucket={b}"), True)
    return len(gone)


def latest_rows(key: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge in which the row with the greatest ``order`` of each key stays, whatever batch brings it.

    Equal orders are settled by a hash of the row. One aggregation over both sides, combined before its shuffle.
    """
    def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if current is None else current.unionByName(batch.select(*current.columns))
        at = F.struct(*order, F.xxhash64(*both.columns).alias("_hash"))
        rest = [c for c in both.columns if c not in key]
        return both.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("_row")).select(*key, "_row.*")

    return merge
