"""Catalog of all record files of several trees, with a ledger so that a second run reads only what has changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlake.functions import variants as V
from fairlake.sources import bucketed

_LEDGER = "path string, root string, root_rank int, record_key string, size_bytes long, modified timestamp, digest string, raw string, deleted boolean, run long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        raws, digests = [], []
        for path in batch["path"]:
            try:
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inner) as stream:
                    data = stream.read()
                raws.append(data.decode())
                digests.append(hashlib.sha256(data).hexdigest())
            except (OSError, ValueError):  # gone since the listing, or no text
                raws.append(None)
                digests.append(None)
        yield batch.assign(raw=raws, digest=digests)


def list_files(spark: SparkSession, roots: list[str], pattern: str = "*.json") -> DataFrame:
    """``path, root, root_rank, record_key, size_bytes, modified`` of the files below the roots; no content is read."""
    found = None
    for rank, root in enumerate(roots):
        base = root.rstrip("/")
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
        relative = F.regexp_replace(F.substring_index("path", f"{base}/", -1), r"\.json$", "")
        own = listed.select("path", F.lit(base).alias("root"), F.lit(rank).alias("root_rank"), relative.alias("record_key"),
                            F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
        found = own if found is None else found.unionByName(own)
    return found


def ingest_catalog(spark: SparkSession, roots: list[str], path: str, buckets: int = bucketed.BUCKETS) -> int:
    """Brings the ledger below ``path`` in step with the files of all roots; returns the number of files that were read.

    The ledger is a table in buckets with one row per file: size, time, digest and text. Only files whose size or time differ
    from it are read, on the executors; files that are gone become tombstones. A run writes the buckets it touches only, and
    a run without changes writes nothing. Roots may hold the same record: see :func:`catalog_records`.
    """
    former = bucketed.pointers(spark, path)
    run = former[-1][0] + 1 if former else 1
    known = bucketed.read_table(spark, path) if former else spark.createDataFrame([], _LEDGER)
    listed = list_files(spark, roots)
    live = known.where("NOT deleted").select("path", "size_bytes", "modified")
    changed = listed.join(live, ["path", "size_bytes", "modified"], "left_anti")
    gone = known.where("NOT deleted").join(listed.select("path"), "path", "left_anti").withColumn("deleted", F.lit(True)).withColumn(
        "raw", F.lit(None).cast("string"))
    columns = [c.split(" ")[0] for c in _LEDGER.split(", ")]
    schema = "path string, root string, root_rank int, record_key string, size_bytes long, modified timestamp, raw string, digest string"
    read = changed.select("path", "root", "root_rank", "record_key", "size_bytes", "modified").mapInPandas(_read, schema)
    rows = read.withColumn("deleted", F.lit(False)).select(*[c for c in columns if c != "run"]).unionByName(gone.drop("run"))
    staged = f"{path}/runs/{run}"
    rows.withColumn("run", F.lit(run).cast("long")).select(*columns).write.mode("overwrite").parquet(staged)
    batch = spark.read.schema(_LEDGER).parquet(staged)
    n_read = batch.where("NOT deleted").count()
    if not batch.isEmpty():
        bucketed.rewrite(batch, path, run, ["path"], bucketed.latest_rows(["path"], ["run"]), buckets)
    return n_read


def catalog_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``record_key, root, path, digest, raw, body, copies``.

    A record is named by its path below the root. Where several roots hold it, the newest file counts, then the root that was named
    first; ``copies`` is the number of files. ``body`` is NULL for a text that is not JSON.
    """
    files = bucketed.read_table(spark, path).where("NOT deleted AND raw IS NOT NULL")
    order = F.struct("modified", (-F.col("root_rank")).alias("_r"), "path")
    best = files.groupBy("record_key").agg(F.max_by(F.struct("root", "path", "digest", "raw"), order).alias("x"), F.count("*").alias("copies"))
    return best.select("record_key", "x.*", V.parse_strict("x.raw").alias("body"), "copies")
