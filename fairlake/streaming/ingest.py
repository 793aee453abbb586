"""Keeping a catalog current: event routing, manifest upkeep, finalising, quotas.

Stateful steps work on micro-batches. Each batch reads the table version that its batch
number names and writes the next one, so a batch that runs again after a failure gives
the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fairlake.functions import paths as P
from fairlake.operators.manifest import upsert_manifest
from fairlake.operators.oplog import quota_audit
from fairlake.operators.quality import finalize
from fairlake.sources import bucketed, io


def _dir_action(path: Column) -> Column:
    role = P.classify_dir(path)
    return F.when(role == "project", "init_project").when(role.isin("dataset", "legacy_dataset"), "init_dataset")


def _file_action(path: Column) -> Column:
    return F.when(~P.in_metadata(path), "ingest")


def route_events(events: DataFrame) -> DataFrame:
    """Adds ``path`` and ``action`` (NULL: nothing to do) to file-system events, batch or stream.

    Created folders get records, created files go to the manifest, moves count at their
    destination, and a modified contextual record is checked for completion. Deletes are not handled.
    """
    kind, is_dir = F.col("kind"), F.col("is_directory")
    path = F.when(kind == "moved", F.col("dest_path")).otherwise(F.col("src_path"))
    routed = events.withColumn("path", path)
    p = F.col("path")
    placed = F.when(is_dir, _dir_action(p)).otherwise(_file_action(p))
    action = (
        F.when(kind == "created", placed)
        .when((kind == "moved") & ~P.is_ignored(p, ~is_dir), placed)
        .when((kind == "modified") & ~is_dir & P.in_metadata(p) & p.endswith("experiment_contextual.json"), "check_completion")
    )
    return routed.withColumn("action", action)


def settled(events: DataFrame, now: Column, min_age_seconds: int, listing: DataFrame | None = None) -> DataFrame:
    """Events old enough for their file to be complete, whose file is still there."""
    ripe = events.where(F.col("ts") <= now - F.make_dt_interval(secs=F.lit(min_age_seconds)))
    return ripe if listing is None else ripe.join(listing.select("path"), "path", "left_semi")


def dedupe_events(events: DataFrame, keys: tuple[str, ...] = ("path", "kind"), ts: str = "ts", within: str | None = None) -> DataFrame:
    """The first event of every key; repeated ones collapse however a stream is cut into batches.

    The state holds one small entry per key, spread over the shuffle partitions, for ever. With ``within`` an entry
    ends when the watermark, the newest ``ts`` less this delay, has passed its event: repeats that are less than ``within`` apart
    collapse, and the state follows the keys of that time only. Of repeats further apart, those whose entry has ended are new.
    """
    if within is None:
        return events.dropDuplicates(list(keys))
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Starts a job that takes everything present in micro-batches and then ends.

    The checkpoint remembers what was taken, so the next start continues there.
    """
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def append_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Appends everything present to a Parquet table, exactly once per input."""
    (
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )


def backfill_then_stream(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None],
                         interval: str = "30 seconds") -> StreamingQuery:
    """First takes what is already there, then starts the continuous job from the same checkpoint."""
    run_available(stream, checkpoint, handle).awaitTermination()
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).start()
    )


MANIFEST_KEY = ("dataset_id", "file_name")


def manifest_writer(table: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch handler: upserts manifest rows into a table in buckets; batch n writes version n + 1 of the buckets it touches."""

    def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
        known = batch.limit(0).drop(*[c for c in order if c not in MANIFEST_KEY]) if current is None else current
        return upsert_manifest(known, batch, order)

    def handle(batch: DataFrame, batch_id: int) -> None:
        bucketed.rewrite(batch, table, batch_id + 1, MANIFEST_KEY, merge)

    return handle


def stream_manifest(rows: DataFrame, table: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Keeps a manifest current from a stream of manifest rows; read it with ``bucketed.read_table``."""
    return run_available(rows, checkpoint, manifest_writer(table, order))


def finalize_writer(table: str, records: Callable[[], DataFrame], run_ts: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: complete records of the datasets whose contextual record changed.

    ``records`` gives the current record table; a batch's output folder is named by its number.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        changed = batch.where("action = 'check_completion'").select(
            F.split_part("path", F.lit("/"), F.lit(-4)).alias("project_key"),
            F.split_part("path", F.lit("/"), F.lit(-3)).alias("dataset_key")).distinct()
        rows = records()
        datasets = rows.join(changed, ["project_key", "dataset_key"], "left_semi")
        projects = rows.where("dataset_key IS NULL").join(changed.select("project_key").distinct(), "project_key", "left_semi")
        finalize(datasets.unionByName(projects), run_ts).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return handle


def finalize_on_change(routed: DataFrame, table: str, checkpoint: str, records: Callable[[], DataFrame],
                       run_ts: str) -> StreamingQuery:
    return run_available(routed, checkpoint, finalize_writer(table, records, run_ts))


def quota_writer(table: str, state: str, limit: int, window_seconds: int, client: str = "client_id",
                 ts: str = "ts", tie: str = "event_id") -> Callable[[DataFrame, int], None]:
    """Batch handler for the sliding quota: decides a batch with the admitted requests still
    in the window, at most ``limit`` per client, carried over from the batch before."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(client, ts, tie).withColumn("carried", F.lit(False))
        if batch_id:
            rows = rows.unionByName(io.read_snapshot(spark, state, batch_id).withColumn("carried", F.lit(True)))
        out = f"{table}/batch={batch_id}"
        quota_audit(rows, limit, window_seconds, client, ts, tie).write.mode("overwrite").parquet(out)
        decided = spark.read.parquet(out)
        newest = decided.agg(F.max(ts)).scalar()  # over all clients, so those that left expire too
        live = F.col(ts) > newest - F.make_dt_interval(secs=F.lit(window_seconds))
        kept = decided.where("allowed").where(live).select(client, ts, tie)
        io.write_snapshot(kept, state, batch_id + 1)

    return handle


def stream_quota(requests: DataFrame, table: str, state: str, checkpoint: str, limit: int,
                 window_seconds: int) -> StreamingQuery:
    """Quota decisions for a stream of requests; batches must arrive in time order."""
    return run_available(requests, checkpoint, quota_writer(table, state, limit, window_seconds))
