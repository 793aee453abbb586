"""A catalog that follows a stream of record changes, and the measures and alerts of a pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fairlake.sources import bucketed
from fairlake.streaming.ingest import run_available

KEY, ORDER = ("record_key",), ("version",)


def catalog_writer(path: str, buckets: int = bucketed.BUCKETS, keep: int | None = None) -> Callable[[DataFrame, int], None]:
    """Batch handler: the newest version of each record stays; batch n writes table version n + 1.

    Changes have ``record_key``, ``version``, ``deleted`` and further columns. A deletion stays as a tombstone, so an
    older change that comes later does not bring the record back. With ``keep``, older table versions are
    pruned after each batch.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        own = batch.where(F.col("record_key").isNotNull())
        bucketed.rewrite(own, path, batch_id + 1, KEY, bucketed.latest_rows(KEY, ORDER), buckets)
        if keep:
            bucketed.prune(batch.sparkSession, path, keep)

    return handle


def sync_catalog(changes: DataFrame, path: str, checkpoint: str, buckets: int = bucketed.BUCKETS, keep: int | None = None) -> StreamingQuery:
    """Keeps the catalog below ``path`` in step with a stream of record changes; ends when all present are taken.

    The result does not depend on how the stream is cut into batches, nor on the order in which changes come. A batch
    reads and writes only the buckets of its records. Changes without a key are left out.
    """
    return run_available(changes, checkpoint, catalog_writer(path, buckets, keep))


def read_catalog(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The records of the catalog that are not deleted."""
    return bucketed.read_table(spark, path, version).where("NOT deleted").drop("deleted")


def pipeline_metrics(outcomes: DataFrame, width: str = "1 hour", ts: str = "ts", late_after: str | None = None) -> DataFrame:
    """Work done per ``kind`` and tumbling window: files, failures, bytes, and the time taken.

    Batch or stream; ``outcomes`` has ``kind``, ``failed``, ``size_bytes`` and ``millis``. A stream needs ``late_after``: a window is
    given out once the watermark, the newest time seen less this delay, has passed its end, and rows that come
    later are dropped and counted (:func:`late_rows`). Counts combine before their shuffle. Rows without a time are in no window.
    """
    timed = outcomes.withWatermark(ts, late_after) if late_after else outcomes
    return timed.where(F.col(ts).isNotNull()).groupBy(F.window(ts, width).alias("w"), "kind").agg(
        F.count("*").alias("files"), F.count_if("failed").alias("failures"), F.sum("size_bytes").alias("size_bytes"),
        F.sum("millis").alias("millis"), F.max("millis").alias("longest_millis")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "kind", "files", "failures", "size_bytes", "millis", "longest_millis")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished or running stream dropped because they came after the watermark."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def alerts(metrics: DataFrame, value: Column, at_least: float, rearm_below: float, key: str = "kind", order: str = "window_start") -> DataFrame:
    """Rows at which an alert is raised: one per excursion of ``value`` to ``at_least`` or more, for each key.

    After an alert a key stays quiet until its value is below ``rearm_below``; values between the two limits change
    nothing. The state before a row follows from the last row outside that band alone, so one ordered window over the keys' rows
    is enough and no state is carried along. ``order`` is unique within a key. Null values change nothing.
    """
    marked = metrics.withColumn("_value", value)
    side = F.when(F.col("_value") >= at_least, True).when(F.col("_value") < rearm_below, False)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("_side", ignorenulls=True).over(before)
    raised = marked.withColumn("_side", side).withColumn("_last", last).where("_side AND NOT coalesce(_last, false)")
    return raised.withColumn("value", F.col("_value")).drop("_value", "_side", "_last")
